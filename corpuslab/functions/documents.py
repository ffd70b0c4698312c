"""Texts of samples as they are embedded or ranked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The field choices and the columns each puts together, in order.
EMBEDDING_FIELDS = {
    "QUESTION": ["question"],
    "SQL": ["sql"],
    "SQL_SKELETON": ["sql_skeleton"],
    "DB_SCHEMA": ["db_schema_sequence"],
    "SCHEMA_LINK": ["schema_link"],
    "QUESTION_SQL": ["question", "sql"],
    "QUESTION_SQL_SKELETON": ["question", "sql_skeleton"],
    "FULL": ["question", "schema_link", "sql"],
}
DOC_FORMATS = {"sql": ["sql"], "question_sql": ["question", "sql"]}


def document(fields: str) -> Column:
    """Document of a collection; several parts are put on lines of their own."""
    if fields not in EMBEDDING_FIELDS:
        raise ValueError(f"embedding fields {fields!r} not supported")
    return F.concat_ws("\n", *EMBEDDING_FIELDS[fields])


def query_text(form: str) -> Column:
    """The query side of a reranker's input."""
    question = F.col("question")
    with_evidence = F.concat(question, F.lit(" "), F.coalesce("evidence", F.lit("")))
    forms = {
        "question": question,
        "question_sql": F.concat(question, F.lit("\n"), F.col("sql")),
        "question_evidence": with_evidence,
        "question_evidence_sql": F.concat(with_evidence, F.lit("\n"), F.col("sql")),
    }
    if form not in forms:
        raise ValueError(f"query format {form!r} not supported")
    return forms[form]


def doc_text(form: str) -> Column:
    if form not in DOC_FORMATS:
        raise ValueError(f"document format {form!r} not supported")
    return F.concat_ws("\n", *DOC_FORMATS[form])
