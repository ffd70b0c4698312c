"""Schema linking and sample assembly: one join of the samples to their catalog row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import sqltext
from corpuslab.operators import catalog as cat

# Which field holds the statement, and the id prefixes, by dataset.
STATEMENT_FIELD = {"spider": "query", "spider_test": "query", "bird": "SQL"}
DEV_ID_PREFIX = {"spider": "spider_dev", "bird": "bird_dev", "spider_test": "spider_test"}
TRAIN_ID_PREFIX = {"spider": "spider_train_id_", "bird": "bird_train_id_"}


def _known(table: dict[str, str], dataset: str) -> str:
    if dataset not in table:
        raise ValueError(f"unknown dataset {dataset!r}, expected one of {sorted(table)}")
    return table[dataset]


def statement_field(dataset: str) -> str:
    return _known(STATEMENT_FIELD, dataset)


def dev_id(dataset: str, question_id: Column, ordinal: Column) -> Column:
    """Prefix and the given question id, else the row ordinal."""
    return F.concat_ws("_", F.lit(_known(DEV_ID_PREFIX, dataset)), F.coalesce(question_id, ordinal).cast("string"))


def train_id(dataset: str, given: Column, ordinal: Column) -> Column:
    usable = F.when(given != "", given)
    return F.concat(F.lit(_known(TRAIN_ID_PREFIX, dataset)), F.coalesce(usable, ordinal.cast("string")))


def attach_catalog(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Join on db_id by a shuffle; AQE splits a hot database. Not by broadcast: the names made of a
    catalog are many times the file that Spark goes by, and each task would hold those of all databases."""
    return samples.join(catalog.hint("merge"), "db_id")


def table_labels(tokens: Column, schema: Column) -> Column:
    return F.transform(schema, lambda t: F.array_contains(tokens, t["table_name_original"]).cast("int"))


def column_labels(tokens: Column, schema: Column) -> Column:
    """1 where the table is used and the column is named, bare or with its table."""
    def of_table(t: Column) -> Column:
        table = t["table_name_original"]
        used = F.array_contains(tokens, table)
        return F.transform(
            t["column_names_original"],
            lambda c: (
                used & (F.array_contains(tokens, c) | F.array_contains(tokens, F.concat_ws(".", table, c)))
            ).cast("int"),
        )

    return F.transform(schema, of_table)


def used_tables(schema: Column, labels: Column, by_column: Column) -> Column:
    """Ordered array of (table, columns) restricted to label 1."""
    zipped = F.arrays_zip(schema.alias("t"), labels.alias("used"), by_column.alias("cols"))

    def keep(z: Column) -> Column:
        return F.struct(
            z["t"]["table_name_original"].alias("table"),
            F.filter(z["t"]["column_names_original"], lambda _, i: F.get(z["cols"], i) == 1).alias("columns"),
        )

    return F.transform(F.filter(zipped, lambda z: z["used"] == 1), keep)


def schema_links(used: Column) -> Column:
    """For each used table its dotted columns, then the bare table."""
    return F.flatten(
        F.transform(
            used,
            lambda t: F.concat(
                F.transform(t["columns"], lambda c: F.concat_ws(".", t["table"], c)), F.array(t["table"])
            ),
        )
    )


def linked(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add labels and links to samples holding db_id and norm_sql."""
    joined = attach_catalog(samples, catalog).withColumn("_tokens", sqltext.blank_tokens(F.col("norm_sql")))
    schema = F.col("db_schema")
    return (
        joined.withColumn("table_labels", table_labels(F.col("_tokens"), schema))
        .withColumn("column_labels", column_labels(F.col("_tokens"), schema))
        .withColumn("used", used_tables(schema, F.col("table_labels"), F.col("column_labels")))
        .withColumn("schema_links", schema_links(F.col("used")))
        .drop("_tokens")
    )


def _statement(sql: Column, mode: str) -> Column:
    return F.lit("") if mode == "test" else sqltext.strip(sql)


def prepare(
    samples: DataFrame, catalog: DataFrame, mode: str = "train", alternative: str | None = None
) -> DataFrame:
    """Prepared samples from id, question, evidence, db_id, sql [, alternative statement].

    Mode `test` leaves every field that derives from a statement empty.
    """
    if mode not in ("train", "eval", "test"):
        raise ValueError(f"mode {mode!r} is not train, eval or test")
    second = F.coalesce(sqltext.strip(F.col(alternative)), F.lit("")) if alternative and mode != "test" else F.lit("")
    named = catalog.withColumn("_names", cat.maskable_names(F.col("db_schema")))
    base = samples.select(
        "id",
        sqltext.straighten_quotes(F.col("question")).alias("question"),
        "evidence",
        "db_id",
        _statement(F.col("sql"), mode).alias("sql"),
        second.alias("natsql"),
    )
    normal = base.withColumn("norm_sql", sqltext.normalize(F.col("sql"))).withColumn(
        "norm_natsql", sqltext.normalize(F.col("natsql"))
    )
    nothing = F.array().cast("array<string>")
    return linked(normal, named).select(
        "id", "question", "evidence", "db_id", "sql", "norm_sql",
        sqltext.skeleton(F.col("norm_sql"), F.col("_names")).alias("sql_skeleton"),
        "natsql", "norm_natsql",
        sqltext.skeleton(F.col("norm_natsql"), F.col("_names")).alias("natsql_skeleton"),
        "schema_links",
        F.lit(None).cast("string").alias("domain"),
        sqltext.tag_list(F.col("norm_sql")).alias("difficulty_type"),
        F.lit(None).cast("string").alias("spider_difficulty"),
        nothing.alias("sub_queries"),
        "db_schema", "pk", "fk", "table_labels", "column_labels",
    )


def retrieval_samples(prepared: DataFrame, new_id: Column) -> DataFrame:
    """Add the text of the full schema and of the used part; carry the other fields."""
    used = used_tables(F.col("db_schema"), F.col("table_labels"), F.col("column_labels"))
    return prepared.select(
        new_id.alias("id"), "question", "evidence", "sql", "sql_skeleton",
        cat.schema_text(cat.table_columns(F.col("db_schema"))).alias("db_schema_sequence"),
        cat.schema_text(used).alias("golden_schema_link_sequence"),
        "db_schema", "pk", "fk", "table_labels", "column_labels", "db_id", "domain", "difficulty_type",
    )
