"""Few-shot example selection strategies, all on top of the nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.documents import doc_text, document, query_text
from corpuslab.functions.vectors import metric_of, pair_distance
from corpuslab.operators import interaction, mining
from corpuslab.operators import nearest as nn
from corpuslab.operators.embed import embed, word_token_vectors
from corpuslab.session import cut


def select_random(queries: DataFrame, docs: DataFrame, n: int, seed: str) -> DataFrame:
    drawn = mining.draw(queries.withColumn("draw_id", F.col("query_id").cast("string")), docs, n, seed)
    return drawn.select("query_id", "doc_id", F.col("pick").alias("rank"))


def select_similar(
    queries: DataFrame, docs: DataFrame, n: int, metric: str = "l2", same: list[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Nearest by vector. `same` keeps to documents with equal columns, such as the type
    tags of the gold or of the predicted statement; `where` filters the documents."""
    return nn.nearest(queries, docs if where is None else docs.where(where), n, metric, by=same)


def select_examples(
    samples: DataFrame, pool: DataFrame, n: int, fields: str = "SQL", similarity: str = "EUCLIDEAN",
    statement: str = "sql", same_type: str | None = None, encoder: str | Callable = "default",
    big: int | None = None, second: Callable[[DataFrame], DataFrame] | None = None, descending: bool = False,
) -> DataFrame:
    """Ranked examples (query_id, doc_id, distance, rank) from `pool` for each sample.

    fields      what is embedded on both sides: question, statement, both, full, ..
    similarity  EUCLIDEAN, COSINE or IP
    statement   the samples' column that stands for the statement: gold or predicted
    same_type   the samples' column of type tags (gold or predicted) that must equal the
                pool's difficulty_type
    big, second retrieve `big` first, then order by the added column `second`, keep n
    """
    metric = metric_of(similarity)
    text = document(fields)

    def side(df: DataFrame, name: str, tags: str) -> DataFrame:
        extra = [F.array_join(tags, "+").alias("type")] if same_type else []
        texts = df.select(F.col("id").alias(name), text.alias("_text"), *extra)
        return cut(embed(texts, "_text", encoder).drop("_text"))

    asked = samples if statement == "sql" else samples.withColumn("sql", F.col(statement))
    queries = side(asked, "query_id", same_type or "")
    docs = side(pool, "doc_id", "difficulty_type")
    by = ["type"] if same_type else None
    if big is None:
        return nn.nearest(queries, docs, n, metric, by=by)
    return resort(second(nn.nearest(queries, docs, big, metric, by=by).drop("rank")), n, descending)


def resort(candidates: DataFrame, n: int | None = None, descending: bool = False) -> DataFrame:
    """Order a small list per query by its `second` score; ties by doc_id. Keep n."""
    second = F.col("second").desc() if descending else F.col("second")
    w = Window.partitionBy("query_id").orderBy(second, "doc_id")
    out = candidates.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.where(F.col("rank") <= n)


def second_distance(candidates: DataFrame, queries: DataFrame, docs: DataFrame, metric: str) -> DataFrame:
    """Attach `second`, the distance of each candidate in another vector space."""
    return (
        candidates.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id")
        .join(docs.select("doc_id", F.col("vec").alias("_d")), "doc_id")
        .withColumn("second", pair_distance(F.col("_q"), F.col("_d"), metric))
        .drop("_q", "_d")
    )


def select_two_stage(
    queries: DataFrame, docs: DataFrame, big: int, small: int,
    second: Callable[[DataFrame], DataFrame], metric: str = "l2", descending: bool = False,
) -> DataFrame:
    """Retrieve `big`, score again by `second` (adds a column of that name), keep `small`."""
    wide = nn.nearest(queries, docs, big, metric).drop("rank")
    return resort(second(wide), small, descending)


def rerank_by_text(
    samples: DataFrame, pool: DataFrame, n: int, left: str = "question", right: str = "sql", dataset: str = "spider",
    big: int | None = None, type_tags: str | None = None, statement: str = "sql",
    tokens: Callable[[DataFrame, str, str], DataFrame] = word_token_vectors, encoder: str | Callable = "default",
) -> DataFrame:
    """Ranked examples (query_id, doc_id, score, rank) by late interaction between the
    `left` text of each sample and the `right` text of the pool.

    The whole pool competes, or with `big` the nearest by text vectors. `type_tags` names the samples' column
    of predicted type tags that the pool's difficulty_type must equal. `tokens` encodes
    a text as (id, pos, vec [, keep]); `statement` is the gold or predicted one.
    """
    check_rerank_formats(left, right, dataset, type_tags is not None)
    asked = samples if statement == "sql" else samples.withColumn("sql", F.col(statement))

    def side(df: DataFrame, name: str, text: Column, tags: str) -> DataFrame:
        extra = [F.array_join(tags, "+").alias("type")] if type_tags else []
        return cut(df.select(F.col("id").alias(name), text.alias("_text"), *extra))

    queries = side(asked, "query_id", query_text(left), type_tags or "")
    docs = side(pool, "doc_id", doc_text(right), "difficulty_type")
    by = ["type"] if type_tags else None

    def with_type(df: DataFrame, source: DataFrame, name: str) -> DataFrame:
        return df.join(source.select(name, "type"), name) if by else df

    q, d = (tokens(s, name, "_text") for s, name in ((queries, "query_id"), (docs, "doc_id")))
    if big is None:
        return interaction.rerank_all(with_type(q, queries, "query_id"), with_type(d, docs, "doc_id"), n, by=by)
    vectors = [cut(embed(s, "_text", encoder).drop("_text")) for s in (queries, docs)]
    wide = cut(nn.nearest(*vectors, big, by=by).select("query_id", "doc_id"))
    return interaction.best_by_maxsim(interaction.maxsim(wide, q, d), n)


# The text formats a reranker accepts on each side.
RERANK_FORMATS = {
    ("question", "sql"), ("question", "question_sql"), ("question_sql", "sql"), ("question_sql", "question_sql"),
    ("question_evidence", "sql"), ("question_evidence_sql", "sql"),
}
FILTERABLE_FORMATS = {("question", "sql"), ("question_sql", "sql")}
EVIDENCE_DATASET = "bird"


def check_rerank_formats(left: str, right: str, dataset: str, type_filter: bool = False) -> None:
    if (left, right) not in RERANK_FORMATS:
        raise ValueError(f"no reranker from {left!r} to {right!r}")
    if "evidence" in left and dataset != EVIDENCE_DATASET:
        raise ValueError(f"only {EVIDENCE_DATASET!r} samples carry evidence")
    if type_filter and (left, right) not in FILTERABLE_FORMATS:
        raise ValueError(f"no type filter from {left!r} to {right!r}")
