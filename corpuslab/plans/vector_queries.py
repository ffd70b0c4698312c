"""Registered queries over the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import coded
from corpuslab.operators import nearest as nn
from corpuslab.plans.registry import Tables, query


def as_queries(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")


def as_docs(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank")
    )


def sql_distance(metric: str, a: str = "q.v", b: str = "d.v") -> str:
    return {
        "l2": f"list_distance({a}, {b}) ** 2",
        "cosine": f"1 - list_cosine_similarity({a}, {b})",
        "ip": f"1 - list_inner_product({a}, {b})",
    }[metric]


def sql_ranking(metric: str = "l2", extra: str = "", condition: str = "") -> str:
    """CTEs: `vecs`, and `ranked` = every pair with its rank by (distance, doc_id)."""
    return f"""vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {sql_distance(metric)} AS distance {extra} FROM vecs q, vecs d {condition}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM pairs)"""


def sql_top(metric: str, k: int, condition: str = "") -> str:
    return f"""WITH {sql_ranking(metric, condition=condition)}
    SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= {k}"""


@query(sql_top("l2", 5))
def knn_l2(t: Tables) -> DataFrame:
    return rounded(nn.nearest(as_queries(t), as_docs(t), 5, "l2"))


@query(sql_top("cosine", 5))
def knn_cosine(t: Tables) -> DataFrame:
    return rounded(nn.nearest(as_queries(t), as_docs(t), 5, "cosine"))


@query(sql_top("ip", 5))
def knn_ip(t: Tables) -> DataFrame:
    return rounded(nn.nearest(as_queries(t), as_docs(t), 5, "ip"))


@query(sql_top("l2", 5, "WHERE d.label IN (1, 3, 5)"))
def knn_filtered(t: Tables) -> DataFrame:
    """Metadata filter before the search; it reaches the Parquet scan."""
    return rounded(nn.nearest(as_queries(t), as_docs(t).where(F.col("label").isin(1, 3, 5)), 5, "l2"))


@query(sql_top("l2", 5, "WHERE d.label = q.label"))
def knn_same_tag(t: Tables) -> DataFrame:
    """Only documents with the query's own tag compete."""
    return rounded(nn.nearest(as_queries(t), as_docs(t), 5, "l2", by=["label"]))


@query(sql_top("l2", 5))
def knn_pruned(t: Tables) -> DataFrame:
    """The same result by cells and bounds; see `nearest_pruned`."""
    return rounded(nn.nearest_pruned(as_queries(t), as_docs(t), 5, "l2", cells=32))


@query()
def knn_lsh(t: Tables) -> DataFrame:
    return rounded(nn.nearest_lsh(as_queries(t), as_docs(t), 5, 64, width=5.0, tables=40, hashes=14))


@query()
def knn_coded(t: Tables) -> DataFrame:
    """By codes of 16 bytes; 40 documents of each query are compared by their vectors."""
    return rounded(coded.nearest_coded(as_queries(t), as_docs(t), 5, "l2", rerank=40))
