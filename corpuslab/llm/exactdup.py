"""Exact duplicates: rows whose texts are the same but for white space.

Texts are grouped by a 128-bit hash of their normal form. A hash only proposes: texts of a hash that occurs
more than once are compared byte by byte, and should one hash stand for several texts, its rows are
grouped by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.joins import listed
from corpuslab.session import cut

WHITE = " \t\n\x0b\x0c\r"
#: Hex digits of the content hash: 128 bits.
DIGITS = 32


def normal(text: Column) -> Column:
    """Without the six white space characters of ASCII; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(digest: Column) -> Column:
    """The first 128 bits of a SHA-256 in hex."""
    return F.substring(digest, 1, DIGITS)


def _judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` (doc_id, chars, row and `keys`) with the row that stays of each key.

    One row a group and task is moved to find it, and only groups of several rows are joined back: by broadcast while
    they are few, else by a shuffle, where Spark splits a hot group."""
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    groups = cut(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), best).where("group_size > 1"))
    groups = groups.select(*[F.col(k).alias(f"{k}_") for k in keys], "group_size", "best")
    same = [rows[k] == groups[f"{k}_"] for k in keys]
    out = rows.join(listed(groups, 200_000), same, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), "text_sha256",
    )


def grouped(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", hashed=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normal form).

    Of equal texts the row with the most code points in its own text stays, then that of the smallest id
    (null ids last), then any one of the rows that are alike in both; just one row of a group is kept.
    Null texts are empty ones, and all empty texts are one group. An empty table gives an empty result. Other columns
    take no part, whatever their names. Texts are scanned for hashes, then those of repeated
    hashes once more; a task passes on each of its texts once, so a large group of copies costs a row a task.

    hashed: the content hash as a column of the text's SHA-256; another one serves to test collisions."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("own"), normal(F.col(column)).alias("norm"))
    texts = texts.select("doc_id", F.coalesce(F.length("own"), F.lit(0)).alias("chars"), "norm", F.sha2("norm", 256).alias("text_sha256")).withColumn("hash", hashed(F.col("text_sha256")))
    rows = cut(texts.drop("norm").withColumn("row", F.monotonically_increasing_id()))
    repeated = cut(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("again")))
    bytes_ = texts.select("hash", "norm").join(listed(repeated), F.col("hash") == F.col("again"), "left_semi").groupBy("hash", "norm").agg(F.lit(1).alias("one"))
    clashes = cut(bytes_.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("clash")))
    if clashes.isEmpty():
        return _judged(rows, ["hash"])
    clashing = F.col("hash") == F.col("clash")
    by_text = cut(texts.join(listed(clashes), clashing, "left_semi").withColumn("row", F.monotonically_increasing_id()))
    return _judged(rows.join(listed(clashes), clashing, "left_anti"), ["hash"]).unionByName(_judged(by_text, ["hash", "norm"]))
