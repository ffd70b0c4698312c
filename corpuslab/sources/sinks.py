"""Writing samples, mined pairs, document dumps and prediction maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates documents in a dump; the two band names of the negatives.
DOCUMENT_GAP = "\n" * 5
NEGATIVE_BANDS = {"hard": "difficulty", "easy": "easy"}


def write_records(df: DataFrame, path: str, form: str = "json") -> None:
    """JSON lines or Parquet; both are written by all tasks and read back in parts."""
    df.write.mode("overwrite").format(form).save(path)


def _quoted(value: Column) -> Column:
    return F.to_json(F.array(value.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(value.cast("string")))) - 2)


def positive_line(query_id: Column, doc_id: Column, score: Column) -> Column:
    """`["q", ["d", score]]`"""
    return F.concat(F.lit("["), _quoted(query_id), F.lit(", ["), _quoted(doc_id), F.lit(", "), score.cast("string"), F.lit("]]"))


def write_positives(bands: DataFrame, path: str) -> None:
    rows = bands.where("band = 'pos'").select(positive_line(F.col("query_id"), F.col("doc_id"), F.col("score")).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_negatives(bands: DataFrame, path: str) -> None:
    """The sidecar of the positives: negatives by band, one row each."""
    bands.where(F.col("band").isin(*NEGATIVE_BANDS)).write.mode("overwrite").partitionBy("band").parquet(path)


def read_negatives(spark, path: str) -> DataFrame:
    """A missing sidecar is an error."""
    return spark.read.parquet(path)


def negative_map(bands: DataFrame) -> DataFrame:
    """One row per query with the id and score lists of both bands, in rank order."""
    def listed(band: str, field: str) -> Column:
        entry = F.when(F.col("band") == band, F.struct("rank", field))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda x: x[field])

    source = {"ids": "doc_id", "scores": "score"}
    return bands.where("band <> 'pos'").groupBy("query_id").agg(
        *[
            listed(band, field).alias(f"{name}_{suffix}")
            for band, name in NEGATIVE_BANDS.items()
            for suffix, field in source.items()
        ]
    )


def pos_neg_lines(rows: DataFrame) -> DataFrame:
    """(query_id, line): `["q", ["p", s], .., ["n", s], ..]`, positives first."""
    item = F.concat(F.lit("["), _quoted(F.col("doc_id")), F.lit(", "), F.col("score").cast("string"), F.lit("]"))
    place = F.struct((F.col("band") != "pos").alias("late"), "slot", item.alias("item"))
    parts = F.transform(F.array_sort(F.collect_list(place)), lambda x: x["item"])
    return rows.groupBy("query_id").agg(parts.alias("_p")).select(
        "query_id",
        F.concat(F.lit("["), F.array_join(F.concat(F.array(_quoted(F.col("query_id"))), F.col("_p")), ", "), F.lit("]")).alias("line"),
    )


def write_dump(documents: DataFrame, path: str, column: str = "document") -> None:
    documents.select(column).write.mode("overwrite").option("lineSep", DOCUMENT_GAP).text(path)


def write_prediction_map(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)
