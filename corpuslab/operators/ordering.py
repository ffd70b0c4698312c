"""Dense row numbers over whole tables without a single-task window.

A plain row_number over everything collapses to one task. Here rows fall into many
ordered buckets, are numbered inside their bucket, and get the number of rows of all
lower buckets added, from a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import cut


def order_key(seed: str, *columns) -> Column:
    """Deterministic random order: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


def _lower_buckets(counts: DataFrame, bucket: str) -> DataFrame:
    """Rows in all lower buckets; `counts` has one row per bucket, of bounded number."""
    w = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(bucket, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_below"))


def hashed_ordinal(df: DataFrame, columns: list[str], seed: str, name: str = "ordinal", digits: int = 3) -> DataFrame:
    """0-based position in md5 order. The first hex digits of the key are the bucket:
    they follow the order and are evenly filled whatever the data. 16**digits buckets;
    five digits suit 10**11 rows."""
    keyed = df.withColumn("_key", order_key(seed, *columns)).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("n"))
    # One row per bucket, at most 16**digits, so the broadcast is bounded.
    below = F.broadcast(_lower_buckets(counts, "_bucket"))
    w = Window.partitionBy("_bucket").orderBy("_key", *columns)
    return (
        keyed.join(below, "_bucket")
        .withColumn(name, F.col("_below") + F.row_number().over(w) - 1)
        .drop("_key", "_bucket", "_below")
    )


def sorted_ordinal(df: DataFrame, columns: list, name: str = "ordinal") -> DataFrame:
    """0-based position in the order of `columns`, which must be unique.

    A range sort spreads the rows; the engine's increasing id holds (partition, place).
    The sorted rows are written out so that both uses below see the same partitions.
    """
    placed = cut(df.orderBy(*columns).withColumn("_mid", F.monotonically_increasing_id()))
    return _dense(placed, name)


def file_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """0-based position of rows read from text-like files: by path, place of the split
    in the file, and place in the split. No row is moved."""
    split = F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"))
    tagged = df.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_mid"))
    counts = tagged.groupBy("_split").agg(F.count("*").alias("n"), F.min("_mid").alias("_first"))
    below = _lower_buckets(counts, "_split").join(counts.select("_split", "_first"), "_split")
    return (
        tagged.join(below, "_split")
        .withColumn(name, F.col("_below") + F.col("_mid") - F.col("_first"))
        .drop("_split", "_mid", "_below", "_first")
    )


def _dense(placed: DataFrame, name: str) -> DataFrame:
    tagged = placed.withColumn("_pid", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("n"))
    # One row per partition of the sort.
    below = F.broadcast(_lower_buckets(counts, "_pid"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.join(below, "_pid").withColumn(name, F.col("_below") + place).drop("_mid", "_pid", "_below")
    )


def running_totals(df: DataFrame, order: str, values: list[str], buckets: int = 512) -> DataFrame:
    """Totals of `values` over all rows with a smaller `order` value, as `<name>_below`.

    `order` must be unique (aggregate first). Bucket bounds come from approximate
    quantiles, a bounded list of numbers; any bounds give the right result.
    """
    from pyspark.ml.feature import Bucketizer

    cuts = df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket").transform(
        df.withColumn("_x", F.col(order).cast("double"))
    )
    totals = placed.groupBy("_bucket").agg(*[F.sum(v).alias(v) for v in values])
    across = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket.
    lower = F.broadcast(
        totals.select("_bucket", *[F.coalesce(F.sum(v).over(across), F.lit(0)).alias(f"_{v}") for v in values])
    )
    within = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(lower, "_bucket")
    for v in values:
        out = out.withColumn(f"{v}_below", F.col(f"_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)))
    return out.drop("_x", "_bucket", *[f"_{v}" for v in values])
