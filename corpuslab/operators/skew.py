"""Equi-join whose hot keys are cut into blocks on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000


def blocked_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join on `keys`. A key with n rows on a side is cut into n / hot blocks there;
    each left block meets each right block once, so no task gets more than two blocks
    of a key, and no row is lost or repeated. Only keys beyond `hot` are listed."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
        return counts.select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias(name))

    sizes = blocks(left, "_nl").join(blocks(right, "_nr"), keys, "full_outer")

    def placed(df: DataFrame, row_id: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        sized = df.join(sizes, keys, "left")
        own_block = F.pmod(F.xxhash64(row_id), F.coalesce(own_n, F.lit(1))).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.coalesce(other_n, F.lit(1)) - 1))
        return sized.withColumn(own, own_block).withColumn(other, met).drop("_nl", "_nr")

    a = placed(left, left_id, "_lb", "_nl", "_rb", "_nr")
    b = placed(right, right_id, "_rb", "_nr", "_lb", "_nl")
    return a.join(b, [*keys, "_lb", "_rb"]).drop("_lb", "_rb")
