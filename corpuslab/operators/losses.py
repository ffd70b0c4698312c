"""Ranking losses and training statistics as metrics over scored groups.

Groups: (group columns.., slot, score [, target]). A group has a bounded number of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log_sum_exp(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    w = Window.partitionBy(*group)
    high = F.max(column).over(w)
    return df.withColumn("_high", high).withColumn(
        name, F.log(F.sum(F.exp(F.col(column) - F.col("_high"))).over(w)) + F.col("_high")
    ).drop("_high")


def contrastive_ce(groups: DataFrame, group: list[str], slots: Column | None = None) -> DataFrame:
    """Cross entropy with the positive at slot 0, per group. `slots` restricts the
    competitors, e.g. to the positive and the easy negatives."""
    rows = groups if slots is None else groups.where((F.col("slot") == 0) | slots)
    return (
        _log_sum_exp(rows, group, "score", "_lse")
        .where("slot = 0")
        .select(*group, (F.col("_lse") - F.col("score")).alias("loss"))
    )


def easy_slots(nway: int, easy_nway: int) -> Column:
    return F.col("slot") >= nway - easy_nway


def listwise_kl(groups: DataFrame, group: list[str], alpha: float = 1.0) -> DataFrame:
    """KL of the target distribution from the score distribution, per group; both are
    softmax over the group, targets scaled by alpha first."""
    scaled = groups.withColumn("_t", F.col("target") * alpha)
    both = _log_sum_exp(_log_sum_exp(scaled, group, "_t", "_lt"), group, "score", "_ls")
    log_t, log_s = F.col("_t") - F.col("_lt"), F.col("score") - F.col("_ls")
    return both.groupBy(*group).agg(F.sum(F.exp(log_t) * (log_t - log_s)).alias("loss"))


def top1_rate(groups: DataFrame, group: list[str], first_of: tuple[str, int] | None = None) -> DataFrame:
    """Share of groups whose best-scored slot is the best target; ties by lower slot.
    `first_of` = (column, value) looks only at groups where the column has that value,
    such as the first of each batch."""
    rows = groups if first_of is None else groups.where(F.col(first_of[0]) == first_of[1])
    first = -F.col("slot")
    hits = rows.groupBy(*group).agg(
        F.max_by("slot", F.struct("score", first)).alias("a"), F.max_by("slot", F.struct("target", first)).alias("b")
    )
    return hits.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("top1_rate"), F.count("*").alias("n_groups"))


def score_margin(groups: DataFrame) -> DataFrame:
    """Mean score of slot 0, of slot 1, and the difference of the means rounded to 2."""
    mean = groups.agg(
        F.avg(F.when(F.col("slot") == 0, F.col("score"))).alias("positive"),
        F.avg(F.when(F.col("slot") == 1, F.col("score"))).alias("negative"),
    )
    return mean.withColumn("margin", F.round("positive", 2) - F.round("negative", 2))


def focal_loss(rows: DataFrame, sample: list[str], alpha: float, gamma: float = 0.5) -> DataFrame:
    """Weighted mean focal loss of two-class logits per sample, class weights
    [1 - alpha, alpha]. rows: sample columns, logit0, logit1, label."""
    high = F.greatest("logit0", "logit1")
    e0, e1 = F.exp(F.col("logit0") - high), F.exp(F.col("logit1") - high)
    prob = F.when(F.col("label") == 1, e1).otherwise(e0) / (e0 + e1)
    weight = F.when(F.col("label") == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    value = -F.pow(1 - prob, F.lit(gamma)) * F.log(prob + F.lit(1e-8))
    return (
        rows.select(*sample, weight.alias("_w"), value.alias("_v"))
        .groupBy(*sample)
        .agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("loss"))
    )


def classifier_loss(tables: DataFrame, columns: DataFrame, sample: list[str], alpha: float, gamma: float = 0.5) -> DataFrame:
    """Mean table loss plus mean column loss over the samples."""
    parts = focal_loss(tables, sample, alpha, gamma).withColumn("part", F.lit("table")).unionByName(
        focal_loss(columns, sample, alpha, gamma).withColumn("part", F.lit("column"))
    )
    mean = [F.avg(F.when(F.col("part") == p, F.col("loss"))).alias(f"{p}_loss") for p in ("table", "column")]
    return parts.agg(*mean).withColumn("loss", F.col("table_loss") + F.col("column_loss"))
