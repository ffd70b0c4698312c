"""Retrieval, classification and statement-match metrics as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import sqltext
from corpuslab.functions.vectors import pair_distance
from corpuslab.operators import execution
from corpuslab.operators.catalog import maskable_names
from corpuslab.operators.linking import attach_catalog
from corpuslab.operators.ordering import running_totals
from corpuslab.session import cut

# Fixed values.
RECALL_DEPTHS = (5, 10)
MINI_DATABASES = ["wta_1", "poker_player", "world_1"]
DATASETS = ["spider", "bird"]
EMA_FACTOR = 0.999


def recall_at(evaluated: DataFrame, golden: DataFrame, text: str = "text", depths=RECALL_DEPTHS) -> DataFrame:
    """Mean number of evaluated items whose text is in the golden list, per depth.

    Both sides: query_id, rank, <text>; k = smaller depths come from the same lists by a
    filter on the rank. Repeated items count each time.
    """
    best = golden.groupBy("query_id", text).agg(F.min("rank").alias("golden_rank"))
    hits = evaluated.join(best, ["query_id", text], "left")
    per_query = hits.groupBy("query_id").agg(
        *[
            F.sum(((F.col("rank") <= k) & (F.coalesce("golden_rank", F.lit(k + 1)) <= k)).cast("double")).alias(f"recall_{k}")
            for k in depths
        ]
    )
    return per_query.agg(*[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in depths], F.count("*").alias("n_queries"))


def _with_distance(lists: DataFrame, queries: DataFrame, docs: DataFrame, metric: str) -> DataFrame:
    return (
        lists.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id")
        .join(docs.select("doc_id", F.col("vec").alias("_d")), "doc_id")
        .select("query_id", "rank", pair_distance(F.col("_q"), F.col("_d"), metric).alias("_x"))
    )


def mean_distance(lists: DataFrame, queries: DataFrame, docs: DataFrame, skip_first: bool = False, distance=None) -> DataFrame:
    """(query_id, mean) plain L2 distance of the query to its listed documents.

    `skip_first` drops the first neighbour, for queries that are in the collection.
    `distance` may replace the measure: a function of the squared distance column.
    """
    rows = lists.where("rank > 1") if skip_first else lists
    measure = distance or F.sqrt
    return _with_distance(rows, queries, docs, "l2").groupBy("query_id").agg(F.avg(measure(F.col("_x"))).alias("mean"))


def mean_cosine(lists: DataFrame, queries: DataFrame, docs: DataFrame, skip_first: bool = False) -> DataFrame:
    rows = lists.where("rank > 1") if skip_first else lists
    per_query = _with_distance(rows, queries, docs, "cosine").groupBy("query_id").agg(F.avg(1 - F.col("_x")).alias("c"))
    return per_query.agg(F.avg("c").alias("mean_cosine"))


def distance_gap(
    evaluated: DataFrame, golden: DataFrame, queries: DataFrame, docs: DataFrame, skip_first: bool = False
) -> DataFrame:
    """Mean distance of the golden list, of the evaluated list, and their difference."""
    g = mean_distance(golden, queries, docs, skip_first).withColumnRenamed("mean", "golden")
    e = mean_distance(evaluated, queries, docs, skip_first).withColumnRenamed("mean", "evaluated")
    both = g.join(e, "query_id")
    return both.agg(
        F.avg("golden").alias("golden_distance"),
        F.avg("evaluated").alias("evaluated_distance"),
        F.avg(F.col("evaluated") - F.col("golden")).alias("gap"),
    )


def epoch_number(run_name: Column) -> Column:
    """The number at the end of a run's name; runs are ordered by it."""
    return F.regexp_extract(run_name, r"_(\d+)$", 1).cast("int")


def epoch_sweep(evaluated: DataFrame, golden: DataFrame, queries: DataFrame, docs: DataFrame, depth: int = 5) -> DataFrame:
    """One result row per run of `evaluated` (which carries run_name): all runs in one job."""
    runs = _with_runs(evaluated.where(F.col("rank") <= depth), queries, docs)
    gold = mean_distance(golden.where(F.col("rank") <= depth), queries, docs).withColumnRenamed("mean", "golden")
    return (
        runs.join(gold, "query_id")
        .groupBy(epoch_number(F.col("run_name")).alias("epoch"))
        .agg(
            F.avg("golden").alias("golden_distance"),
            F.avg("evaluated").alias("evaluated_distance"),
            F.avg(F.col("evaluated") - F.col("golden")).alias("gap"),
            F.avg("cosine").alias("mean_cosine"),
        )
    )


def _with_runs(evaluated: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    pairs = (
        evaluated.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id")
        .join(docs.select("doc_id", F.col("vec").alias("_d")), "doc_id")
    )
    measured = pairs.select(
        "run_name", "query_id", pair_distance(F.col("_q"), F.col("_d"), "l2").alias("_l2"),
        pair_distance(F.col("_q"), F.col("_d"), "cosine").alias("_cosine"),
    )
    return measured.groupBy("run_name", "query_id").agg(
        F.avg(F.sqrt("_l2")).alias("evaluated"), F.avg(1 - F.col("_cosine")).alias("cosine")
    )


def prediction_map(lists: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ids): the k listed ids in rank order."""
    return lists.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids")
    )


def ema(rows: DataFrame, key: str, order: list[str], value: str, factor: float = EMA_FACTOR) -> DataFrame:
    """Last exponential moving average per key, seeded with the first value.

    A stretch of consecutive values x_1..x_n acts on an average a as
    a * f**n + (1-f) * sum f**(n-i) x_i, and such effects compose. Rows are range-sorted by
    (key, order), each Arrow batch is reduced to one effect per key, and the few effects
    are composed in order; a key of any size is spread over many tasks.
    """
    sorted_rows = rows.select(key, *order, value).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    key_type = rows.schema[key].dataType.simpleString()
    order_ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in order)

    def reduce_batches(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf.groupby(key, sort=False)[value].transform("size")
            place = pdf.groupby(key, sort=False).cumcount()
            weighted = pdf[value] * factor ** (size - 1 - place)
            parts = pdf.groupby(key, sort=False)
            out = parts[[*order]].first()
            out["n"] = parts.size()
            out["first_value"] = parts[value].first()
            out["effect"] = weighted.groupby(pdf[key], sort=False).sum()
            yield out.reset_index()

    effects = sorted_rows.mapInPandas(
        reduce_batches, f"{key} {key_type}, {order_ddl}, n bigint, first_value double, effect double"
    )
    later = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = effects.withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return placed.groupBy(key).agg(
        F.sum("n").alias("n"),
        (
            F.min_by("first_value", F.struct(*order)) * F.pow(F.lit(factor), F.sum("n"))
            + (1 - factor) * F.sum(F.col("effect") * F.pow(F.lit(factor), F.col("_later")))
        ).alias("ema"),
    )


def classification_report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, f1 and support of both classes, accuracy, macro and weighted
    averages; one pass of conditional sums."""
    def both(y: int, p: int) -> Column:
        return F.sum(((F.col(label) == y) & (F.col(prediction) == p)).cast("bigint"))

    c = rows.agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))

    def over(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    per_class = {}
    for name, hit, false, missed in (("positives", tp, fp, fn), ("negatives", tn, fn, fp)):
        precision, recall = over(hit, hit + false), over(hit, hit + missed)
        per_class[name] = (precision, recall, over(2 * hit, 2 * hit + false + missed), (hit + missed).cast("double"))
    total = (tp + fp + fn + tn).cast("double")
    pos, neg = per_class["positives"], per_class["negatives"]
    accuracy = over(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(pos[:3], neg[:3])]
    weighted = [over(a * pos[3] + b * neg[3], total) for a, b in zip(pos[:3], neg[:3])]
    lines = [
        ("negatives", *neg), ("positives", *pos), ("accuracy", accuracy, accuracy, accuracy, total),
        ("macro avg", *macro, total), ("weighted avg", *weighted, total),
    ]
    names = ("precision", "recall", "f1", "support")
    structs = [F.struct(F.lit(n).alias("row"), *[v.alias(k) for k, v in zip(names, vs)]) for n, *vs in lines]
    return c.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counted half. Equal scores are combined first; the
    running count goes through range buckets, not through one task."""
    by_score = rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg")
    )
    ranked = running_totals(by_score, "score", ["neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below").cast("double") + F.col("neg").cast("double") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg((won / pairs).alias("auc"))


def register_golds(samples: DataFrame, catalog_raw: DataFrame) -> DataFrame:
    """Gold records: statement, question, database, tags and the catalog's arrays."""
    arrays = catalog_raw.select(
        "db_id",
        F.col("table_names_original").alias("db_table_names"),
        F.transform("column_names_original", lambda c: c[0].cast("int")).alias("table_id"),
        F.transform("column_names_original", lambda c: c[1]).alias("column_name"),
        F.col("column_types").alias("db_column_types"),
        F.flatten("primary_keys").alias("db_primary_keys"),
        F.transform("foreign_keys", lambda k: k[0]).alias("column_id"),
        F.transform("foreign_keys", lambda k: k[1]).alias("other_column_id"),
    )
    return samples.join(arrays, "db_id")


def exact_match(pairs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Per pair (gold, prediction): `exact`, equal normal forms, and, given the catalogs of
    the pairs' databases, `same_skeleton`."""
    normal = pairs.withColumn("_gold", sqltext.normalize(F.col("gold"))).withColumn(
        "_prediction", sqltext.normalize(F.col("prediction"))
    )
    if catalog is not None:
        names = catalog.select("db_id", maskable_names(F.col("db_schema")).alias("_names"))
        skeletons = [sqltext.skeleton(F.col(c), F.col("_names")) for c in ("_gold", "_prediction")]
        normal = attach_catalog(normal, names).withColumn("same_skeleton", skeletons[0] == skeletons[1]).drop("_names")
    return normal.withColumn("exact", F.col("_gold") == F.col("_prediction")).drop("_gold", "_prediction")


def result_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row `match`: the two results hold the same rows equally often, whatever the
    column names. Different numbers of columns never match."""
    if len(a.columns) != len(b.columns):
        return a.sparkSession.range(1).select(F.lit(False).alias("match"))
    names = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*names).withColumn("_side", F.lit(1)).unionAll(b.toDF(*names).withColumn("_side", F.lit(-1)))
    uneven = both.groupBy(*names).agg(F.sum("_side").alias("d")).where("d <> 0")
    return uneven.agg((F.count("*") == 0).alias("match"))


def execution_match(spark, statements: list[tuple], tables: dict[str, str]) -> DataFrame:
    """(id, match) of a short list of (id, gold, prediction) over `tables` (name: Parquet path); tables of
    predictions go to `execution.execution_match` themselves."""
    pairs = spark.createDataFrame(statements, "id string, gold string, prediction string").withColumn("db_id", F.lit("db"))
    return execution.execution_match(pairs, {"db": tables}).select("id", "match")


def accuracy_by(rows: DataFrame, correct: str = "correct", tags: str = "tags", level: str = "hardness") -> DataFrame:
    """Correct and total counts per tag, per tag combination and per hardness. Rows with
    a negative turn_idx do not count."""
    if "turn_idx" in rows.columns:
        rows = rows.where(F.coalesce("turn_idx", F.lit(0)) >= 0)
    # A row per combination of tags and level, used four times below.
    slim = cut(
        rows.groupBy(F.col(tags).alias("tags"), F.col(level).alias("hardness")).agg(
            F.sum(F.col(correct).cast("bigint")).alias("correct"), F.count("*").alias("total")
        )
    )
    kinds = {
        "tag": F.explode("tags"),
        "tags": F.array_join("tags", "+"),
        "hardness": F.col("hardness"),
        "all": F.lit("all"),
    }
    parts = [
        slim.select(F.lit(kind).alias("kind"), value.alias("value"), "correct", "total")
        .groupBy("kind", "value")
        .agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
        for kind, value in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def wrong_rows(rows: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    return rows.where(~F.col(correct)).select(key)


def merge_metrics(*tables: DataFrame) -> DataFrame:
    """One-row metric tables with names of their own, side by side in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def filtered_samples(
    samples: DataFrame, db_ids: list | None = None, difficulty_types: list[str] | None = None,
    domains: list[str] | None = None, mini_test: bool = False, must_exist: bool = False,
) -> DataFrame:
    """Samples of given databases, tags and domains. `mini_test` is a preset of three
    databases; `must_exist` makes an empty result an error."""
    out = samples
    if mini_test:
        db_ids = MINI_DATABASES
    if db_ids is not None:
        out = out.where(F.col("db_id").isin(db_ids))
    if difficulty_types is not None:
        out = out.where(F.arrays_overlap("difficulty_type", F.array(*[F.lit(d) for d in difficulty_types])))
    if domains is not None:
        out = out.where(F.col("domain").isin(domains))
    if must_exist and out.isEmpty():
        raise ValueError("no sample matches the filters")
    return out
