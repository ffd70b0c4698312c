"""Execution match of a table of predictions: statements are run, results compared by fingerprints.

A statement's result is one row: its number of columns and rows, and two sums of hashes of its rows. Sums do not
depend on the order of rows, and equal rows count as often as they occur. Each distinct statement of a database
runs once, however many pairs hold it; pairs are then judged by joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from concurrent.futures import FIRST_COMPLETED as FIRST
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.session import new_folder

#: Statements of one job, jobs at a time, and fingerprints up to which the judging joins are broadcast.
STATEMENTS_A_JOB, JOBS, FEW = 16, 4, 20_000
FINGERPRINT = "db_id string, statement string, ok boolean, width int, n_rows long, low decimal(38,0), high decimal(38,0)"


def is_plain_query(spark: SparkSession, statement: str) -> bool:
    """Whether a statement parses as a query and holds no command or change of data."""
    types = [
        spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
        for name in ("Command", "ParsedStatement")
    ]

    def plain(plan) -> bool:
        if any(t.isInstance(plan) for t in types):
            return False
        children = plan.children()
        return all(plain(children.apply(i)) for i in range(children.size()))

    try:
        return plain(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))
    except Exception:  # noqa: BLE001  a statement that is no SQL
        return False


def comparable(value: Column, kind: T.DataType) -> Column:
    """A value as text that is the same for equal numbers of any type; null and 'null' differ."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(whole, F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("double").cast("string"))
    elif isinstance(kind, T.DecimalType) and kind.scale > 0:
        text = F.regexp_replace(value.cast("string"), r"\.?0+$", "")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(F.struct(value))
    elif isinstance(kind, T.BinaryType):
        text = F.hex(value)
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(""))


def fingerprint(result: DataFrame, db_id: str, statement: str) -> DataFrame:
    """The one row that stands for a result."""
    fields = result.schema.fields
    named = result.toDF(*[f"c{i}" for i in range(len(fields))])
    row = F.array(*[comparable(F.col(f"c{i}"), f.dataType) for i, f in enumerate(fields)])
    hashes = named.select(F.xxhash64(row).alias("low"), F.xxhash64(F.lit(1), row).alias("high"))
    total = {c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("low", "high")}
    return hashes.agg(F.count("*").alias("n_rows"), *total.values()).select(
        F.lit(db_id).alias("db_id"), F.lit(statement).alias("statement"), F.lit(True).alias("ok"), F.lit(len(fields)).alias("width"), "n_rows", "low", "high"
    )


class Runner:
    """Runs statements of databases (db_id: {table: Parquet path}) and writes their fingerprints.

    Each database has a session of its own for its views, so that none of the caller's is replaced."""

    def __init__(self, spark: SparkSession, databases: dict[str, dict[str, str]]):
        self.spark, self.databases, self.folder = spark, databases, new_folder(spark, "fingerprints")
        self.sessions: dict[str, SparkSession] = {}

    def session(self, db_id: str) -> SparkSession:
        if db_id not in self.sessions:
            apart = self.spark.newSession()
            for name, path in self.databases[db_id].items():
                apart.read.parquet(path).createOrReplaceTempView(name)
            self.sessions[db_id] = apart
        return self.sessions[db_id]

    def planned(self, db_id: str, statement: str) -> DataFrame | None:
        """The fingerprint as a plan; None if the statement is no plain query over the tables."""
        if db_id not in self.databases:
            return None
        apart = self.session(db_id)
        if not is_plain_query(apart, statement):
            return None
        try:
            return fingerprint(apart.sql(statement), db_id, statement)
        except Exception:  # noqa: BLE001  unknown names, types that don't fit
            return None

    def run(self, batch: list[tuple[str, str]], place: str) -> None:
        """One job for many statements of one database. Where one of them fails while it runs, halves are run again, so that it fails alone."""
        planned = [(key, self.planned(*key)) for key in batch]
        good = [x for x in planned if x[1] is not None]
        if bad := [key for key, plan in planned if plan is None]:
            self.failed(bad, f"{place}-none")
        self.together(good, place)

    def together(self, good: list[tuple[tuple[str, str], DataFrame]], place: str) -> None:
        if not good:
            return
        try:
            reduce(DataFrame.unionAll, [plan for _, plan in good]).coalesce(1).write.parquet(f"{self.folder}/{place}")
        except Exception:  # noqa: BLE001  whose failure it is, the halves tell
            if len(good) == 1:
                self.failed([good[0][0]], f"{place}-failed")
                return
            half = len(good) // 2
            self.together(good[:half], f"{place}a")
            self.together(good[half:], f"{place}b")

    def failed(self, keys: list[tuple[str, str]], place: str) -> None:
        rows = [(db_id, statement, False, None, None, None, None) for db_id, statement in keys]
        self.spark.createDataFrame(rows, FINGERPRINT).coalesce(1).write.parquet(f"{self.folder}/{place}")

    def run_all(self, statements: Iterable[tuple[str, str]], jobs: int) -> int:
        """Batches of statements, which come ordered by database, `jobs` at a time."""
        many = 0
        with ThreadPoolExecutor(jobs) as pool:
            running: set = set()
            for i, batch in enumerate(batches(iter(statements))):
                for db_id in {d for d, _ in batch if d in self.databases}:
                    self.session(db_id)  # before threads ask for it
                many += len(batch)
                running.add(pool.submit(self.run, batch, f"{i:08d}"))
                while len(running) >= jobs:
                    done, running = wait(running, return_when=FIRST)
                    for f in done:
                        f.result()
            for f in running:
                f.result()
        return many


def batches(statements: Iterator[tuple[str, str]], size: int = STATEMENTS_A_JOB) -> Iterator[list[tuple[str, str]]]:
    """Runs of at most `size` statements of one database."""
    held: list[tuple[str, str]] = []
    while part := list(islice(statements, size)):
        for key in part:
            if held and (len(held) == size or held[0][0] != key[0]):
                yield held
                held = []
            held.append(key)
    if held:
        yield held


def execution_match(pairs: DataFrame, databases: dict[str, dict[str, str]], gold: str = "gold", prediction: str = "prediction", db_id: str = "db_id", jobs: int = JOBS) -> DataFrame:
    """`pairs` with match: gold and prediction, run over the tables of the pair's database, give the same rows equally often,
    whatever the order and the column names. Equal numbers of any type are equal.

    Predictions are not trusted: only plain queries are run, and one that fails, also while it runs, or is null,
    matches nothing. A gold statement that fails is an error, unless no pair has it. Statements come to the driver one by
    one, as running SQL text needs; their results do not. The time is that of the distinct statements; pairs, however many,
    are joined with the fingerprints."""
    spark = pairs.sparkSession
    if pairs.columns and "match" in pairs.columns:
        pairs = pairs.drop("match")
    keys = [F.col(db_id).alias("db_id"), F.explode(F.array(gold, prediction)).alias("statement")]
    wanted = pairs.select(*keys).where("statement IS NOT NULL").distinct().orderBy("db_id", "statement")
    runner = Runner(spark, databases)
    many = runner.run_all(((r.db_id, r.statement) for r in wanted.toLocalIterator()), jobs)
    if not many:
        return pairs.withColumn("match", F.lit(False))
    prints = spark.read.schema(FINGERPRINT).parquet(f"{runner.folder}/*")
    if many <= FEW:
        prints = F.broadcast(prints)

    def side(name: str) -> DataFrame:
        return prints.select(F.col("db_id").alias(f"_{name}_db"), F.col("statement").alias(f"_{name}_text"), F.struct("ok", "width", "n_rows", "low", "high").alias(f"_{name}"))

    judged = pairs
    for name, column in (("gold", gold), ("prediction", prediction)):
        right = side(name)
        judged = judged.join(right, pairs[db_id].eqNullSafe(right[f"_{name}_db"]) & (pairs[column] == right[f"_{name}_text"]), "left").drop(f"_{name}_db", f"_{name}_text")
    fails = prints.where("NOT ok").select(F.col("db_id").alias("_d"), F.col("statement").alias("_s"))
    wrong = pairs.join(fails, pairs[db_id].eqNullSafe(fails["_d"]) & (pairs[gold] == fails["_s"])).select("_s").limit(5).collect()
    if wrong:
        raise ValueError(f"gold statements fail: {[r._s for r in wrong]}")
    same = F.col("_prediction.ok") & F.col("_gold").eqNullSafe(F.col("_prediction"))
    return judged.withColumn("match", F.coalesce(same, F.lit(False))).drop("_gold", "_prediction")
