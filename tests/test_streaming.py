"""The moving average over a stream against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluate
from corpuslab.streaming.average import moving_average

SCHEMA = "k string, at timestamp, tie long, x double"


def run(spark, source, place):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{source}/*.json")
    out = moving_average(rows, "k", "at", "tie", "x", "60 seconds", factor=0.9)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/out").trigger(availableNow=True).start()
    query.awaitTermination()


def test_moving_average(spark, tmp_path):
    """Values out of order within the bound, dealt to files; stopped and gone on from the checkpoint."""
    rng, rows = random.Random(5), []
    for i in range(400):
        second = i + rng.randint(0, 40)
        rows.append((rng.choice("abbb"), f"2024-01-01T00:{second // 60:02}:{second % 60:02}.{rng.choice([0, 0, 250])}Z", i, None if i % 29 == 0 else rng.random()))
    source = tmp_path / "in"
    source.mkdir()

    def write(name, part):
        import json

        (source / f"{name}.json").write_text("".join(json.dumps(dict(zip(("k", "at", "tie", "x"), r))) + "\n" for r in part))

    for i in range(3):
        write(i, rows[100 * i : 100 * i + 100])
    run(spark, str(source), str(tmp_path))
    early = {r.k: r.n for r in spark.read.parquet(f"{tmp_path}/out").groupBy("k").agg(F.max("n").alias("n")).collect()}
    assert 0 < sum(early.values()) < 300
    write(3, rows[300:])
    write(4, [("end", "2024-01-01T02:00:00Z", 0, 1.0)])
    run(spark, str(source), str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.groupBy("k", "n").count().where("count > 1").isEmpty()
    last = {r.k: (r.n, r.ema) for r in got.groupBy("k").agg(F.max("n").alias("n"), F.max_by("ema", "n").alias("ema")).collect()}
    batch = spark.read.schema(SCHEMA).json(str(source)).where("x IS NOT NULL AND k <> 'end'")
    want = {r.k: (r.n, r.ema) for r in evaluate.ema(batch, "k", ["at", "tie"], "x", 0.9).collect()}
    assert set(last) == set(want)
    for k, (n, average) in want.items():
        assert last[k][0] == n and last[k][1] == pytest.approx(average, rel=1e-12)
