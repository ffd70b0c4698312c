"""Session helpers: a local builder for tests and benches, and the shared work folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A scan below this size may be dealt out again: so much is shuffled at most.
SMALL_SCAN = 64 << 20


def local_session(cores: str | int = "*", app: str = "corpuslab") -> SparkSession:
    """Session for tests and local benches. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLAB_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for this application's intermediate tables: under
    `spark.checkpoint.dir` as the cluster names it, or, where that is unset, under the warehouse. A
    warehouse on the driver's own disk is refused on a cluster, where executors do not see it."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        if folder.startswith(("file:", "/")) and not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/corpuslab-{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that are not yet written need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there. The result outlives the
    loss of executors, is computed once however often it is used, and has a known size."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals out a small table, of `SMALL_SCAN` bytes at most by Spark's own estimate, before costly
    row work. One small file is one split, which would be one task; what is shuffled is bounded,
    and any larger scan is left as its splits are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_SCAN else df
