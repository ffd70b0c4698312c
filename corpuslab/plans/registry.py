"""Registered queries and their SQL counterparts, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given Parquet tables of one scale folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def wide(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a table for costly row work: see `spread`."""
        table = getattr(self, name)
        return spread(table.select(*columns) if columns else table)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None):
    """Register `fn(tables)` under its own name."""
    def add(fn):
        key = fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[key] = oracle
        return fn

    return add
