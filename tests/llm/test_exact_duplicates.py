"""Exact duplicates against a plain grouping of whole texts."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from corpuslab.llm import exactdup
from corpuslab.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string"


def slow(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        left = True
        for m in members:
            out.append((m[2], best[2], len(members), left and m == best, hashlib.sha256(norm.encode()).hexdigest()))
            left = left and m != best
    return out


def same(got, rows):
    assert sorted(map(repr, map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))) == sorted(map(repr, slow(rows)))


def test_query(spark, folder):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    same(QUERIES["op12_exact_duplicates"](spark, folder), rows)


ODD = [
    (1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \r\x0b\x0c"), (7, "a\xa0b"), (8, "é x"), (9, "éx"), (None, "ab "), (None, None),
    (10, "long " * 200_000), (11, "long" * 200_000), (12, "a\x1cb"), (1, "a b"), (1, "a b"), (13, "A B"),
]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD * 2 + [(50, "hot text")] * 400 + [(i, "hot  text") for i in range(40, 70)], SCHEMA).repartition(7)
    for name in ("own", "norm", "hash", "row", "n", "kept", "group_size", "again", "clash"):
        df = df.withColumn(name, F.lit(1))
    same(exactdup.grouped(df), ODD * 2 + [(50, "hot text")] * 400 + [(i, "hot  text") for i in range(40, 70)])
    same(exactdup.grouped(df.limit(0)), [])


def test_collisions(spark):
    """Hashes of one digit: all groups clash, and texts alone decide."""
    rows = ODD + [(100 + i, f"text {i % 60}" + " " * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(exactdup.grouped(df, hashed=lambda digest: F.substring(digest, 1, 1)), rows)
    same(exactdup.grouped(df, hashed=lambda digest: F.lit("")), rows)
