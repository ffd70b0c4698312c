"""Vector codes against plain search over all entries, with Python's integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import vectorcodes
from corpuslab.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def slow(rows, parts=16, entries=64, rounds=2):
    """Per row (vec_id, label, code, error), and the codebooks."""
    fine = [(i, [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(fine[0][1]) // parts if fine else 0
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in fine:
                part = v[p * width : (p + 1) * width]
                groups.setdefault(near(part, books[p])[1], []).append(part)
            books[p] = [[sum(xs) // len(xs) for xs in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for i, v, lab in fine:
        got = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in got), min(sum(d for d, _ in got), 2**63 - 1)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def same(got, rows, **sizes):
    want, sha = slow(rows, **sizes)
    by_label = {}
    for _, lab, _, error in want:
        by_label[lab] = min(by_label.get(lab, 0) + error, 2**63 - 1)
    assert sorted(map(repr, ((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got))) == sorted(map(repr, ((*w, by_label[w[1]]) for w in want)))
    assert {r.codebooks_sha256 for r in got} <= {sha}


def test_query(spark, folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{folder}/embeddings.parquet'").fetchall()
    got = QUERIES["op11_vector_codes"](spark, folder)
    labels = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label")
    same(got.join(labels, "vec_id").collect(), rows)


def test_search_is_exact():
    rng = np.random.default_rng(3)
    for width, spread in ((1, 2), (3, 4), (4, 300), (8, 1)):
        parts, book = rng.integers(-spread, spread + 1, (400, width)), rng.integers(-spread, spread + 1, (37, width))
        book[5], book[9] = book[30], book[30]  # ties
        for kind in (np.int64, object):
            entry, far = vectorcodes.nearest_entries(parts.astype(kind), book.astype(kind))
            all_ = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
            assert (entry == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()


def test_nulls_ties_and_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i % 90 if i % 7 else None, [float(i * k % 11) / 256 - 0.02 for k in range(8)], i % 3 or None) for i in range(200)]
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [nan] * 8, None), (503, [inf] + [0.0] * 7, 2), (504, [1.0] * 7 + [-inf], 2)]
    rows += [(3, [0.5] * 8, 1)] * 60  # one row holds a large share
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("vec", "code", "error", "part", "same", "label_error"):
        df = df.withColumn(name, F.lit("x"))
    same(vectorcodes.compressed(df, parts=4, entries=16).collect(), rows, parts=4, entries=16)


def test_few_rows_and_large_numbers(spark):
    rows = [(1, [1e300, -1e300], 1), (2, [3.5e9, 7.25], 1), (3, [-2.0**60, 2.0**70], None), (4, [0.1, -0.1], None), (5, [1.7e308, 5e-324], 2)]
    same(vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA), parts=2, entries=3).collect(), rows, parts=2, entries=3)
    for few in ([], [(1, None, 1)], [(1, [1.0, 2.0], None)]):
        got = vectorcodes.compressed(spark.createDataFrame(few, SCHEMA), parts=2)
        assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
        same(got.collect(), few, parts=2)
    with pytest.raises(ValueError):
        vectorcodes.compressed(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA), parts=2)
    with pytest.raises(Exception, match="components are expected"):
        vectorcodes.compressed(spark.createDataFrame([(i, [1.0] * (2 + 2 * (i == 9)), 1) for i in range(10)], SCHEMA), parts=2, entries=4).collect()
