"""Importance resampling against a plain version text by text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from corpuslab.llm import resample
from corpuslab.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, low, high):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def slow(docs, target, percent=10, least=20, seed=2024, low=1, high=1, buckets=10_000):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in grams(t, low, high)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, low, high)[1])
    many_s, many_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (many_s + buckets) / ((s[b] + 1) * (many_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n_words, found = grams(text, low, high)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[5] = place + 1
    return out


def same(got, want):
    assert sorted(map(repr, map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))) == sorted(map(repr, map(tuple, want)))


def read(folder, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet'").fetchall()


def test_query(spark, folder):
    got = QUERIES["op13_importance_resampling"](spark, folder)
    want = slow(read(folder, "documents", "doc_id, text"), [r[0] for r in read(folder, "benchmark", "text")])
    assert sorted(map(repr, map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()))) == sorted(repr((r[0], *r[2:])) for r in want)


ODD = [
    (1, None), (2, ""), (3, " .,!"), (4, "One TWO two_three 4"), (5, "Été ÉTÉ été Straße İstanbul"), (6, "nul\x00inside \x00 word"), (7, "東京 tower\ttower"),
    (8, "word " * 150_000), (None, "some text of twenty words or more " * 5), (None, None), (9, "x"), (9, "x"), (10, "\x00"), (11, "end\x00"),
]


def test_odd_texts_and_grams(spark):
    docs = ODD + [(20 + i, " ".join(f"w{(i * k) % 37}" for k in range(15 + i % 12))) for i in range(150)] + [(400, "the same long row " * 8)] * 90
    target = ["w1 w2 w3 w4", None, "", "text of twenty"]
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    for name in ("n_words", "weight", "score", "rank", "row", "short", "noise", "place", "ordinal"):
        df = df.withColumn(name, F.lit(1))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for sizes in ({}, {"low": 1, "high": 2, "buckets": 97, "percent": 35}, {"low": 2, "high": 3, "least": 3}):
        args = {"least_words" if k == "least" else k: v for k, v in sizes.items()}
        same(resample.resampled(df, bench, **args), slow(docs, target, **sizes))
    same(resample.resampled(df.limit(0), bench), [])
    same(resample.resampled(df, bench.limit(0)), slow(docs, []))


def test_features_do_not_cross_texts():
    texts = [b"a b", b"", b"c", b"\x00", b"d e f"]
    bucket, owner, words = resample.features(texts, 1, 3, 1 << 32)
    want = [(g, k) for k, t in enumerate(["a b", "", "c", "", "d e f"]) for g in grams(t, 1, 3)[1]]
    assert sorted(zip(bucket.tolist(), owner.tolist())) == sorted((zlib.crc32(g.encode()), k) for g, k in want)
    assert words.tolist() == [2, 0, 1, 0, 3]
    assert [len(x) for x in resample.features([b"", b""])] == [0, 0, 2]
    assert isinstance(bucket, np.ndarray)
