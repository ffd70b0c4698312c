"""Importance resampling of documents towards a target corpus.

Texts become hashed n-gram counts. A bucket's gain is the log ratio of its smoothed shares in target
and source; a document's weight is the mean gain of its features; documents are drawn without replacement by weight plus
Gumbel noise that depends on their id alone.

Features of many texts are found at once: a batch is joined with sentinels between its texts, one pass
of a pattern finds all words, the sentinels' places tell by binary search which text a word
is of, and n-grams that begin and end in different texts are masked.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.rows import slices
from corpuslab.llm.worker import Bounded, kept
from corpuslab.operators.ordering import sorted_ordinal
from corpuslab.session import cut

#: On lower-cased UTF-8: runs of ASCII letters and digits and of all bytes beyond ASCII; or the sentinel.
WORD = re.compile(b"[0-9a-z\x80-\xff]+|\x00")
SENTINEL = b"\x00"
WORDS_KEPT = 200_000


def _crc(word: bytes) -> int:
    return zlib.crc32(word) if word != SENTINEL else -1


def features(texts: list[bytes], low: int = 1, high: int = 1, buckets: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text that it is of, words of each text). Features are all
    runs of `low` to `high` words of one text, joined by a space."""
    # bytes.lower() changes A-Z only. The sentinel is no word character, so inside a text a blank does as well.
    joined = SENTINEL.join([t.lower().replace(SENTINEL, b" ") for t in texts])
    found = WORD.findall(joined)
    memo = kept(("resample", "crc"), lambda: Bounded(_crc, WORDS_KEPT))
    crc = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
    offsets = np.flatnonzero(crc < 0)
    places = np.flatnonzero(crc >= 0)
    text_of = np.searchsorted(offsets, places)
    n_words = np.bincount(text_of, minlength=len(texts))
    hashes, owners = [], []
    if low <= 1 <= high:
        hashes.append(crc[places])
        owners.append(text_of)
    if high > 1:
        words = [found[i] for i in places.tolist()]
        for n in range(max(low, 2), high + 1):
            inside = np.flatnonzero(text_of[: len(words) - n + 1] == text_of[n - 1 :]) if len(words) >= n else np.empty(0, np.int64)
            hashes.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) for i in inside.tolist()), np.int64, len(inside)))
            owners.append(text_of[inside])
    return np.concatenate(hashes) % buckets, np.concatenate(owners), n_words


def bucket_counts(docs: DataFrame, column: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket. Each task adds up its own; one row per bucket comes to the driver."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for _, texts in slices(batches):
            counts += np.bincount(features(texts, low, high, buckets)[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(column).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths: floor(1000 ln of the ratio of smoothed shares)."""
    many = len(source)
    all_s, all_t = float(int(source.sum()) + many), float(int(target.sum()) + many)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_s / (float(s + 1) * all_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, seed: int, doc_id: str = "doc_id", column: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document. A null id has the noise of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(column).alias("text"), F.col(doc_id).alias("doc_id"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("noise"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in slices(batches):
            found, owner, n_words = features(texts, low, high, len(gain))
            n = np.bincount(owner, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owner, gain[found])
            weight = total // np.maximum(n, 1)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), *[pa.array(x, pa.int64()) for x in (n_words, n, weight, weight + np.array(noise, np.int64))]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", column: str = "text", target_column: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """Every row of `docs` as doc_id, n_words, n_features, weight, score and rank: 1, 2, 3 .. for the
    floor(percent * N / 100) highest scores of the N documents of `least_words` or more, else null.

    Ties of scores fall to the smaller id (null ids last), then to any one of rows alike in both. A null or empty text has no
    words, weight 0 and is never drawn. Repeated rows are rows of their own. Empty tables give an empty result; an
    empty target makes all gains follow from smoothing. Other columns take no part, whatever their names. Texts
    are scanned twice, for the counts and for the weights; what is ranked are narrow rows, by one range sort."""
    gain = gains(bucket_counts(docs, column, low, high, buckets), bucket_counts(target, target_column, low, high, buckets))
    rows = cut(weighed(docs, gain, seed, doc_id, column, low, high).withColumn("row", F.monotonically_increasing_id()).withColumn("short", F.col("n_words") < least_words))
    drawn = percent * rows.where(~F.col("short")).count() // 100
    order = ["short", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"]
    place = F.col("place") + 1
    return sorted_ordinal(rows, order, "place").select("doc_id", "n_words", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
