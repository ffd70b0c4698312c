"""Benchmark passages in documents, by greedy string tiling.

Shared seeds (windows of a few words) join documents with test items; each candidate pair is
tiled: running Karp-Rabin finds matches of at least a length, the longest are marked first
and never overlap, and the length is lowered. The share of the item that tiles cover is the
verdict, so passages whose parts were reordered are found as well.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.joins import listed
from corpuslab.llm.rows import ROWS_A_BATCH
from corpuslab.session import cut

WORD = re.compile(r"\w+")
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
MOST_BITS = 1 << 27  # of the filter that tasks get: 16 MB however large the benchmark is
PROBES = 4


def tokens(text: str | None) -> list[str]:
    """Words in lower case, without punctuation."""
    return WORD.findall((text or "").lower())


def hashed(words: list[str]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), U64)


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every window of `length` words."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, length, U64)
    for i in range(length):
        out = out * BASE + h[i : i + n]
    return out ^ (out >> U64(29))


def place(seeds: np.ndarray, i: int, bits: int) -> np.ndarray:
    """Place of probe i of seeds in a filter of `bits` (a power of two) bits."""
    step = (seeds >> U64(32)) | U64(1)
    return ((seeds + U64(i) * step) & U64(bits - 1)).astype(np.int64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), none overlapping on
    either side, each at least `least` long.

    `length` is lowered from the longest match thought possible; a scan that finds a match
    over twice as long begins again at that one."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    found, length = [], max(least, min(20, len(item)))
    while True:
        matches, longest = [], 0
        wi, wd = windows(item, length), windows(doc, length)
        at_doc: dict[int, list[int]] = {}
        for j in np.flatnonzero(np.isin(wd, wi)).tolist():
            at_doc.setdefault(int(wd[j]), []).append(j)
        for i, w in enumerate(wi.tolist()):
            for j in at_doc.get(w, ()):
                # Only where a match begins: a longer one to the left holds this one.
                if i and j and free_i[i - 1] and free_d[j - 1] and item[i - 1] == doc[j - 1]:
                    continue
                k = 0
                while i + k < len(item) and j + k < len(doc) and free_i[i + k] and free_d[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k >= length:
                    matches.append((-k, i, j))
                    longest = max(longest, k)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for k, i, j in sorted(matches):
            if free_i[i : i - k].all() and free_d[j : j - k].all():
                free_i[i : i - k] = free_d[j : j - k] = False
                found.append((i, j, -k))
            else:
                again = True
        if again:
            # What is left of occluded matches may still be long enough for this length.
            continue
        if length == least:
            return found
        length = max(least, length // 2)


def seed_table(benchmark: DataFrame, least: int, column: str = "text") -> DataFrame:
    """item (digest of the text), seed, at, n_words of every window; items of fewer words than
    `least` are one window, items without words have none."""
    rows = benchmark.where(F.col(column).isNotNull()).select(F.md5(column).alias("item"), F.col(column).alias("text")).dropDuplicates(["item"])

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(*[c.to_pylist() for c in batch.columns]):
                h = hashed(tokens(text))
                length = min(least, len(h))
                if length:
                    out += [(item, int(s), i, len(h), length) for i, s in enumerate(windows(h, length).view(np.int64).tolist())]
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item", "seed", "at", "n_words", "length"])

    return rows.mapInArrow(run, "item string, seed long, at int, n_words int, length int")


def seed_filter(seeds: DataFrame):
    """(lengths of windows, filter bits) of the seeds, as a Bloom filter of at most `MOST_BITS` bits: 32 bits a
    seed up to that, so that its size is bounded. Words of the filter are put together in Spark."""
    known = seeds.agg(F.count("*").alias("n"), F.collect_set("length").alias("lengths")).first()
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (32 * known["n"]).bit_length()))

    def run(batches):
        for batch in batches:
            seeds = np.array(batch.column(0).to_pylist(), np.int64).view(U64)
            places = np.unique(np.concatenate([place(seeds, i, bits) for i in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 5), pa.array(np.int64(1) << (places & 31))], names=["word", "mask"])

    words = seeds.select("seed").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return sorted(known["lengths"]), bits, table


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 5, coverage: float = 0.8, column: str = "text", bench_column: str = "text") -> DataFrame:
    """doc_key (MD5 of a text), item (MD5 of an item), n_words, covered, coverage of every pair of
    texts of which tiles of `least_words` words and more cover at least that share of the item.

    A text without words overlaps nothing. Equal texts are one pair. Tasks keep only windows
    that may be seeds, by a filter of bounded size; the exact join follows. A pair is tiled only
    if the windows it shares could cover enough, which no tiling exceeds."""
    seeds = cut(seed_table(benchmark, least_words, bench_column))
    lengths, bits, table = seed_filter(seeds)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    texts = docs.where(F.col(column).isNotNull()).select(F.md5(column).alias("doc_key"), F.col(column).alias("text"))

    def run(batches):
        filled = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                rows, found = [], []
                for row, text in enumerate(batch.column(1)):
                    h, own = hashed(tokens(text.as_py())), []
                    for length in lengths:
                        w = windows(h, length)
                        for i in range(PROBES):
                            spot = place(w, i, bits)
                            w = w[(filled[spot >> 5] >> (spot & 31).astype(np.uint32)) & np.uint32(1) == 1]
                        own += np.unique(w).view(np.int64).tolist()
                    if own:
                        rows.append(row)
                        found.append(own)
                kept = batch.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.int64()))], names=["doc_key", "text", "seeds"])

    # Texts without a seed end here; those with one are written beside their seeds and never read again from `docs`.
    hits = cut(texts.mapInArrow(run, "doc_key string, text string, seeds array<long>"))
    spots = hits.select("doc_key", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("doc_key", "item").agg(F.first("n_words").alias("n_words"), F.first("length").alias("length"), F.array_sort(F.collect_set("at")).alias("at"))
    reach = F.expr("aggregate(at, named_struct('end', 0, 'sum', 0), (s, x) -> named_struct('end', x + length, 'sum', s.sum + x + length - greatest(x, s.end)), s -> s.sum)")
    pairs = cut(spots.where(reach >= coverage * F.col("n_words")).select("doc_key", "item"))
    picked = hits.select("doc_key", "text").join(listed(cut(pairs.select("doc_key").distinct())), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    items = benchmark.where(F.col(bench_column).isNotNull()).select(F.md5(bench_column).alias("item"), F.col(bench_column).alias("item_text")).dropDuplicates(["item"])
    both = pairs.join(picked, "doc_key").join(items, "item").select("doc_key", "item", "text", "item_text")

    def tile(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out = []
                for key, item, text, item_text in zip(*[c.to_pylist() for c in batch.columns]):
                    own = hashed(tokens(item_text))
                    found = tiles(own, hashed(tokens(text)), min(least_words, len(own)))
                    covered = sum(t[2] for t in found)
                    if covered >= coverage * len(own):
                        out.append((key, item, len(own), covered, covered / len(own)))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], names=["doc_key", "item", "n_words", "covered", "coverage"])

    return both.mapInArrow(tile, "doc_key string, item string, n_words long, covered long, coverage double")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", column: str = "text", bench_column: str = "text", **limits) -> DataFrame:
    """doc_id, item_id, n_words, covered, coverage: a row for every row of `docs` and of `benchmark`
    whose texts overlap. Null ids are carried as they are; repeated rows give repeated rows."""
    found = cut(overlaps(docs, benchmark, column=column, bench_column=bench_column, **limits))
    names = docs.select(F.col(key).alias("doc_id"), F.md5(column).alias("doc_key"))
    items = benchmark.select(F.col(item_key).alias("item_id"), F.md5(bench_column).alias("item"))
    return names.join(found, "doc_key").join(items, "item").select("doc_id", "item_id", "n_words", "covered", "coverage")


def cleaned(docs: DataFrame, benchmark: DataFrame, column: str = "text", bench_column: str = "text", **limits) -> DataFrame:
    """Documents that overlap no item, with all their columns; null texts stay."""
    found = cut(overlaps(docs, benchmark, column=column, bench_column=bench_column, **limits).select(F.col("doc_key").alias("doc_key__")).distinct())
    return docs.join(listed(found), F.md5(docs[column]) == F.col("doc_key__"), "left_anti")
