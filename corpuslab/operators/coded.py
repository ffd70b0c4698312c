"""Approximate nearest neighbours by product quantisation, then exact ranking of a few.

Vectors are cut into parts; each part is named by its nearest entry of a codebook, which is fitted by k-means to a bounded
sample. What moves and meets the queries is the code, a byte a part. In the task the entries that a code names stand in for
the vector, and are searched as vectors are. Only the best of each query bring their vectors, and
are ranked by exact distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.vectors import pair_distance, unit
from corpuslab.operators.nearest import BLOCK_ROWS, _blocks, _floats, _id_type, _ids, _streamed, block_best, top
from corpuslab.session import cut

PARTS, ENTRIES, SAMPLE, ROUNDS = 16, 256, 8_192, 10


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T


def _space(df: DataFrame, metric: str) -> DataFrame:
    """For cosine the squared distance of vectors of length 1, which is twice the cosine distance."""
    return df.withColumn("vec", unit(F.col("vec"))) if metric == "cosine" else df


def trained(docs: DataFrame, parts: int = PARTS, entries: int = ENTRIES, sample: int = SAMPLE, seed: int = 17) -> list[np.ndarray]:
    """A codebook for each part, by k-means over at most `sample` vectors, chosen by a hash of their ids.

    The driver holds the sample. Any codebook gives right results once enough documents are ranked exactly."""
    picked = docs.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("vec").collect()
    if not picked:
        return []
    vectors = np.stack([np.asarray(r.vec, dtype=np.float64) for r in picked])
    if vectors.shape[1] < parts:
        raise ValueError(f"vectors of {vectors.shape[1]} components do not make {parts} parts")
    books, rng = [], np.random.default_rng(seed)
    for part in np.array_split(vectors, parts, axis=1):
        book = part[rng.permutation(len(part))[:entries]]
        for _ in range(ROUNDS):
            own = _squares(part, book).argmin(axis=1)
            many = np.bincount(own, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, own, part)
            book = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], book)
        books.append(book)
    return books


def _cuts(books: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *[b.shape[1] for b in books]])


def encoded(docs: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(doc_id, code): one byte for each part of the vector."""
    ends = _cuts(books)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = _floats(pa.Table.from_batches([batch]), "vec")
                codes = np.stack([_squares(vectors[:, a:b], book).argmin(axis=1).astype(np.uint8) for a, b, book in zip(ends, ends[1:], books)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["doc_id", "code"])

    return docs.select("doc_id", "vec").mapInArrow(run, f"doc_id {kind}, code binary")


def _read(held: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The entries that codes (a row of `held` for each part) name, in place of the vectors."""
    return np.concatenate([book[code] for book, code in zip(books, held)], axis=1)


def _codes(table: pa.Table, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, parts).T


def _nominated(vectors: np.ndarray, books: list[np.ndarray], held: np.ndarray, rerank: int):
    """For each vector the places and distances of the `rerank` nearest of the codes (a row of `held` for each part)."""
    rows, cols, distance = block_best(vectors, _read(held, books), np.arange(held.shape[1]), rerank, "l2")
    ends = np.searchsorted(rows, np.arange(len(vectors) + 1))
    for lo, hi in zip(ends, ends[1:]):
        yield cols[lo:hi], distance[lo:hi]


def nearest_coded(
    queries: DataFrame, docs: DataFrame, k: int, metric: str = "l2", rerank: int = 100, parts: int = PARTS,
    entries: int = ENTRIES, sample: int = SAMPLE, block_rows: int = 4 * BLOCK_ROWS, seed: int = 17,
) -> DataFrame:
    """Top k documents per query as (query_id, doc_id, distance, rank); distances are exact, and so is the order of what is found.

    `rerank` documents of each query are compared by their vectors. Codes are a table of their own, written
    once. Rows without a vector take no part. Blocks of queries meet blocks of codes as in `nearest`, and a task passes on `rerank` rows a query."""
    if metric not in ("l2", "cosine"):
        raise ValueError("codes stand for l2 and cosine")
    if entries > 256:
        raise ValueError("a code is a byte a part")
    queries, docs = (df.where("vec IS NOT NULL") for df in (queries, docs))
    q, d = _space(queries.select("query_id", "vec"), metric), _space(docs.select("doc_id", "vec"), metric)
    books = trained(d, parts, entries, sample, seed)
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (d, "doc_id"))}
    ddl = f"query_id {types['query_id']}, doc_id {types['doc_id']}, distance double"
    if not books:
        return queries.sparkSession.createDataFrame([], ddl + ", rank int")
    codes = cut(encoded(d, books))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_queries, n_docs = q.count(), codes.count()
    n_q, n_d = _blocks(n_queries, block_rows, 1), _blocks(n_docs, block_rows, cores)
    out = pa.schema([("query_id", _id_type(q, "query_id")), ("doc_id", _id_type(d, "doc_id")), ("distance", pa.float64())])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        ids, found = _ids(right, "doc_id"), []
        for query_id, (best, distance) in zip(_ids(left, "query_id"), _nominated(_floats(left, "vec"), books, _codes(right, len(books)), rerank)):
            found.append((np.full(len(best), query_id), ids[best], distance))
        return pa.table(dict(zip(out.names, map(np.concatenate, zip(*found))))).cast(out)

    if n_q > 1:
        how = (rerank, "l2", False, False, False, False, False)
        met = _streamed(q, codes, n_q, n_d, n_queries, n_docs, how, out, ddl, lambda table: _read(_codes(table, len(books)), books))
    else:
        left = q.withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
        right = codes.withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int"))
        met = left.groupBy("_db").cogroup(right.groupBy("_db")).applyInArrow(kernel, ddl)
    some = top(met, rerank).select("query_id", "doc_id")
    pairs = some.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id").join(docs.select("doc_id", F.col("vec").alias("_d")), "doc_id")
    return top(pairs.select("query_id", "doc_id", pair_distance(F.col("_q"), F.col("_d"), metric).alias("distance")), k)
