"""Exact nearest neighbours of one table of vectors in another, and an approximate form.

Both sides are cut into blocks of bounded size. Every query block meets every document
block of its group exactly once, in one Arrow kernel that sends on only the k best
documents per query. So no pair table is ever formed, no task holds more than two blocks,
and no row passes through the driver. A group that holds a large share of all rows simply
has more blocks. Without groups a block is one row, packed: a task takes its block of queries
past those of documents, which are read again, not copied, for every block of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.vectors import exact_distances, norm, unit
from corpuslab.session import cut

BLOCK_ROWS = 8192
#: Without groups a block of documents holds so many times the rows, while its vectors have so many numbers
#: at most: every query passes on k rows from each block of documents.
DOC_BLOCKS, DOC_NUMBERS = 8, 1 << 21
#: Beyond so many pairs of blocks each is a task, up to so many tasks.
FEW_TASKS, MOST_TASKS = 256, 20_000
#: Tasks that a search makes for each core, at least, where it has the blocks; and rows whose lengths set the ranges.
_TASKS_A_CORE, _LENGTHS = 4, 50_000
_CHUNK_CELLS = 1_000_000
#: Rows of a block of documents that are compared at a time, and of queries at least.
_WIDTH, _LEAST_ROWS = 8192, 32
_EXACT_CELLS = 1_000_000
_STRIDES = 16
# Squared lengths up to which short numbers hold the products; and how many cells they may leave
# to be measured, by row and as a share, before long numbers are taken.
_SHORT_MOST = 1e30
_FEW, _SHARE = 64, 64


def _floats(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _vectors(table: pa.Table) -> np.ndarray:
    return _floats(table, "vec")


def _ids(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _factors(x: np.ndarray, metric: str, asked: bool, kind: type, scale: float = 1.0) -> np.ndarray:
    """Rows whose products with the rows of the other side are distances; `scale`: of the squared lengths in l2."""
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    out = np.ones((len(x), x.shape[1] + (2 if metric == "l2" else 1)), kind)
    dim = x.shape[1]
    if metric == "l2":
        out[:, dim + asked] = scale * (x * x).sum(axis=1)
        out[:, :dim] = -2.0 * x if asked else x
    else:
        out[:, :dim] = -x if asked else x
    return out


def _share(dim: int) -> float:
    """Bound on the error of a product of short numbers, as a share of both squared lengths, and twice as much."""
    return 4 * (dim + 8) * 2.0**-24


def _limit(values: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that at least k values do not exceed, near the k-th smallest: that of the least
    values of many strides of the row, or of the values themselves in short rows."""
    step = values.shape[1] // (_STRIDES * k)
    if step > 1:
        whole = values.shape[1] // step * step
        values = values[:, :whole].reshape(len(values), step, -1).min(axis=1)
    return np.partition(values, k - 1, axis=1)[:, k - 1]


def _exact(q, d, rows, cols, metric) -> np.ndarray:
    step = max(1, _EXACT_CELLS // max(1, q.shape[1]))
    parts = [
        exact_distances(q[rows[i : i + step]], d[cols[i : i + step]], metric) for i in range(0, len(rows), step)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def block_best(q, d, d_ids, k, metric, farthest=False, skip=None, after=None, bound=None, only=None):
    """The k best of block d for each row of q by (distance, id): rows, cols, distances.

    `skip` gives, for a slice of q rows and one of d rows, the cells (rows, cols) that do not count, `only` those that alone do. `after` gives
    per row the lowest (distance, id) that still counts, `bound` a distance beyond which none does. The matrix product only nominates;
    everything near a boundary is measured again exactly, so ties fall by id. Products are of
    short numbers, with their larger error, unless these are too coarse for the vectors at hand.
    What d's first rows gave bounds what the later ones can add. In l2, rows of d that differ too much in length
    from those of q are passed over, which takes rows sorted by length to save much.
    """
    out = []
    _, id_rank = np.unique(d_ids, return_inverse=True)
    square = (q * q).sum(axis=1) if metric != "cosine" else np.ones(len(q))
    d_most = float(np.fmax.reduce((d * d).sum(axis=1), initial=0.0)) if metric != "cosine" else 1.0
    # Short numbers would overflow beyond; numbers that are not finite go the long way as well.
    fits = bool(np.isfinite(q).all() and np.isfinite(d).all()) and max(float(np.fmax.reduce(square, initial=0.0)), d_most) < _SHORT_MOST
    # Merging takes time by k, so a large k has fewer parts.
    width = max(1, min(len(d), max(_WIDTH, 640 * k)))
    chunk = max(_LEAST_ROWS, _CHUNK_CELLS // width)
    room = np.empty((min(chunk, len(q)), width), np.float32) if fits else None
    sides, share = {}, _share(q.shape[1])
    lengths = spans = None
    if metric == "l2" and not farthest:
        lengths, held = np.sqrt(square), np.sqrt((d * d).sum(axis=1))
        spans = {begin: (held[begin : begin + width].min(), held[begin : begin + width].max()) for begin in range(0, len(d), width)}

    def apart(lo: int, hi: int, begin: int, known: np.ndarray) -> bool:
        """Whether all these rows are too far from rows lo to hi, as two vectors are no nearer than their lengths."""
        least, most = spans[begin]
        gap = np.maximum(least - lengths[lo:hi], lengths[lo:hi] - most) - 1e-9 * (lengths[lo:hi] + most)
        return bool(((gap > 0) & (gap * gap > known)).all())

    def nominated(lo: int, hi: int, begin: int, end: int, known: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Cells that may be among the k best of rows lo to hi, of which the k-th is `known` or infinite so far;
        None if short numbers leave too many."""
        part, kind, size = q[lo:hi], np.float32 if short else np.float64, end - begin
        if only is not None and not len((counts := only(lo, hi, begin, end))[0]):
            return np.zeros(0, int), np.zeros(0, int)
        # Short l2 products are lower bounds: less the error that the two lengths allow.
        lower = short and metric == "l2"
        scale = 1.0 if not lower else 1.0 + share if farthest else 1.0 - share
        if kind not in sides:
            sides[kind] = _factors(d, metric, False, kind, scale).T
        approx = np.matmul(_factors(part, metric, True, kind, scale), sides[kind][:, begin:end], out=room[: hi - lo, :size] if short else None)
        most = float(np.fmax.reduce(square[lo:hi], initial=0.0)) + d_most
        eps = 0.0 if lower else share * most + 1e-30 if short else 1e-11 * (1.0 + most)
        if farthest:
            np.negative(approx, out=approx)
        if skip is not None:
            approx[skip(lo, hi, begin, end)] = np.inf
        if only is not None:
            values = approx[counts]
            approx.fill(np.inf)
            approx[counts] = values
        if after is not None:
            first, first_id = after[0][lo:hi], after[1][lo:hi]
            rows, cols = np.divmod(np.flatnonzero(approx <= (first + eps).astype(kind)[:, None]), size)
            if short and len(rows) > _FEW * len(part) + approx.size // _SHARE:
                return None
            near = lower | (np.abs(approx[rows, cols] - first[rows]) <= eps)
            approx[rows[~near], cols[~near]] = np.inf
            rows, cols = rows[near], cols[near]
            dist = _exact(part, d[begin:end], rows, cols, metric)
            before = (dist < first[rows]) | ((dist == first[rows]) & (d_ids[begin + cols] < first_id[rows]))
            approx[rows[before], cols[before]] = np.inf
        limit = known + eps
        cells = np.flatnonzero(approx <= limit.astype(kind)[:, None]) if np.isfinite(known).all() else None
        if k < size and (cells is None or len(cells) > 2 * k * len(part)):
            least = _limit(approx, k).astype(float)
            # What is this near in l2 has a length near that of the row, which bounds its own error.
            limit, cells = np.minimum(limit, least + (16 * share * (square[lo:hi] + np.abs(least)) + 1e-30 if lower else 2 * eps)), None
        if cells is None:
            cells = np.flatnonzero(approx <= np.minimum(limit, np.finfo(kind).max).astype(kind)[:, None])
        rows, cols = np.divmod(cells, size)
        if short and len(rows) > (4 * k + _FEW) * len(part) + approx.size // _SHARE:
            return None
        finite = np.isfinite(approx[rows, cols])
        return rows[finite], begin + cols[finite]

    sign = -1 if farthest else 1
    for lo in range(0, len(q), chunk):
        hi = min(lo + chunk, len(q))
        rows, cols, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for begin in range(0, len(d), width):
            known = np.full(hi - lo, np.inf) if bound is None else sign * bound[lo:hi]
            last = np.searchsorted(rows, np.arange(hi - lo), "right")
            full = last - np.searchsorted(rows, np.arange(hi - lo)) >= k
            known[full] = np.minimum(known[full], sign * dist[last[full] - 1])
            if spans is not None and apart(lo, hi, begin, known):
                continue
            at = (lo, hi, begin, min(begin + width, len(d)), known)
            cells = nominated(*at, True) if fits else None
            more = nominated(*at, False) if cells is None else cells
            rows, cols = np.concatenate([rows, more[0]]), np.concatenate([cols, more[1]])
            dist = np.concatenate([dist, _exact(q[lo:hi], d, *more, metric)])
            order = np.lexsort((sign * id_rank[cols], sign * dist, rows))
            rows, cols, dist = rows[order], cols[order], dist[order]
            first = np.searchsorted(rows, rows, side="left")
            keep = np.arange(len(rows)) - first < k
            rows, cols, dist = rows[keep], cols[keep], dist[keep]
        out.append((rows + lo, cols, dist))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _shared_codes(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys, or equal vectors, get equal numbers across both blocks."""
    axis = 0 if q.ndim == 2 else None
    _, codes = np.unique(np.concatenate([q, d]), axis=axis, return_inverse=True)
    codes = codes.reshape(-1)
    return codes[: len(q)], codes[len(q) :]


def _equal(asked: np.ndarray, order: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (rows, cols) where a number asked for equals one held; `held` is sorted, by `order`."""
    begin, end = (np.searchsorted(held, asked, side) for side in ("left", "right"))
    many = end - begin
    rows = np.repeat(np.arange(len(asked)), many)
    return rows, order[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(rows))]


def _searched(left: pa.Table, q: np.ndarray, right: pa.Table, k, metric, farthest, drop_zero, drop_same_key, has_after, only_same_key, bound=None, read=_vectors):
    """The k best of `right`, whose vectors `read` gives, for each row of `left`, of which q are the vectors: rows, ids, distances."""
    d, d_ids = read(right), _ids(right, "doc_id")
    def alike(codes: list):
        """The cells of two slices where one of the codes is the same on both sides."""
        held = {}

        def cells(lo, hi, begin, end):
            if begin not in held:
                held[begin] = [(order, b[begin:end][order]) for _, b in codes for order in [np.argsort(b[begin:end], kind="stable")]]
            found = [_equal(a[lo:hi], order, b) for (a, _), (order, b) in zip(codes, held[begin])]
            return tuple(np.concatenate(x) for x in zip(*found))

        return cells if codes else None

    keys = _shared_codes(_ids(left, "key"), _ids(right, "key")) if drop_same_key or only_same_key else None
    skip = alike(([_shared_codes(q + 0.0, d + 0.0)] if drop_zero else []) + ([keys] if drop_same_key else []))
    only = alike([keys] if only_same_key else [])
    after = None
    if has_after:
        after = (left.column("after_distance").to_numpy(), _ids(left, "after_id"))
    rows, cols, dist = block_best(q, d, d_ids, k, metric, farthest, skip, after, bound, only)
    return rows, d_ids[cols], dist


def _kernel(how, out_type):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out_type.empty_table()
        rows, ids, dist = _searched(left, _floats(left, "vec"), right, *how)
        q_ids = _ids(left, "query_id")
        return pa.table({"query_id": pa.array(q_ids[rows]), "doc_id": pa.array(ids), "distance": pa.array(dist)}).cast(out_type)

    return run


def _folded(table: pa.Table) -> bytes:
    """All rows of a table as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unfolded(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def _by_length(table: pa.Table, read=_vectors) -> pa.Table:
    return table.take(pa.array(np.argsort(np.square(read(table)).sum(axis=1), kind="stable")))


def _lengths(df: DataFrame, row_id: str, rows: int) -> np.ndarray:
    some = df.where(F.pmod(F.xxhash64(row_id, F.lit(2)), F.lit(-(-rows // _LENGTHS))) == 0)
    found = np.array([r.n for r in some.select(F.coalesce(norm(F.col("vec")), F.lit(0.0)).alias("n")).collect()], dtype=np.float64)
    return found if len(found) else np.zeros(1)


def _ends(lengths: np.ndarray, blocks: int) -> list[float]:
    """The ends of so many ranges of lengths, or fewer, where many rows have the same."""
    ends = np.unique(np.quantile(lengths, np.arange(1, blocks) / blocks, method="lower")) if blocks > 1 else np.zeros(0)
    return ends[np.isfinite(ends) & (ends < lengths.max())].tolist()


def _ranges(lengths: Column, ends: list[float]) -> Column:
    """The place of each length among the ends of ranges."""
    if not ends:
        return F.lit(0)

    @F.pandas_udf("int")
    def place(values):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(ends), np.asarray(values, dtype=np.float64)).astype(np.int32))

    return place.asNondeterministic()(F.coalesce(lengths, F.lit(0.0)))


def _pieces(place: Column, row_id: str, pieces: list[int]) -> Column:
    """The number of a row's block, where each range is cut into so many by a hash."""
    first = F.array(*[F.lit(int(x)) for x in np.cumsum([0, *pieces[:-1]])])
    many = F.array(*[F.lit(int(x)) for x in pieces])
    return (F.get(first, place) + F.pmod(F.xxhash64(row_id), F.get(many, place))).cast("int")


def _streamed(q: DataFrame, d: DataFrame, nq: int, nd: int, n_queries: int, n_docs: int, how: tuple, out: pa.Schema, ddl: str, read=_vectors) -> DataFrame:
    """The k best per query, for more than one block of queries: every block is a row, and a task takes a block of queries past
    many of documents, keeping k rows a query. So a table is moved twice, however many blocks it has.

    Blocks hold vectors of like lengths. What documents of like length give bounds each query's distances before it meets the others.
    Lengths of `_LENGTHS` rows of each side at most, give or take, are fetched to set the ranges; they decide where a row is, not whether."""
    k, metric, farthest = how[:3]

    # Only in l2 the lengths bound a distance, and only vectors have them before they are read.
    bounds = metric == "l2" and not farthest and read is _vectors
    q_lengths, d_lengths = (_lengths(df, c, n) if bounds else np.zeros(1) for df, c, n in ((q, "query_id", n_queries), (d, "doc_id", n_docs)))
    q_ends, d_ends = _ends(q_lengths, nq), _ends(d_lengths, nd)

    def shares(lengths: np.ndarray, ends: list[float]) -> np.ndarray:
        return np.bincount(np.searchsorted(ends, lengths), minlength=len(ends) + 1) / len(lengths)

    # A length that many rows have is a range of its own, which a hash cuts into pieces.
    q_pieces, d_pieces = (np.maximum(1, np.rint(n * shares(x, ends))).astype(int).tolist() for n, x, ends in ((nq, q_lengths, q_ends), (nd, d_lengths, d_ends)))
    beside = n_docs * shares(d_lengths, q_ends)
    length = norm(F.col("vec"))
    q = q.withColumn("_r", _ranges(length, q_ends))
    d = d.withColumn("_r", _ranges(length, q_ends)).withColumn("_s", _ranges(length, d_ends))
    # A quarter as many documents of like length as queries, or fewer, give the first bounds.
    thin = F.array(*[F.lit(int(x)) for x in np.maximum(1, np.ceil(4 * beside * nq / (np.array(q_pieces) * max(1, n_queries))))])
    like = d.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.get(thin, F.col("_r"))) == 0).withColumn("_qb", _pieces(F.col("_r"), "doc_id", q_pieces)).drop("_r", "_s")
    q = q.withColumn("_qb", _pieces(F.col("_r"), "query_id", q_pieces)).drop("_r")
    d = d.withColumn("_db", _pieces(F.col("_s"), "doc_id", d_pieces)).drop("_r", "_s")

    def asking(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_qb": pa.array([], pa.int32()), "asked": pa.array([], pa.binary())})
        block, left = left.column("_qb")[0], _by_length(left.drop_columns(["_qb"]))
        bound = np.full(left.num_rows, -np.inf if farthest else np.inf)
        if right.num_rows:
            rows, _, dist = _searched(left, _floats(left, "vec"), _by_length(right, read), *how, read=read)
            last = np.searchsorted(rows, np.arange(len(bound)), "right")
            full = last - np.searchsorted(rows, np.arange(len(bound))) >= k
            bound[full] = dist[last[full] - 1]
        return pa.table({"_qb": pa.array([block.as_py()], pa.int32()), "asked": pa.array([_folded(left.append_column("_bound", pa.array(bound)))], pa.binary())})

    def holding(right: pa.Table) -> pa.Table:
        block, right = right.column("_db")[0], _by_length(right.drop_columns(["_db"]), read)
        return pa.table({"_db": pa.array([block.as_py()], pa.int32()), "held": pa.array([_folded(right)], pa.binary())})

    def past(batches):
        sign, states = -1 if farthest else 1, {}
        for batch in batches:
            for block, asked, held in zip(*batch.columns):
                at = block.as_py()
                if at not in states:
                    left = _unfolded(asked)
                    # A copy, as batches come and go.
                    rest, vectors = left.drop_columns(["vec"]).take(pa.array(np.arange(left.num_rows))), _floats(left, "vec").copy()
                    states[at] = [rest, vectors, rest.column("_bound").to_numpy().copy(), None]
                left, vectors, bound, best = states[at]
                rows, ids, dist = _searched(left, vectors, _unfolded(held), *how, bound, read)
                if best is not None:
                    rows, ids, dist = (np.concatenate(x) for x in zip(best, (rows, ids, dist)))
                    order = np.lexsort((sign * np.unique(ids, return_inverse=True)[1], sign * dist, rows))
                    order = order[np.arange(len(rows)) - np.searchsorted(rows[order], rows[order]) < k]
                    rows, ids, dist = rows[order], ids[order], dist[order]
                last = np.searchsorted(rows, np.arange(len(bound)), "right")
                full = last - np.searchsorted(rows, np.arange(len(bound))) >= k
                bound[full] = sign * np.minimum(sign * bound[full], sign * dist[last[full] - 1])
                states[at][3] = (rows, ids, dist)
        for left, _, _, (rows, ids, dist) in states.values():
            found = pa.table({"query_id": pa.array(_ids(left, "query_id")[rows]), "doc_id": pa.array(ids), "distance": pa.array(dist)})
            yield from found.cast(out).to_batches()

    left = d.groupBy("_db").applyInArrow(holding, "_db int, held binary")
    right = q.groupBy("_qb").cogroup(like.groupBy("_qb")).applyInArrow(asking, "_qb int, asked binary")
    return passed(left, right, sum(q_pieces), sum(d_pieces), past, ddl)


def passed(held: DataFrame, asked: DataFrame, n_q: int, n_d: int, run, ddl: str) -> DataFrame:
    """Packed blocks of queries (_qb, asked) with each of documents (_db, held), for `run` as rows (_qb, asked, held): a task has one block of
    queries, or few where these are very many, and as large a part of the documents as leaves each core some tasks."""
    cores = held.sparkSession.sparkContext.defaultParallelism
    parts, many = min(n_d, max(1, -(-_TASKS_A_CORE * cores // n_q))), min(n_q, MOST_TASKS)
    left = held.repartitionById(parts, F.expr(f"_db % {parts}"))
    right = asked.repartitionById(many, F.expr(f"_qb % {many}"))
    met = left.hint("shuffle_replicate_nl").crossJoin(right.hint("shuffle_replicate_nl"))
    return met.select("_qb", "asked", "held").mapInArrow(run, ddl)


def _id_type(df: DataFrame, column: str):
    name = df.schema[column].dataType.simpleString()
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def _blocks(rows: int, block_rows: int, at_least: int) -> int:
    """Enough blocks to bound their size and, on small inputs, to occupy the cores."""
    return max(1, math.ceil(rows / block_rows), min(at_least, math.ceil(rows / 256)))


def dealt(q: DataFrame, d: DataFrame, pairs: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out to a task for each pair of blocks, where these are many: then their number
    grows with the pairs, not the time of one. A few pairs are dealt out as Spark's settings have it."""
    if pairs <= FEW_TASKS:
        return q, d
    return tuple(df.repartition(min(MOST_TASKS, pairs), *keys) for df in (q, d))


def nearest(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    metric: str = "l2",
    by: list[str] | None = None,
    drop_zero: bool = False,
    drop_same_key: bool = False,
    farthest: bool = False,
    block_rows: int = BLOCK_ROWS,
    keep_rank: bool = True,
    only_same_key: bool = False,
) -> DataFrame:
    """Top k documents per query as (query_id, doc_id, distance, rank).

    queries: query_id, vec [, key] [, after_distance, after_id] [, *by]
    docs:    doc_id, vec [, key] [, *by]

    by             only documents that agree on these columns compete
    drop_zero      documents with the very same vector do not compete
    drop_same_key  nor do those with the same `key`
    only_same_key  only those with the same `key` do
    after_*        per query the first (distance, id) that still counts
    farthest       the k last of the full ranking instead of the first

    Rows without a vector take no part; vectors of unequal lengths are an error.
    """
    queries, docs = queries.where("vec IS NOT NULL"), docs.where("vec IS NOT NULL")
    has_after = "after_distance" in queries.columns
    spark = queries.sparkSession
    cores = spark.sparkContext.defaultParallelism
    keyed = drop_same_key or only_same_key
    extra_q = (["key"] if keyed else []) + (["after_distance", "after_id"] if has_after else [])
    extra_d = ["key"] if keyed else []
    # Aliases give both sides columns of their own, also when one table plays both parts.
    q = queries.select(*[F.col(c).alias(c) for c in ("query_id", "vec", *extra_q, *(by or []))])
    d = docs.select(*[F.col(c).alias(c) for c in ("doc_id", "vec", *extra_d, *(by or []))])

    out = pa.schema(
        [("query_id", _id_type(queries, "query_id")), ("doc_id", _id_type(docs, "doc_id")), ("distance", pa.float64())]
    )
    how = (k, metric, farthest, drop_zero, drop_same_key, has_after, only_same_key)
    ddl = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, distance double"
    )
    if not by:
        n_queries = q.count()
        nq_count = _blocks(n_queries, block_rows, 1)
        held = d.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
        doc_rows = min(DOC_BLOCKS * block_rows, max(block_rows, DOC_NUMBERS // max(1, held.dim or 1)))
        nd_count = _blocks(held.n, doc_rows, cores)
        if nq_count > 1:
            best = _streamed(q, d, nq_count, nd_count, n_queries, held.n, how, out, ddl)
            return top(best, k, farthest) if keep_rank else best
        nq, nd = F.lit(nq_count), F.lit(nd_count)
        q = q.withColumn("_nq", nq).withColumn("_nd", nd).withColumn("_g", F.lit(0))
        d = d.withColumn("_nq", nq).withColumn("_nd", nd).withColumn("_g", F.lit(0))
    else:
        q, d = (df.withColumn("_g", F.xxhash64(*by)) for df in (q, d))
        # Only groups beyond one block need an entry, at most rows / block_rows of them.
        def large(df: DataFrame, name: str) -> DataFrame:
            counts = df.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
            return counts.select("_g", F.ceil(F.col("n") / block_rows).cast("int").alias(name))

        sizes = large(q, "_nq").join(large(d, "_nd"), "_g", "full_outer")
        q, d = (
            df.join(sizes, "_g", "left")
            .withColumn("_nq", F.coalesce("_nq", F.lit(1)))
            .withColumn("_nd", F.coalesce("_nd", F.lit(1)))
            for df in (q, d)
        )

    group = [*(by or []), "_g", "_qb", "_db"]
    q = q.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int")).withColumn(
        "_db", F.explode(F.sequence(F.lit(0), F.col("_nd") - 1))
    )
    d = d.withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.col("_nd")).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))
    )
    q, d = q.drop("_nq", "_nd"), d.drop("_nq", "_nd")

    keys = [c for c in group if c in q.columns]
    kernel = _kernel(how, out)
    if not by:
        q, d = dealt(q, d, nd_count, keys)
    best = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(kernel, ddl)
    if not keep_rank:
        return best
    return top(best, k, farthest)


def top(scored: DataFrame, k: int, farthest: bool = False) -> DataFrame:
    """The k best rows per query by (distance, doc_id); at most k per block arrive here."""
    keys = [F.col("distance"), F.col("doc_id")]
    w = Window.partitionBy("query_id").orderBy(*[c.desc() for c in keys] if farthest else keys)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def random_planes(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables * hashes, dim)), rng.random(tables * hashes)


def bucketed(df: DataFrame, dim: int, width: float, tables: int, hashes: int, seed: int) -> DataFrame:
    """One row per hash table with the row's bucket in it (random projections)."""
    planes, offsets = random_planes(dim, tables, hashes, seed)

    @F.pandas_udf("array<string>")
    def buckets(vecs):
        import pandas as pd

        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
        cells = np.floor(matrix @ planes.T / width + offsets).astype(np.int64)
        cells = cells.reshape(len(matrix), tables, hashes)
        return pd.Series([[",".join(map(str, row)) for row in one] for one in cells])

    return df.select("*", F.posexplode(buckets.asNondeterministic()("vec")).alias("_table", "_bucket"))


def nearest_lsh(
    queries: DataFrame, docs: DataFrame, k: int, dim: int, metric: str = "l2",
    width: float = 1.0, tables: int = 4, hashes: int = 1, seed: int = 17,
) -> DataFrame:
    """Approximate form: only documents sharing a bucket compete. A hot bucket is cut
    into blocks like any other group. Recall depends on width, tables and hashes."""
    def side(df: DataFrame) -> DataFrame:
        return bucketed(df, dim, width, tables, hashes, seed)

    found = nearest(side(queries), side(docs), k, metric, by=["_table", "_bucket"], keep_rank=False)
    return top(found.dropDuplicates(["query_id", "doc_id"]), k)


def _centre_distances(vecs, centres: np.ndarray) -> np.ndarray:
    """Plain distances of a batch of vectors to all centres; the matrix product is refined where it loses digits."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
    square = (matrix * matrix).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * matrix @ centres.T
    scale = 1e-9 * (1.0 + square.max(initial=0.0))
    rows, cols = np.nonzero(square <= scale)
    square[rows, cols] = ((matrix[rows] - centres[cols]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0.0))


def _own_cells(vec: Column, centres: np.ndarray, probes: int) -> Column:
    """The `probes` nearest centres of each vector with the plain distance to them."""

    @F.pandas_udf("array<struct<cell:int, reach:double>>")
    def near(vecs):
        import pandas as pd

        dist = _centre_distances(vecs, centres)
        best = np.argsort(dist, axis=1, kind="stable")[:, :probes]
        return pd.Series([[{"cell": int(c), "reach": float(row[c])} for c in cells] for row, cells in zip(dist, best)])

    return near.asNondeterministic()(vec)


def _other_cells(vec: Column, bound: Column, centres: np.ndarray, radius: np.ndarray, probes: int) -> Column:
    """Cells beyond the `probes` nearest that may hold a document within the bound."""

    @F.pandas_udf("array<int>")
    def within(vecs, bounds):
        import pandas as pd

        dist = _centre_distances(vecs, centres)
        limit = np.asarray(bounds, dtype=np.float64)[:, None]
        held = (dist - radius <= limit * (1 + 1e-9) + 1e-6) & (radius >= 0)
        np.put_along_axis(held, np.argsort(dist, axis=1, kind="stable")[:, :probes], False, axis=1)
        return pd.Series([np.flatnonzero(row).tolist() for row in held])

    return within.asNondeterministic()(vec, bound)


def nearest_pruned(
    queries: DataFrame, docs: DataFrame, k: int, metric: str = "l2", cells: int = 256, probes: int = 2,
    block_rows: int = BLOCK_ROWS, seed: int = 17,
) -> DataFrame:
    """Exact top k that skips what cannot matter, for clustered collections.

    Documents belong to the cell of their nearest centre. A query first searches its own
    `probes` nearest cells; its k-th distance there bounds what can still come in: by the
    triangle inequality no document of a cell is nearer than the distance to the centre
    minus the cell's radius. Only cells within the bound are searched in a second
    round. In data without clusters that may be all of them, and the result is the same.
    A crowded cell is cut into blocks as any group. For `cosine`, vectors are scaled to
    length 1 for the bounds, where the squared distance is twice the cosine distance.

    Centres and radii, at most `cells` of each, are fetched and go along with the tasks.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("the bound holds for l2 and cosine")
    space = unit if metric == "cosine" else (lambda vec: vec)
    scale = 2.0 if metric == "cosine" else 1.0
    queries, docs = queries.where("vec IS NOT NULL"), docs.where("vec IS NOT NULL")
    if docs.isEmpty():
        return nearest(queries, docs, k, metric)
    picked = docs.select("doc_id", space(F.col("vec")).alias("vec"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(cells)
    centres = np.stack([np.asarray(r.vec, dtype=np.float64) for r in picked.collect()])

    def placed(df: DataFrame, row_id: str, n: int) -> DataFrame:
        found = F.explode(_own_cells(space(F.col("vec")), centres, n)).alias("_c")
        return df.select(row_id, "vec", found).select(row_id, "vec", "_c.cell", "_c.reach")

    held = cut(placed(docs, "doc_id", 1))
    radius = np.full(len(centres), -1.0)
    for row in held.groupBy("cell").agg(F.max("reach").alias("r")).collect():
        radius[row.cell] = row.r

    def search(asked: DataFrame) -> DataFrame:
        return nearest(asked, held, k, metric, by=["cell"], block_rows=block_rows, keep_rank=False)

    first = cut(top(search(placed(queries, "query_id", probes)), k).drop("rank"))
    known = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_kth"))
    reach = F.sqrt(F.greatest(F.col("_kth") * scale, F.lit(0.0)))
    limit = F.when(F.col("_n") >= k, reach).otherwise(F.lit(float("inf")))
    others = _other_cells(space(F.col("vec")), limit, centres, radius, probes)
    second = queries.select("query_id", "vec").join(known, "query_id", "left").select(
        "query_id", "vec", F.explode(others).alias("cell")
    )
    return top(first.unionByName(search(second)), k)
