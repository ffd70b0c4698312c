"""Compression of vectors to one short code for each of their parts.

Each part position has a codebook, fitted by rounds of assignment and averaging over all vectors.
A part's nearest entry is found by equal-average search: entries lie in order of their
component sums; by Cauchy-Schwarz an entry whose sum differs by g is at least g * g / dimension
away, so the search goes outward from the part's own sum and ends once that exceeds the best.
All arithmetic is on integers, so codes do not depend on the order of rows or tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.joins import listed
from corpuslab.session import cut

SCALE = 256
#: Up to here (dimension of a part times component) squares of sums fit in 64 bits.
NARROW = 1 << 29
LONG = (1 << 63) - 1
#: Sums travel as digits of this many bits, so that components of any size add up exactly.
LIMB = 40
ROWS_A_BATCH = 4_096


def floored(values: np.ndarray, width: int) -> np.ndarray:
    """floor(256 * x) of finite doubles: 64-bit integers where searches on parts of `width` stay exact with
    them, else Python's integers."""
    if not values.size or float(np.abs(values).max()) * SCALE * max(width, 1) <= NARROW:
        return np.floor(values * SCALE).astype(np.int64)
    # From 2**53 on a double is whole, and 256 times it might not be a double.
    flat = [math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE for x in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `parts` the index of the nearest row of `book` and the squared distance, by
    equal-average search; of equally near entries the lower index."""
    n, width = parts.shape
    if parts.dtype == object or book.dtype == object or (book.size and width * int(np.abs(book).max()) > NARROW):
        parts, book = parts.astype(object), book.astype(object)
    kind = parts.dtype
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, book = sums[order], book[order]
    many = len(order)
    own = parts.sum(axis=1)
    high = np.searchsorted(sums, own).astype(np.int64)
    low = high - 1
    best, found = np.zeros(n, kind), np.full(n, many, np.int64)
    open_ = np.arange(n)
    while len(open_):
        at_low, at_high, mine = low[open_], high[open_], own[open_]
        has_low, has_high = at_low >= 0, at_high < many
        below, above = mine - sums[np.maximum(at_low, 0)], sums[np.minimum(at_high, many - 1)] - mine
        down = has_low & (~has_high | (below <= above).astype(bool))
        gap = np.where(down, below, above)
        new = found[open_] == many
        go = (has_low | has_high) & (new | (gap * gap <= best[open_] * width).astype(bool))
        open_, down = open_[go], down[go]
        if not len(open_):
            break
        place = np.where(down, at_low[go], at_high[go])
        apart = parts[open_] - book[place]
        far, entry = (apart * apart).sum(axis=1), order[place]
        was, held = best[open_], found[open_]
        better = (held == many) | (far < was).astype(bool) | ((far == was).astype(bool) & (entry < held))
        best[open_], found[open_] = np.where(better, far, was), np.where(better, entry, held)
        low[open_] -= down
        high[open_] += ~down
    return found, best


def _vectors(batch, at: int, length: int) -> np.ndarray:
    """Column `at` as a matrix of doubles."""
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != length).any():
        raise ValueError(f"vectors of {length} components are expected, one has {int(sizes[sizes != length][0])}")
    return flat.reshape(len(column), length)


def _assigned(values: np.ndarray, books: list[np.ndarray]):
    width = books[0].shape[1]
    whole = floored(values, width)
    for p, book in enumerate(books):
        part = whole[:, p * width : (p + 1) * width]
        yield p, part, *nearest_entries(part, book)


def _limbs(value: int):
    """Digits of `value` by 2**LIMB from the lowest on; the last one has the sign."""
    at = 0
    while True:
        rest = value >> LIMB
        if rest in (0, -1) and -(1 << 62) < value < 1 << 62:
            yield at, value
            return
        yield at, value & ((1 << LIMB) - 1)
        value, at = rest, at + 1


def _sums(rows: DataFrame, books: list[np.ndarray]) -> dict:
    """(part, entry) -> (count, component sums) of the vectors assigned to it.

    Each task adds up its own vectors; what is collected has one row per used entry, position and digit."""
    length = books[0].shape[1] * len(books)

    def run(batches):
        count, total = {}, {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                for p, part, found, _ in _assigned(_vectors(whole.slice(at, ROWS_A_BATCH), 0, length), books):
                    for e in np.unique(found).tolist():
                        mine = part[found == e]
                        key = p, e
                        count[key] = count.get(key, 0) + len(mine)
                        total[key] = [a + b for a, b in zip(total.get(key, [0] * part.shape[1]), mine.sum(axis=0).tolist())]
        out = [(p, e, -1, 0, n) for (p, e), n in count.items()]
        out += [(p, e, i, limb, digit) for (p, e), xs in total.items() for i, x in enumerate(xs) for limb, digit in _limbs(x)]
        if out:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "entry", "place", "limb", "total"])

    made = rows.select("vec").mapInArrow(run, "part int, entry int, place int, limb int, total long")
    got = made.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict = {}
    for r in got:
        count, xs = out.setdefault((r.part, r.entry), [0, [0] * books[0].shape[1]])
        if r.place < 0:
            out[r.part, r.entry][0] = int(r.total)
        else:
            xs[r.place] += int(r.total) << (LIMB * r.limb)
    return out


def _as_book(entries: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(x) <= NARROW for e in entries for x in e)
    return np.array(entries, np.int64 if small else object).reshape(len(entries), width)


def fitted(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """Codebooks by part, from `rows` (vec_id, vec: finite doubles): the parts of the first `entries`
    vectors by id, then `rounds` of assigning all vectors and averaging (floored). Unused entries stay.

    Empty without rows. Ties of ids fall by the vectors, null ids come last. The driver holds the
    codebooks, `entries` vectors, and the sums for one round."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    if not first:
        return []
    length = len(first[0].vec)
    if length % parts or any(len(r.vec) != length for r in first):
        raise ValueError(f"vectors must have one length that {parts} divides")
    width = length // parts
    whole = [floored(np.array(r.vec, float), width).tolist() for r in first]
    books = [_as_book([v[p * width : (p + 1) * width] for v in whole], width) for p in range(parts)]
    for _ in range(rounds):
        sums = _sums(rows, books)
        books = [_as_book([[x // n for x in xs] if (n := (got := sums.get((p, e), (0, None)))[0]) and (xs := got[1]) is not None else list(map(int, book[e])) for e in range(len(book))], width) for p, book in enumerate(books)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def usable(rows: DataFrame, vec_id: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, vec (array<double>) of the rows whose vector is there and has only finite components."""
    vec = F.col(column).cast("array<double>")
    out = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col("vec").isNotNull() & finite)


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distance to what the
    code stands for; beyond a long, the largest long) of `rows` (vec_id, label, vec)."""
    length = books[0].shape[1] * len(books)
    if any(len(b) > 256 for b in books):
        raise ValueError("codes of two hex digits take 256 entries")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                index, error = np.empty((batch.num_rows, len(books)), np.uint8), 0
                for p, _, found, far in _assigned(_vectors(batch, 2, length), books):
                    index[:, p] = found
                    error = error + far
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in index]), pa.array([min(int(x), LONG) for x in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(rows: DataFrame, vec_id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, label, code, error, label_error (sum over the rows of that label; nulls are one label)
    and codebooks_sha256, for every usable row.

    A null vector, or one with a null, NaN or infinite component, drops the row; a null id or label
    does not. Repeated rows each come back. An empty table, or one without usable rows, gives an empty
    result. Vectors of several lengths, or of one that `parts` does not divide, raise. Other columns of
    `rows` take no part, whatever their names. Sums by label are pre-aggregated in the tasks; joining them
    back is by broadcast while labels are few, else by shuffle, where Spark splits a hot label."""
    vectors = usable(rows, vec_id, column, label)
    books = fitted(vectors, parts, entries, rounds)
    if not books:
        return vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    out = cut(coded(vectors, books))
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = cut(out.groupBy(F.col("label").alias("same")).agg(whole.alias("label_error")))
    return out.join(listed(sums), out["label"].eqNullSafe(sums["same"])).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
