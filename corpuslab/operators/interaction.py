"""Late interaction: scores of token matrices against token matrices.

Token tables have one row per token: (text_id, pos, vec [, keep]). Matrices are cut into
pieces of bounded length, so a text of any size is spread over rows. A score is
built from per-piece maxima, which combine by max over pieces and then by sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.nearest import _SHORT_MOST, _folded, _id_type, _ids, _share, _unfolded, dealt, passed, top
from corpuslab.session import cut

PIECE = 64
# Score of a query token no document token counts for; sizes of the
# split variant (query length, best of the first part, best of the rest).
NO_TOKEN = -9999.0
SPLIT_LENGTH, SPLIT_FIRST, SPLIT_REST = 64, 32, 8


def pieces(tokens: DataFrame, text_id: str, name: str, masked: bool = True, by: list[str] | None = None) -> DataFrame:
    """(text_id, first, <name>) rows: up to PIECE token vectors in order, from place `first`.

    With `masked`, tokens whose `keep` is false drop out, but a piece left empty stays.
    """
    kept = F.col("keep") if masked and "keep" in tokens.columns else F.lit(True)
    item = F.when(kept, F.struct("pos", "vec"))
    return (
        tokens.withColumn("first", (F.floor(F.col("pos") / PIECE) * PIECE).cast("int"))
        .groupBy(text_id, *(by or []), "first")
        .agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["vec"]).alias(name))
    )


def _ragged(table: pa.Table, name: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Matrices held in a column of nested lists, one per row, and their numbers of vectors."""
    column = table.column(name).combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = np.asarray(column.flatten().flatten(), dtype=np.float64)
    rows = flat.reshape(int(sizes.sum()), -1) if len(flat) else flat.reshape(0, 0)
    return np.split(rows, np.cumsum(sizes)[:-1]) if len(sizes) else [], sizes


def _piece_maxima(metric: str, out: pa.Schema):
    """Per row of (.., q, d): the best value of each vector of q over the vectors of d."""
    def one(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(right):
            return np.full(len(left), NO_TOKEN)
        if metric == "l2":
            return (-((left[:, None, :] - right[None, :, :]) ** 2).sum(-1)).max(axis=1)
        return (left @ right.T).max(axis=1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            (left, sizes), (right, _) = (_ragged(table, c) for c in ("q", "d"))
            values = np.concatenate([one(a, b) for a, b in zip(left, right)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            best = pa.ListArray.from_arrays(offsets, pa.array(values))
            kept = [table.column(c).combine_chunks() for c in out.names[:-1]]
            yield pa.table([*kept, best], names=out.names).cast(out).to_batches()[0]

    return run


def token_maxima(pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, metric: str = "dot") -> DataFrame:
    """(query_id, doc_id, pos, best) for each pair and query token: the best value over
    the document's tokens. The document mask counts for the dot product only."""
    q = pieces(query_tokens, "query_id", "q", masked=False).withColumnRenamed("first", "q_first")
    d = pieces(doc_tokens, "doc_id", "d", masked=metric != "l2").drop("first")
    met = pairs.select("query_id", "doc_id").distinct().join(q, "query_id").join(d, "doc_id")
    ids = ["query_id", "doc_id"]
    types = {c: met.schema[c].dataType.simpleString() for c in ids}
    out = pa.schema(
        [*((c, _id_type(met, c)) for c in ids), ("q_first", pa.int32()), ("best", pa.list_(pa.float64()))]
    )
    ddl = ", ".join(f"{c} {types[c]}" for c in ids) + ", q_first int, best array<double>"
    scored = met.select(*ids, "q_first", "q", "d").mapInArrow(_piece_maxima(metric, out), ddl)
    best = scored.select(*ids, "q_first", F.posexplode("best").alias("_i", "best"))
    return best.groupBy("query_id", "doc_id", (F.col("q_first") + F.col("_i")).alias("pos")).agg(
        F.max("best").alias("best")
    )


def maxsim(pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame, metric: str = "dot") -> DataFrame:
    """Score per pair: the best value per query token, summed. `dot` on unit vectors is
    the cosine form, `l2` uses negative squared distances."""
    return token_maxima(pairs, query_tokens, doc_tokens, metric).groupBy("query_id", "doc_id").agg(
        F.sum("best").alias("score")
    )


def maxsim_split(
    pairs: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame,
    length: int = SPLIT_LENGTH, n_first: int = SPLIT_FIRST, n_rest: int = SPLIT_REST,
) -> DataFrame:
    """Best `n_first` of the first `length` query tokens plus the best `n_rest` of the
    others, the latter only if there are that many."""
    best = token_maxima(pairs, query_tokens, doc_tokens).withColumn("rest", F.col("pos") >= length)
    # A query has as many rows as tokens, which padding bounds.
    w = Window.partitionBy("query_id", "doc_id", "rest")
    ranked = best.withColumn("r", F.row_number().over(w.orderBy(F.col("best").desc(), "pos"))).withColumn(
        "n", F.count("*").over(w)
    )
    chosen = (~F.col("rest") & (F.col("r") <= n_first)) | (F.col("rest") & (F.col("n") >= n_rest) & (F.col("r") <= n_rest))
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(F.when(chosen, F.col("best"))).alias("score"))


def candidate_pairs(neighbours: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """Documents owning one of the nearest tokens of any token of the query.

    neighbours: token-level (query_id, doc_id) as found between token ids.
    query_tokens / doc_tokens: (token_id, text_id).
    """
    q = query_tokens.select(F.col("token_id").alias("query_id"), F.col("text_id").alias("_q"))
    d = doc_tokens.select(F.col("token_id").alias("doc_id"), F.col("text_id").alias("_d"))
    return (
        neighbours.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
        .select(F.col("_q").alias("query_id"), F.col("_d").alias("doc_id")).distinct()
    )


def best_by_maxsim(scores: DataFrame, k: int) -> DataFrame:
    """Top k documents per query by score, as (query_id, doc_id, score, rank)."""
    ranked = top(scores.withColumn("distance", -F.col("score")), k)
    return ranked.drop("distance")


BLOCK_TOKENS = 65_536
#: A block of queries holds this part of a block of documents: it sets how long one pair of blocks takes.
QUERY_PART = 8


def _matrices(tokens: DataFrame, text_id: str, masked: bool, by: list[str] | None) -> DataFrame:
    """(text_id, by.., m): all token vectors of a text in order, without masked ones."""
    parts = pieces(tokens, text_id, "m", masked, by)
    return parts.groupBy(text_id, *(by or [])).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "m"))), lambda x: x["m"])).alias("m")
    )


def _blocks(df: DataFrame, column: str, items: int) -> int:
    """Blocks that hold at most `items` elements of an array column each, were all as long as the longest."""
    size = df.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("longest")).first()
    return max(1, -(-size.n * (size.longest or 1) // items))


def rerank_all(
    query_tokens: DataFrame, doc_tokens: DataFrame, k: int, block_tokens: int = BLOCK_TOKENS, by: list[str] | None = None
) -> DataFrame:
    """Top k of the whole collection by MaxSim, exact. With `by`, only documents that agree
    on these columns, of the text as a whole, compete.

    As in the vector search, blocks of queries meet blocks of documents in a kernel that
    passes on k rows per query. Blocks are bounded in tokens: so many texts a block as hold
    `block_tokens` tokens if all were as long as the longest. A document is one array of its
    kept tokens here, as the windows of the padding step are.
    """
    q, d = cut(_matrices(query_tokens, "query_id", False, by)), cut(_matrices(doc_tokens, "doc_id", True, by))
    n_q, n_d = _blocks(q, "m", max(1, block_tokens // QUERY_PART)), _blocks(d, "m", block_tokens)
    q = q.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn(
        "_db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1)))
    )
    d = d.withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint")))
    )
    keys = [*(by or []), "_qb", "_db"]
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (d, "doc_id"))}

    out = pa.schema([("query_id", _id_type(q, "query_id")), ("doc_id", _id_type(d, "doc_id")), ("distance", pa.float64())])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, _ = _ragged(left, "m")
        held_tokens, sizes = _ragged(right, "m")
        ids, held = _ids(right, "doc_id"), np.flatnonzero(sizes)
        starts = np.cumsum(sizes[held]) - sizes[held]
        tokens = np.concatenate([held_tokens[i] for i in held]) if len(held) else None
        found = []
        for query_id, matrix in zip(_ids(left, "query_id"), asked):
            score = np.full(len(ids), NO_TOKEN * len(matrix))
            if len(held):
                best = np.maximum.reduceat(tokens @ matrix.T, starts, axis=0)
                score[held] = best.sum(axis=1)
            some = np.flatnonzero(~(-score > np.partition(-score, k - 1)[k - 1])) if k < len(score) else np.arange(len(score))
            order = some[np.lexsort((ids[some], -score[some]))[:k]]
            found.append((np.full(len(order), query_id), ids[order], -score[order]))
        columns = [np.concatenate(x) for x in zip(*found)] if found and len(ids) else [[], [], []]
        return pa.table(dict(zip(out.names, columns))).cast(out)

    q, d = dealt(q, d, n_q * n_d, keys)
    best = (
        q.groupBy(*keys).cogroup(d.groupBy(*keys))
        .applyInArrow(kernel, f"query_id {types['query_id']}, doc_id {types['doc_id']}, distance double")
    )
    return top(best, k).select("query_id", "doc_id", (-F.col("distance")).alias("score"), "rank")


def _sketched(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """`docs` with cells (those of its tokens' nearest centres) and reach (the largest distance
    of its tokens there to the centre). Row by row."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrices, _ = _ragged(pa.Table.from_batches([batch]), "m")
            cells, reach = [], []
            for m in matrices:
                if not len(m):
                    cells.append([])
                    reach.append([])
                    continue
                own = (0.5 * (centres * centres).sum(axis=1) - m @ centres.T).argmin(axis=1)
                far = np.sqrt(((m - centres[own]) ** 2).sum(axis=1))
                held, place = np.unique(own, return_inverse=True)
                most = np.zeros(len(held))
                np.maximum.at(most, place, far)
                cells.append(held.tolist())
                reach.append(most.tolist())
            added = [pa.array(cells, pa.list_(pa.int32())), pa.array(reach, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "cells", "reach"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, kinds + ", cells array<int>, reach array<double>")


#: Query tokens and document tokens that are multiplied at a time.
ASKED_TOKENS, HELD_TOKENS = 256, 4096


def _chunks(sizes: np.ndarray, most: int):
    """Ends of stretches that hold `most` items or one row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def _short(*tables: np.ndarray) -> bool | None:
    """Whether short numbers hold the products of these rows; None if some are not finite."""
    most = [float(np.square(x).sum(axis=1).max(initial=0.0)) if x.size else 0.0 for x in tables]
    return max(most) < _SHORT_MOST if np.isfinite(most).all() else None


def _maxima(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest of stretches of so many rows, none of them empty, column by column. Stretches of one size side by side are taken at once."""
    out, at = np.empty((len(sizes), values.shape[1]), values.dtype), 0
    ends = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
    for lo, hi in zip(ends, ends[1:]):
        rows = (hi - lo) * int(sizes[lo])
        values[at : at + rows].reshape(hi - lo, int(sizes[lo]), -1).max(axis=1, out=out[lo:hi])
        at += rows
    return out


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of stretches of so many columns each, none of them empty, as rows."""
    rows = np.ascontiguousarray(values.T)
    if (sizes == sizes[0]).all():
        return rows.reshape(len(sizes), int(sizes[0]), -1).sum(axis=1, dtype=np.float64)
    return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)


def _bounds(asked: list[np.ndarray], centres: np.ndarray, cells: np.ndarray, reach: np.ndarray, sizes: np.ndarray, wide: bool):
    """For each query matrix the upper bound of its score with every sketched document or, unless `wide`, the estimate.

    q . t = q . c + q . (t - c) is at most q . c + |q| reach for a token t of a cell with centre c; a score is the
    sum over q of the largest q . t, so the sum of the largest bounds is not below it. Short numbers add their error to the bound."""
    # Documents of as many cells come side by side.
    held, lengths = np.argsort(sizes, kind="stable")[np.count_nonzero(sizes == 0) :], np.array([len(m) for m in asked], int)
    many_cells = sizes[held]
    place = np.repeat((np.cumsum(sizes) - sizes)[held] - (np.cumsum(many_cells) - many_cells), many_cells) + np.arange(int(many_cells.sum()))
    cells, reach = cells[place], reach[place]
    far = float(np.max(reach, initial=0.0))
    for lo, hi in _chunks(lengths, ASKED_TOKENS):
        bounds = np.repeat(NO_TOKEN * lengths[lo:hi, None].astype(float), len(sizes), axis=1)
        full = np.flatnonzero(lengths[lo:hi])
        if len(held) and len(full):
            tokens = np.concatenate([asked[lo + i] for i in full])
            norms, many = np.sqrt((tokens * tokens).sum(axis=1)), lengths[lo + full]
            kind = np.float32 if _short(tokens, centres) and np.isfinite(far) and far * far < _SHORT_MOST else np.float64
            near, norms_of = (centres @ tokens.T).astype(kind), norms.astype(kind)
            rim = reach.astype(kind)[:, None]
            found, begin, room = np.empty((len(full), len(held))), 0, None
            for first, last in _chunks(sizes[held], HELD_TOKENS):
                n = sizes[held[first:last]]
                end = begin + int(n.sum())
                part = near[cells[begin:end]]
                if wide:
                    if room is None or len(room) < len(part):
                        room = np.empty_like(part)
                    part += np.multiply(rim[begin:end], norms_of, out=room[: len(part)])
                found[:, first:last] = _sums(_maxima(part, n), many)
                begin = end
            if wide and kind is np.float32:
                most = float(np.sqrt((centres * centres).sum(axis=1).max(initial=0.0))) + far
                found += (_share(tokens.shape[1]) * most * np.add.reduceat(norms, np.cumsum(many) - many))[:, None]
            bounds[np.ix_(full, held)] = found
        yield from bounds


def _met(q: DataFrame, d: DataFrame, n_q: int, n_d: int, by: list[str], kernel, ddl: str) -> DataFrame:
    """Blocks of queries (with _qb) beside blocks of sketches, each pair of blocks once."""
    left = q.withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    right = d.select("doc_id", *by, "cells", "reach", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int").alias("_db"))
    right = right.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    keys = [*by, "_qb", "_db"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, ddl)


def _scored(wanted: DataFrame, q: DataFrame, d: DataFrame, n_d: int, by: list[str], k: int, types: dict[str, str], out: pa.Schema) -> DataFrame:
    """Exact scores of `wanted` (query_id, doc_id, _qb, bound): the k best of each pair of blocks.

    A document goes once to each block of queries that wants it. There a query takes its documents by falling bound,
    and ends once the next bound is below the k-th score that it has."""
    asking = wanted.groupBy("doc_id", "_qb").agg(F.collect_list(F.struct("query_id", "bound")).alias("asking"))
    right = asking.join(d.select("doc_id", *by, "m"), "doc_id").withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int"))
    left = q.withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    keys = [*by, "_qb", "_db"]

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        wants = right.column("asking").combine_chunks()
        docs = np.repeat(np.arange(len(wants)), wants.value_lengths().to_numpy(zero_copy_only=False).astype(int))
        flat = wants.flatten()
        who = np.asarray(flat.field("query_id").to_pylist() if len(flat) else [], dtype=object)
        bound = flat.field("bound").to_numpy(zero_copy_only=False) if len(flat) else np.empty(0)
        matrices, _ = _ragged(right, "m")
        ids = _ids(right, "doc_id")
        asked, _ = _ragged(left, "m")
        of = {query_id: i for i, query_id in enumerate(left.column("query_id").to_pylist())}
        order = np.lexsort((-bound, [of[x] for x in who])) if len(who) else []
        best: dict[int, list] = {}
        for at in order:
            i = of[who[at]]
            kept = best.setdefault(i, [])
            if len(kept) >= k and bound[at] < kept[k - 1][0] - SLACK * (1 + abs(kept[k - 1][0])):
                continue
            matrix, tokens = asked[i], matrices[docs[at]]
            score = float((tokens @ matrix.T).max(axis=0).sum()) if len(tokens) else NO_TOKEN * len(matrix)
            kept.append((score, ids[docs[at]]))
            kept.sort(key=lambda x: (-x[0], x[1]))
            del kept[k:]
        rows = [(left.column("query_id")[i].as_py(), doc, -score) for i, kept in best.items() for score, doc in kept]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({n: pa.array([x.item() if hasattr(x, "item") else x for x in c], t) for n, c, t in zip(out.names, columns, out.types)})

    ddl = f"query_id {types['query_id']}, doc_id {types['doc_id']}, distance double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, ddl)


#: Bounds are compared with this relative slack, as sums of doubles are rounded.
SLACK = 1e-9
#: Documents that a query takes at once by falling bound.
TAKEN = 1024


def _sketches(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells_of = right.column("cells").combine_chunks()
    reach = right.column("reach").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return cells_of.flatten().to_numpy(zero_copy_only=False), reach, cells_of.value_lengths().to_numpy(zero_copy_only=False).astype(int)


def _within(bound: np.ndarray, floor: float) -> np.ndarray:
    """Whether a bound reaches the floor; every one does where there is none (-inf)."""
    return bound >= floor - SLACK * (1 + abs(floor)) if np.isfinite(floor) else np.ones(len(bound), bool)


def _best_within(matrix: np.ndarray, floor: float, bound: np.ndarray, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, k: int, best: list | None = None) -> list:
    """The k best (score, id) of one query among documents whose bound reaches the floor, taken by falling bound until
    none reaches the k-th score; `best` are those it has from before. One product of many documents only nominates; what comes near is scored by itself, so copies score alike."""
    def near(least: float) -> float:
        return least - SLACK * (1 + abs(least))

    some = np.flatnonzero(_within(bound, floor))
    some = some[np.argsort(-bound[some], kind="stable")]
    best = list(best or [])
    for lo in range(0, len(some), TAKEN):
        if len(best) >= k and bound[some[lo]] < near(best[k - 1][0]):
            break
        part = some[lo : lo + TAKEN]
        score = np.full(len(part), NO_TOKEN * len(matrix))
        full = np.flatnonzero(sizes[part])
        if len(full):
            n = sizes[part[full]]
            ends = np.cumsum(n)
            rows = np.arange(ends[-1]) + np.repeat(starts[part[full]] - (ends - n), n)
            score[full] = np.maximum.reduceat(tokens[rows] @ matrix.T, ends - n, axis=0).sum(axis=1)
        least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
        least = max(least, best[k - 1][0]) if len(best) >= k else least
        for at in part[score >= near(least)] if np.isfinite(least) else part:
            own = tokens[starts[at] : starts[at] + sizes[at]]
            best.append((float((own @ matrix.T).max(axis=0).sum()) if len(own) else NO_TOKEN * len(matrix), ids[at]))
        best.sort(key=lambda x: (-x[0], x[1]))
        del best[k:]
    return best


#: Share of the pairs that bounds must leave out for these to be worth their time.
SPARED = 0.5


class _Asked:
    """A block of queries that meets one block of documents after the other, and the k best of each so far."""

    def __init__(self, left: pa.Table, k: int, centres: np.ndarray):
        self.k, self.centres = k, centres
        self.ids, (matrices, self.sizes) = _ids(left, "query_id"), _ragged(left, "m")
        self.asked = [np.array(m) for m in matrices]
        self.floors = left.column("floor").to_numpy(zero_copy_only=False).astype(float)
        self.best: list[list] = [[] for _ in self.asked]

    def least(self, i: int) -> float:
        """What a score has to reach to count."""
        return max(self.floors[i], self.best[i][-1][0]) if len(self.best[i]) >= self.k else self.floors[i]

    def meet(self, right: pa.Table) -> None:
        # Documents of as many tokens come side by side.
        right = right.take(pa.array(np.argsort(_ragged(right, "m")[1], kind="stable")))
        ids, (matrices, sizes) = _ids(right, "doc_id"), _ragged(right, "m")
        if not len(ids) or not len(self.asked):
            return
        held = [m for m in matrices if len(m)]
        tokens, starts = np.concatenate(held) if held else np.empty((0, 0)), np.cumsum(sizes) - sizes
        sketches = _sketches(right)
        short = _short(*self.asked, tokens) if min(self.sizes) else None
        if short is None or self.spared(sketches) >= SPARED:
            for i, bound in enumerate(_bounds(self.asked, self.centres, *sketches, True)):
                self.best[i] = _best_within(self.asked[i], self.least(i), bound, tokens, starts, sizes, ids, self.k, self.best[i])
        else:
            self.multiply(tokens, starts, sizes, ids, np.float32 if short else np.float64)

    def spared(self, sketches: tuple) -> float:
        """The share of the pairs of some queries that their bounds leave out."""
        lo, hi = next(_chunks(self.sizes, ASKED_TOKENS))
        found = [1 - _within(b, self.least(i)).mean() for i, b in zip(range(lo, hi), _bounds(self.asked[lo:hi], self.centres, *sketches, True))]
        return float(np.mean(found))

    def multiply(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, kind: type) -> None:
        """Scores of all pairs by products of many tokens, which only nominate: what may be among the k best is scored by itself."""
        full = np.flatnonzero(sizes)
        rows = tokens.astype(kind)
        longest = float(np.sqrt(np.square(tokens).sum(axis=1).max(initial=0.0))) if tokens.size else 0.0
        share = _share(tokens.shape[1]) if kind is np.float32 else 1e-11
        for lo, hi in _chunks(self.sizes, ASKED_TOKENS):
            asked = np.concatenate(self.asked[lo:hi])
            norms = np.add.reduceat(np.sqrt((asked * asked).sum(axis=1)), np.cumsum(self.sizes[lo:hi]) - self.sizes[lo:hi])
            eps = share * (longest * norms + 1e-30) + SLACK
            side = np.ascontiguousarray(asked.astype(kind).T)
            for first, last in _chunks(sizes[full], HELD_TOKENS):
                some = full[first:last]
                n = sizes[some]
                begin, end = starts[some[0]], starts[some[-1]] + n[-1]
                score = _sums(_maxima(rows[begin:end] @ side, n), self.sizes[lo:hi])
                self.nominated(lo, score, eps, some, tokens, starts, sizes, ids)
            empty = np.flatnonzero(sizes == 0)
            if len(empty):
                score = np.repeat(NO_TOKEN * self.sizes[lo:hi, None].astype(float), len(empty), axis=1)
                self.nominated(lo, score, np.full(hi - lo, SLACK), empty, tokens, starts, sizes, ids)

    def nominated(self, lo: int, score: np.ndarray, eps: np.ndarray, some: np.ndarray, tokens, starts, sizes, ids) -> None:
        least = np.array([self.least(lo + i) for i in range(len(score))])
        # What no score reaches as yet (-inf) has no slack.
        limit = np.where(np.isfinite(least), least - SLACK * (1 + np.abs(least)) - eps, -np.inf)
        if score.shape[1] > self.k:
            own = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            limit = np.maximum(limit, own - 2 * eps - SLACK * (1 + np.abs(own)))
        at, cols = np.divmod(np.flatnonzero(score >= limit[:, None]), score.shape[1])
        order = np.lexsort((-score[at, cols], at))
        for i, col in zip(at[order].tolist(), cols[order].tolist()):
            best, matrix, doc = self.best[lo + i], self.asked[lo + i], some[col]
            if len(best) >= self.k and score[i, col] + eps[i] < best[-1][0] - SLACK * (1 + abs(best[-1][0])):
                continue
            own = tokens[starts[doc] : starts[doc] + sizes[doc]]
            exact = float((own @ matrix.T).max(axis=0).sum()) if len(own) else NO_TOKEN * len(matrix)
            best.append((exact, ids[doc]))
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[self.k :]

    def found(self, out: pa.Schema) -> pa.Table:
        rows = [(i, x) for i, best in enumerate(self.best) for x in best]
        columns = [pa.array(self.ids[[i for i, _ in rows]]), pa.array([x[1].item() if hasattr(x[1], "item") else x[1] for _, x in rows], out.types[1]), pa.array([-x[0] for _, x in rows], pa.float64())]
        return pa.table(dict(zip(out.names, columns))).cast(out) if rows else out.empty_table()


def rerank_pruned(
    query_tokens: DataFrame, doc_tokens: DataFrame, k: int, cells: int = 256, block_tokens: int = BLOCK_TOKENS,
    by: list[str] | None = None, seed: int = 17, counted: dict | None = None,
) -> DataFrame:
    """Top k of the whole collection by MaxSim, exact, without scoring all documents: the rows of `rerank_all`.

    Document tokens belong to the cell of their nearest centre, and a document's sketch is the cells of its tokens
    and how far they lie from the centres. Sketches alone meet all queries. A first round scores the k documents
    of the best estimates, whose k-th score is a floor; a second one takes the documents whose upper bound reaches
    the floor by falling bound until no bound reaches the k-th score so far. In data without clusters that may be nearly all of them; where
    bounds spare less than half of the pairs, all are scored by products of many tokens at once, and the result
    is the same. Pairs are never listed: a task holds two blocks. Tokens are packed in blocks, which are read for each block of queries, not copied;
    with one block of queries, or with `by`, tokens move only for documents that a block of queries still wants.

    Centres, at most `cells` tokens, are fetched and go along with the tasks. `counted` gets the numbers of pairs
    (`scored` at most, of `all`).
    """
    by = by or []
    q, d = _matrices(query_tokens, "query_id", False, by), cut(_matrices(doc_tokens, "doc_id", True, by))
    sample = d.select("doc_id", F.posexplode("m").alias("pos", "vec")).orderBy(F.xxhash64("doc_id", "pos", F.lit(seed)), "doc_id", "pos").limit(cells)
    picked = sample.select("vec").collect()
    if not picked:
        return rerank_all(query_tokens, doc_tokens, k, block_tokens, by)
    centres = np.stack([np.asarray(r.vec, dtype=np.float64) for r in picked])
    d = cut(_sketched(d, centres))
    q = cut(q)
    n_q, n_d, n_sketch = _blocks(q, "m", max(1, block_tokens // QUERY_PART)), _blocks(d, "m", block_tokens), _blocks(d, "cells", block_tokens)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("_qb")
    q = q.select("*", block)
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((q, "query_id"), (d, "doc_id"))}
    out = pa.schema([("query_id", _id_type(q, "query_id")), ("doc_id", _id_type(d, "doc_id")), ("distance", pa.float64())])

    def made(found: list) -> pa.Table:
        columns = [np.concatenate(x) for x in zip(*found)] if found else [[], [], []]
        return pa.table(dict(zip(out.names, columns))).cast(out)

    def promising(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, ids, found = _ragged(left, "m")[0], _ids(right, "doc_id"), []
        for query_id, estimate in zip(_ids(left, "query_id"), _bounds(asked, centres, *_sketches(right), False)):
            some = np.flatnonzero(~(-estimate > np.partition(-estimate, k - 1)[k - 1])) if k < len(estimate) else np.arange(len(estimate))
            order = some[np.lexsort((ids[some], -estimate[some]))[:k]]
            found.append((np.full(len(order), query_id), ids[order], -estimate[order]))
        return made(found if len(ids) else [])

    def reaching(left: pa.Table, right: pa.Table) -> pa.Table:
        """How many queries of the block each document may matter to: no table of pairs."""
        asked, n = _ragged(left, "m")[0], np.zeros(right.num_rows, np.int64)
        for floor, bound in zip(left.column("floor").to_numpy(zero_copy_only=False), _bounds(asked, centres, *_sketches(right), True)):
            n += _within(bound, floor)
        of = left.column("_qb")[0].as_py() if left.num_rows else 0
        some = np.flatnonzero(n)
        return pa.table({"doc_id": right.column("doc_id").take(pa.array(some)), "_qb": pa.array(np.full(len(some), of), pa.int32()), "n": pa.array(n[some])})

    def scoring(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        block = _Asked(left, k, centres)
        block.meet(right)
        return block.found(out)

    def past(batches):
        blocks: dict[int, _Asked] = {}
        for batch in batches:
            for at, asked, held in zip(*batch.columns):
                if at.as_py() not in blocks:
                    blocks[at.as_py()] = _Asked(_unfolded(asked), k, centres)
                blocks[at.as_py()].meet(_unfolded(held))
        for block in blocks.values():
            yield from block.found(out).to_batches()

    def packed(key: str, name: str):
        def run(table: pa.Table) -> pa.Table:
            return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.int32()), name: pa.array([_folded(table.drop_columns([key]))], pa.binary())})

        return run

    ddl = f"query_id {types['query_id']}, doc_id {types['doc_id']}, distance double"
    first = cut(top(_met(q, d, n_q, n_sketch, by, promising, ddl), k))
    wanted = first.select("query_id", "doc_id", block, F.lit(float("inf")).alias("bound"))
    floors = cut(_scored(wanted, q, d, n_d, by, k, types, out)).groupBy("query_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
    floor = F.when(F.col("_n") >= k, -F.col("_far")).otherwise(F.lit(float("-inf")))
    # What grows with the texts is merged; files of ids are far smaller than their rows.
    q2 = cut(q.join(floors.select("query_id", floor.alias("floor")).hint("merge"), "query_id", "left").fillna(float("-inf"), ["floor"]))
    streamed = n_q > 1 and not by
    if counted is not None or not streamed:
        wanted = cut(_met(q2, d, n_q, n_sketch, by, reaching, f"doc_id {types['doc_id']}, _qb int, n bigint"))
    if counted is not None:
        counted |= {"scored": (wanted.agg(F.sum("n")).first()[0] or 0) + first.count(), "all": q.count() * d.count()}
    held = d.select("doc_id", *by, "m", "cells", "reach", F.pmod(F.xxhash64("doc_id"), F.lit(n_d)).cast("int").alias("_db"))
    if streamed:
        asked = q2.select("query_id", "m", "floor", "_qb").groupBy("_qb").applyInArrow(packed("_qb", "asked"), "_qb int, asked binary")
        held = held.groupBy("_db").applyInArrow(packed("_db", "held"), "_db int, held binary")
        best = top(passed(held, asked, n_q, n_d, past, ddl), k)
    else:
        right = wanted.select("doc_id", "_qb").distinct().join(held.hint("merge"), "doc_id")
        left = q2.withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
        keys = [*by, "_qb", "_db"]
        best = top(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scoring, ddl), k)
    return best.select("query_id", "doc_id", (-F.col("distance")).alias("score"), "rank")
