"""Contrastive mining: positives, hard and easy negatives from a vector ranking.

Only the part of a ranking that is used is ever formed: the bands by a top-k search,
the easy band, which is all the rest, by its size and by exact random draws from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.vectors import as_doubles, pair_distance, unit
from corpuslab.operators import nearest as nn
from corpuslab.operators.ordering import sorted_ordinal
from corpuslab.session import cut

# Default sizes and the score scale.
N_POS, GAP, N_NEG = 5, 0, 200
SCORE_SCALE, SCORE_SHIFT = 10.0, 0.01


def band_score(distance: Column) -> Column:
    return F.lit(SCORE_SCALE) / (distance + F.lit(SCORE_SHIFT))


def after_own_run(queries: DataFrame, docs: DataFrame, k: int, metric: str = "l2", mode: str = "distance") -> DataFrame:
    """The first k of each ranking once its leading run is removed.

    mode "distance": the run of documents at distance 0.
    mode "text":     the run of documents whose `key` (the text, or a hash of it)
                     equals the query's. A later equal document stays, so the run ends
                     at the first differing document. Of the differing documents the first k
                     count, which one search finds, and of the equal ones those after the first differing one,
                     for which only documents with the query's key are searched.
    A query whose every neighbour is in the run gives no rows.
    """
    if mode == "distance":
        return nn.nearest(queries, docs, k, metric, drop_zero=True)
    if mode != "text":
        raise ValueError(f"mode {mode!r} is not distance or text")
    others = cut(nn.nearest(queries, docs, k, metric, drop_same_key=True))
    first = others.where("rank = 1").select("query_id", F.col("distance").alias("after_distance"), F.col("doc_id").alias("after_id"))
    # Written once: the search reads its queries more than once.
    equal = cut(_after_equal(queries, docs, first, metric))
    held = _same_key(docs, equal.select("key").distinct())
    return nn.top(others.drop("rank").unionByName(nn.nearest(equal, held, k, metric, keep_rank=False, only_same_key=True)), k)


def _same_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """`rows` whose key is one of `keys`; no key is a key too."""
    return rows.join(keys.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_semi")


def _after_equal(queries: DataFrame, docs: DataFrame, first: DataFrame, metric: str) -> DataFrame:
    """`queries` with their `first`, but for those that have no equal document after it: in l2, if all vectors of
    a key are the same, its documents are at distance 0, before any that is not."""
    asked = queries.where("vec IS NOT NULL").join(first, "query_id")
    if metric != "l2":
        return asked
    held = docs.select("key", "vec").unionByName(queries.select("key", "vec")).where("vec IS NOT NULL")
    several = held.groupBy("key").agg(F.min("vec").alias("_least"), F.max("vec").alias("_most")).where("NOT _least <=> _most")
    zero = F.col("after_distance") <= 0
    return _same_key(asked.where(~zero), several).unionByName(asked.where(zero))


def mine_bands(
    queries: DataFrame, docs: DataFrame, n_pos: int = N_POS, gap: int = GAP, n_neg: int = N_NEG,
    metric: str = "l2", mode: str = "distance", keep_gap: bool = False,
) -> DataFrame:
    """(query_id, doc_id, distance, rank, band, score) with band `pos` or `hard`.

    The gap between them belongs to no band; with `keep_gap` its rows come as `gap`.
    """
    start = n_pos + gap
    ranked = after_own_run(queries, docs, start + n_neg, metric, mode)
    band = F.when(F.col("rank") <= n_pos, F.lit("pos")).when(F.col("rank") > start, F.lit("hard")).otherwise(F.lit("gap"))
    scored = ranked.withColumn("band", band).withColumn("score", band_score(F.col("distance")))
    return scored if keep_gap else scored.where("band <> 'gap'")


def easy_band_sizes(queries: DataFrame, docs: DataFrame, n_pos: int = N_POS, gap: int = GAP, n_neg: int = N_NEG) -> DataFrame:
    """Per query the first rank and the size of the easy band, mode distance.

    The length of a leading run is the number of copies of the query's vector, so
    documents are counted per vector before the join.
    """
    total = docs.count()
    copies = docs.groupBy("vec").agg(F.count("*").alias("run"))
    first = n_pos + gap + n_neg + 1
    run = F.coalesce("run", F.lit(0))
    return queries.join(copies, "vec", "left").select(
        "query_id",
        run.cast("bigint").alias("run"),
        F.lit(first).cast("bigint").alias("first_rank"),
        F.greatest(F.lit(total) - run - (first - 1), F.lit(0)).cast("bigint").alias("n_easy"),
    )


#: Half the bits of the largest corpus that draws number: 2**40 documents.
MOST_HALF = 20
# Multipliers and shifts of the rounds of `shuffled`.
MIX = (1103515245, 1540483477)
MIX_MODULUS, MIX_FOLD, MIX_LOW, KEY_DIGITS, ROUNDS = 1 << 31, 1 << 15, 1 << 11, 6, 4


def shuffled(place: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place-th number of a keyed permutation of 0..size-1, element by element.

    A Feistel network of `ROUNDS` rounds permutes the numbers of the next power of four; what falls
    outside is permuted again until it is inside, which takes under four steps on average.
    keys: one row of `ROUNDS` numbers below 2**24 for each element."""
    half = np.zeros(len(size), np.int64)
    while (short := (np.int64(1) << (2 * half)) < size).any():
        half[short] += 1
    if len(half) and half.max() > MOST_HALF:
        raise ValueError(f"more than 2**{2 * MOST_HALF} documents")
    out, open_ = place.astype(np.int64), np.arange(len(place))
    while len(open_):
        many = np.int64(1) << half[open_]
        left, right = out[open_] // many, out[open_] % many
        for i in range(ROUNDS):
            x = (right + keys[open_, i]) * MIX[0] % MIX_MODULUS
            x = (x ^ (x // MIX_FOLD)) * MIX[1] % MIX_MODULUS
            left, right = right, left ^ (x // MIX_LOW % many)
        out[open_] = left * many + right
        open_ = open_[out[open_] >= size[open_]]
    return out


def copy_key(vec: Column, metric: str) -> Column:
    """What copies of a vector have in common: the vector or, for cosine, its direction to 12 digits."""
    exact = as_doubles(vec) if metric != "cosine" else F.transform(unit(vec), lambda x: F.round(x, 12))
    return F.transform(exact, lambda x: x + F.lit(0.0))  # -0.0 is 0.0


def draw(
    draws: DataFrame, docs: DataFrame, n: int, seed: str, excluded: DataFrame | None = None,
    metric: str = "l2", skip_zero: bool = False,
) -> DataFrame:
    """n documents per draw, at random without replacement, outside `excluded`.

    draws:    draw_id, query_id, vec;  docs: doc_id, vec;  excluded: query_id, doc_id
    returns   draw_id, query_id, doc_id, distance, pick (1..n)

    A draw with fewer free documents gives all of them, in random order; without one it gives no row.
    With `skip_zero` copies of the query's vector (of its direction, for cosine) are not free.

    Documents are numbered with copies side by side, so those of a query are one interval whatever
    their number. A query's excluded numbers are sorted once; the j-th number that is free is found among them by
    binary search, and j runs through a keyed permutation of the free ones. So each draw is one pass of its own row,
    however much is excluded and however many documents there are; no (draw, document) table is formed.
    """
    key = copy_key(F.col("vec"), metric)
    if skip_zero:
        # Two hashes of 64 bits name a vector from here on.
        numbered = sorted_ordinal(docs.select("doc_id", key.alias("_v")).select("*", *_names(F.col("_v"))), ["_v", "doc_id"]).drop("_v")
        runs = numbered.groupBy("_k1", "_k2").agg(F.min("ordinal").alias("_a"), F.count("*").alias("_c"))
        asked = draws.select("draw_id", "query_id", *_names(key)).join(runs, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    else:
        numbered = sorted_ordinal(docs.select("doc_id"), ["doc_id"])
        asked = draws.select("draw_id", "query_id", F.lit(None).cast("bigint").alias("_a"), F.lit(None).cast("bigint").alias("_c"))
    if excluded is None:
        asked = asked.withColumn("_out", F.array().cast("array<bigint>"))
    else:
        taken = excluded.join(numbered.select("doc_id", "ordinal"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_set("ordinal")).alias("_out"))
        asked = asked.join(taken, "query_id", "left")
    total = docs.count()
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw_id").cast("string")))
    keys = F.array(*[F.conv(F.substring(digest, 1 + i * KEY_DIGITS, KEY_DIGITS), 16, 10).cast("bigint") for i in range(ROUNDS)])
    asked = asked.select("draw_id", "query_id", F.coalesce("_a", F.lit(total)).alias("_a"), F.coalesce("_c", F.lit(0)).alias("_c"), F.coalesce("_out", F.array().cast("array<bigint>")).alias("_out"), keys.alias("_keys"))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    picked = asked.mapInArrow(_picker(n, total), f"draw_id {kinds['draw_id']}, query_id {kinds['query_id']}, ordinal bigint, pick int").join(numbered.select("ordinal", "doc_id"), "ordinal").drop("ordinal")
    picked = picked.join(draws.select("draw_id", F.col("vec").alias("_qvec")), "draw_id").join(docs.select("doc_id", "vec"), "doc_id")
    distance = pair_distance(F.col("_qvec"), F.col("vec"), metric)
    return picked.select("draw_id", "query_id", "doc_id", distance.alias("distance"), "pick")


def _names(vec: Column) -> list[Column]:
    return [F.xxhash64(vec).alias("_k1"), F.xxhash64(F.lit(1), vec).alias("_k2")]


def _picker(n: int, total: int):
    """For draws (draw_id, query_id, start and length of the interval that is out, sorted numbers that are out,
    keys): their picks as numbers 0..total-1."""

    def run(batches):
        for batch in batches:
            start, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keys = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, ROUNDS)
            gaps = []
            for a, c, out in zip(start, length, batch.column(4)):
                out = np.array(out.as_py(), np.int64)
                out = out[(out < a) | (out >= a + c)]
                # Numbers without the interval; what is free below the i-th of them.
                gaps.append(np.where(out < a, out, out - c) - np.arange(len(out)))
            free = total - length - np.array([len(g) for g in gaps], np.int64)
            many = np.minimum(free, n)
            row = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            j = shuffled(place, free[row], keys[row])
            ends = np.cumsum(many)
            skipped = [np.searchsorted(g, j[e - m : e], "right") for g, e, m in zip(gaps, ends, many)]
            j = j + (np.concatenate(skipped) if skipped else 0)
            ordinal = np.where(j < start[row], j, j + length[row])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ordinal), pa.array(place + 1, pa.int32())], names=["draw_id", "query_id", "ordinal", "pick"])

    return run


def easy_draws(
    queries: DataFrame, docs: DataFrame, n: int, seed: str, n_pos: int = N_POS, gap: int = GAP, n_neg: int = N_NEG,
    metric: str = "l2",
) -> DataFrame:
    """n random easy negatives per query, or all of a smaller easy band: ranked behind all other bands (mode distance)."""
    near = nn.nearest(queries, docs, n_pos + gap + n_neg, metric, drop_zero=True)
    drawn = draw(
        queries.withColumn("draw_id", F.col("query_id").cast("string")), docs, n, seed, near, metric, skip_zero=True
    )
    return drawn.withColumn("score", band_score(F.col("distance")))


def mine_pos_neg(queries: DataFrame, docs: DataFrame, n: int = 5, seed: str = "12345", metric: str = "l2") -> DataFrame:
    """n nearest that are not copies, and n random ones ranked between the n+1 nearest
    and the very last. Random picks are never positives and never copies of the query; a query with fewer than n
    such documents gets all of them. Under ip a distance may be 0 without a copy: that pick has no score."""
    near = cut(after_own_run(queries, docs, n, metric))
    head = nn.nearest(queries, docs, n + 1, metric)
    last = nn.nearest(queries, docs, 1, metric, farthest=True)
    excluded = (
        head.select("query_id", "doc_id").union(near.select("query_id", "doc_id")).union(last.select("query_id", "doc_id"))
    )
    drawn = draw(
        queries.withColumn("draw_id", F.col("query_id").cast("string")), docs, n, seed, excluded, metric, skip_zero=True
    )
    pos = near.select(
        "query_id", "doc_id", F.lit("pos").alias("band"), F.col("rank").alias("slot"),
        band_score(F.col("distance")).alias("score"),
    )
    neg = drawn.select(
        "query_id", "doc_id", F.lit("neg").alias("band"), F.col("pick").alias("slot"),
        F.try_divide(F.lit(SCORE_SCALE), F.col("distance")).alias("score"),
    )
    return pos.unionByName(neg)
