"""Training groups, epochs, shards, batches; length buckets, padding and token masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators import mining
from corpuslab.operators.ordering import hashed_ordinal, order_key
from corpuslab.session import cut

# Fixed values.
NWAY, EASY_NWAY = 32, 5
STRIDE_QUANTILES = [0.5, 0.75, 0.9, 0.95]
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
CLS, SEP, PAD, MASK_TOKEN = "[CLS]", "[SEP]", "[PAD]", "[MASK]"
DOC_MARKER, QUERY_MARKER = "[D]", "[Q]"
FULL_LENGTH_LIMIT = 500


def _quota(nway: int, easy_nway: int) -> int:
    if not 0 <= easy_nway < nway - 1:
        raise ValueError(f"easy_nway {easy_nway} must be below nway - 1 = {nway - 1}")
    return nway - 1 - easy_nway


def nway_groups(
    bands: DataFrame, queries: DataFrame, docs: DataFrame, nway: int = NWAY, easy_nway: int = EASY_NWAY,
    seed: str = "12345", epoch: int = 0, metric: str = "l2",
) -> DataFrame:
    """One group per positive: (query_id, pos_id, slot, doc_id, score).

    Slot 0 is the positive, then random hard negatives, then random easy ones, without
    replacement. `bands` comes from mine_bands, with its gap rows if there is a gap:
    what it lists, and copies of the query, is not easy. A query short of negatives is
    an error.
    """
    hard_quota = _quota(nway, easy_nway)
    seed, bands = f"{seed}|{epoch}", cut(bands)
    pairs = bands.where("band = 'pos'").select("query_id", F.col("doc_id").alias("pos_id"), F.col("score").alias("pos_score"))
    hard = bands.where("band = 'hard'").select("query_id", "doc_id", "score")
    w = Window.partitionBy("query_id", "pos_id").orderBy(order_key(seed, "query_id", "pos_id", "doc_id"))
    hard_rows = (
        pairs.join(hard, "query_id")
        .withColumn("slot", F.row_number().over(w))
        .where(F.col("slot") <= hard_quota)
        .select("query_id", "pos_id", "slot", "doc_id", "score")
    )
    named = pairs.withColumn("draw_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("pos_id").cast("string")))
    drawn = mining.draw(
        named.join(queries.select("query_id", "vec"), "query_id"), docs, easy_nway, seed,
        bands.select("query_id", "doc_id"), metric, skip_zero=True,
    )
    easy_rows = drawn.join(named.select("draw_id", "pos_id"), "draw_id").select(
        "query_id", "pos_id", (F.col("pick") + hard_quota).alias("slot"), "doc_id",
        mining.band_score(F.col("distance")).alias("score"),
    )
    first = pairs.select("query_id", "pos_id", F.lit(0).alias("slot"), F.col("pos_id").alias("doc_id"), F.col("pos_score").alias("score"))
    rows = first.unionByName(hard_rows).unionByName(easy_rows)
    size = F.count("*").over(Window.partitionBy("query_id", "pos_id"))
    complete = F.when(size == nway, F.col("slot")).otherwise(
        F.raise_error(F.concat(F.lit("too few negatives for query "), F.col("query_id").cast("string"))).cast("int")
    )
    return rows.withColumn("slot", complete)


def attach_texts(groups: DataFrame, query_texts: DataFrame, doc_texts: DataFrame) -> DataFrame:
    """Join query text and document text by id (query_id, query) and (doc_id, doc)."""
    return groups.join(query_texts, "query_id").join(doc_texts, "doc_id")


def epoch_order(pairs: DataFrame, keys: list[str], seed: str, epoch: int, digits: int = 3) -> DataFrame:
    """A reproducible shuffle per epoch: dense 0-based `ordinal`."""
    return hashed_ordinal(pairs, keys, f"{seed}|{epoch}", digits=digits)


def batches(ordered: DataFrame, total: int, bsize: int, nranks: int = 1, accumsteps: int = 1) -> DataFrame:
    """Shard by rank, cut into batches and micro-batches. `complete` is false in the last
    batch of a rank if it is not full; training leaves that one out."""
    if bsize % accumsteps:
        raise ValueError("bsize must be a multiple of accumsteps")
    rank = F.pmod("ordinal", F.lit(nranks))
    place = F.floor(F.col("ordinal") / nranks)
    in_rank = F.floor((F.lit(total) - 1 - F.col("rank")) / nranks) + 1
    micro = bsize // accumsteps
    return (
        ordered.withColumn("rank", rank)
        .withColumn("_place", place)
        .withColumn("batch", F.floor(F.col("_place") / bsize))
        .withColumn("complete", F.col("batch") < F.floor(in_rank / bsize))
        .withColumn("place", F.pmod("_place", F.lit(bsize)))
        .withColumn("micro_batch", F.floor(F.col("place") / micro))
        .drop("_place")
    )


def sort_by_length(rows: DataFrame, group: list[str], length: str, order: str, bsize: int) -> DataFrame:
    """Inside each group of bounded size: place by length, and the old place to go back.
    A group that fits one batch keeps its order."""
    size = F.count("*").over(Window.partitionBy(*group))
    old = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    new = F.row_number().over(Window.partitionBy(*group).orderBy(length, order)) - 1
    return (
        rows.withColumn("old_place", old)
        .withColumn("new_place", F.when(size > bsize, new).otherwise(old))
        .withColumn("length_batch", F.floor(F.col("new_place") / bsize))
    )


def length_buckets(rows: DataFrame, length: str, quantiles: list[float] = STRIDE_QUANTILES) -> DataFrame:
    """Smallest bucket that holds each row. Buckets: whole parts of the interpolated
    quantiles, and the maximum; these few numbers are fetched first. Lengths are counted
    before, so the exact quantiles work on one row per distinct length."""
    counted = rows.groupBy(length).agg(F.count("*").alias("_rows"))
    bounds = counted.agg(
        F.expr(f"percentile({length}, array({','.join(map(str, quantiles))}), _rows)").alias("q"), F.max(length).alias("m")
    ).first()
    if bounds.m is None:
        return rows.withColumn("bucket", F.lit(None).cast("bigint"))
    buckets = sorted({*(int(x) for x in bounds.q), int(bounds.m)})
    fitting = [F.when(F.col(length) <= b, F.lit(b).cast("bigint")) for b in buckets]
    return rows.withColumn("bucket", F.coalesce(*fitting))


def word_tokens(text: Column) -> Column:
    """Lower-case words and single symbols; stands in for an external tokenizer."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


def windows(tokens: Column, size: Column | int) -> Column:
    """Consecutive parts of `size` tokens, one at least; every token is in one."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.ceil(F.size(tokens) / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda w: F.slice(tokens, w * size + 1, size))


def doc_tokens(tokens: Column, maxlen: int) -> Column:
    """Windows of at most maxlen tokens, each with its marker at place 1."""
    return F.transform(
        windows(tokens, maxlen - 3), lambda w: F.concat(F.array(F.lit(CLS), F.lit(DOC_MARKER)), w, F.array(F.lit(SEP)))
    )


def query_maxlen(tokens: Column, maxlen: int, full_length: bool) -> Column:
    """Length of a window: `maxlen`, or with `full_length` that of the query up to a limit."""
    if not full_length:
        return F.lit(maxlen)
    return F.least(F.lit(FULL_LENGTH_LIMIT), F.greatest(F.lit(maxlen), F.size(tokens)))


def query_tokens(
    tokens: Column, maxlen: int, full_length: bool = False, context: Column | None = None, context_maxlen: int = 0
) -> Column:
    """Windows with a marker at place 1, each padded to the full length by the mask token. A
    context, in windows of its own limit without their leading token, follows: window by
    window, and the shorter side goes on with empty ones."""
    limit = query_maxlen(tokens, maxlen, full_length)

    def padded(w: Column) -> Column:
        core = F.concat(F.array(F.lit(CLS), F.lit(QUERY_MARKER)), w, F.array(F.lit(SEP)))
        return F.concat(core, F.array_repeat(F.lit(MASK_TOKEN), limit - F.size(core)))

    own = windows(tokens, limit - 3)
    if context is None:
        return F.transform(own, padded)
    other, empty = windows(context, context_maxlen - 2), F.array().cast("array<string>")
    return F.zip_with(
        own, other, lambda a, b: F.concat(padded(F.coalesce(a, empty)), F.coalesce(b, empty), F.array(F.lit(SEP)))
    )


def keep_mask(tokens: Column, skip_punctuation: bool = True) -> Column:
    """True for tokens that count: not padding and, on documents, not punctuation."""
    dropped = [PAD, *(PUNCTUATION if skip_punctuation else [])]
    return F.transform(tokens, lambda t: ~t.isin(*dropped))


def pad_longest(rows: DataFrame, group: list[str], tokens: str) -> DataFrame:
    """Pad token arrays to the longest of their batch; batches are of bounded size."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(*group))
    return rows.withColumn("_longest", longest).withColumn(
        tokens, F.concat(F.col(tokens), F.array_repeat(F.lit(PAD), F.col("_longest") - F.size(tokens)))
    ).drop("_longest")
