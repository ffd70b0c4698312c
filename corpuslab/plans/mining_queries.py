"""Registered queries: mining, example selection, training groups and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import batching, mining, selection
from corpuslab.operators import nearest as nn
from corpuslab.plans.registry import Tables, query
from corpuslab.plans.vector_queries import as_docs, as_queries, rounded, sql_ranking
from corpuslab.session import cut

SEED = "12345"


def sql_bands(n_pos: int, gap: int, n_neg: int) -> str:
    return f"""{sql_ranking("l2")},
    led AS (SELECT *, sum(CASE WHEN distance <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM ranked),
    kept AS (SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM led WHERE seen > 0),
    banded AS (SELECT *, CASE WHEN rank <= {n_pos} THEN 'pos' WHEN rank <= {n_pos + gap} THEN 'gap' WHEN rank <= {n_pos + gap + n_neg} THEN 'hard' ELSE 'easy' END AS band,
      10.0 / (distance + 0.01) AS score FROM kept)"""


@query(
    f"""WITH {sql_bands(5, 5, 50)} SELECT query_id, doc_id, round(distance, 6) AS distance, rank, band, round(score, 6) AS score
    FROM banded WHERE band IN ('pos', 'hard')"""
)
def mine_bands(t: Tables) -> DataFrame:
    bands = mining.mine_bands(as_queries(t), as_docs(t), n_pos=5, gap=5, n_neg=50)
    return bands.select(
        "query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"),
        "band", F.round("score", 6).alias("score"),
    )


@query(
    f"""WITH {sql_bands(5, 5, 50)} SELECT query_id, (SELECT count(*) FROM vecs) - count(*) AS run, CAST(61 AS BIGINT) AS first_rank,
    count(*) FILTER (band = 'easy') AS n_easy FROM banded GROUP BY query_id"""
)
def easy_band_sizes(t: Tables) -> DataFrame:
    return mining.easy_band_sizes(as_queries(t), as_docs(t), n_pos=5, gap=5, n_neg=50)


def sql_draws(seed: str, draws: str, free: str, n: int, order: str = "embedding, vec_id") -> str:
    """CTEs up to `picks` (draw_id, query_id, doc_id, pick): for each of `draws` (draw_id, query_id), n documents
    of those `free` (query_id, doc_id) for its query. To be used under WITH RECURSIVE."""
    keys = ", ".join(f"CAST('0x' || substr(md5('{seed}|' || draw_id), {1 + i * mining.KEY_DIGITS}, {mining.KEY_DIGITS}) AS BIGINT) AS k{i}" for i in range(mining.ROUNDS))
    rounds = ", ".join(
        f"({right} + k{i}) * {mining.MIX[0]} % {mining.MIX_MODULUS} AS y{i}, xor({left}, xor(y{i}, y{i} // {mining.MIX_FOLD}) * {mining.MIX[1]} % {mining.MIX_MODULUS} // {mining.MIX_LOW} % m) AS r{i + 1}"
        for i, (left, right) in enumerate([("l0", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r3")])
    )
    same = "draw_id, query_id, size, i, m, k0, k1, k2, k3"
    return f"""ords AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {order}) AS ordinal FROM embeddings),
    free_ AS MATERIALIZED (SELECT f.query_id, f.doc_id, row_number() OVER (PARTITION BY f.query_id ORDER BY ordinal) - 1 AS j, count(*) OVER (PARTITION BY f.query_id) AS size FROM ({free}) f JOIN ords USING (doc_id)),
    begun AS (SELECT draw_id, query_id, size, unnest(range(0, least({n}, size))) AS i, CAST(2 ** list_filter(range(0, 21), lambda h: 4 ** h >= size)[1] AS BIGINT) AS m, {keys}
      FROM ({draws}) JOIN (SELECT DISTINCT query_id, size FROM free_) USING (query_id)),
    walk AS (SELECT {same}, 0 AS step, i AS x FROM begun
      UNION ALL SELECT {same}, step + 1, r3 * m + r4 FROM (SELECT *, x // m AS l0, x % m AS r0, {rounds} FROM walk WHERE step = 0 OR x >= size)),
    picks AS (SELECT draw_id, w.query_id, doc_id, i + 1 AS pick FROM walk w JOIN free_ f ON f.query_id = w.query_id AND f.j = w.x WHERE step > 0 AND x < w.size)"""


OWN_DRAWS = "SELECT CAST(vec_id AS VARCHAR) AS draw_id, vec_id AS query_id FROM embeddings"


@query(
    f"""WITH RECURSIVE {sql_bands(5, 5, 50)}, {sql_draws(SEED, OWN_DRAWS, "SELECT query_id, doc_id FROM banded WHERE band = 'easy'", 5)}
    SELECT p.query_id, p.doc_id, pick, round(distance, 6) AS distance, round(score, 6) AS score FROM picks p JOIN banded b ON b.query_id = p.query_id AND b.doc_id = p.doc_id"""
)
def easy_draws(t: Tables) -> DataFrame:
    drawn = mining.easy_draws(as_queries(t), as_docs(t), 5, SEED, n_pos=5, gap=5, n_neg=50)
    return drawn.select(
        "query_id", "doc_id", F.col("pick").cast("bigint").alias("pick"), F.round("distance", 6).alias("distance"),
        F.round("score", 6).alias("score"),
    )


@query(
    f"""WITH RECURSIVE {sql_bands(5, 0, 0)},
    ends AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked),
    open AS (SELECT e.query_id, e.doc_id, e.distance FROM ends e WHERE e.rank > 6 AND e.rank < e.n AND e.distance > 0
      AND NOT EXISTS (SELECT 1 FROM banded b WHERE b.band = 'pos' AND b.query_id = e.query_id AND b.doc_id = e.doc_id)),
    {sql_draws(SEED, OWN_DRAWS, "SELECT query_id, doc_id FROM open", 5)}
    SELECT query_id, doc_id, band, rank AS slot, round(score, 6) AS score FROM banded WHERE band = 'pos'
    UNION ALL SELECT p.query_id, p.doc_id, 'neg', pick, round(10.0 / distance, 6) FROM picks p JOIN open o ON o.query_id = p.query_id AND o.doc_id = p.doc_id"""
)
def mine_pos_neg(t: Tables) -> DataFrame:
    rows = mining.mine_pos_neg(as_queries(t), as_docs(t), 5, SEED)
    return rows.withColumn("score", F.round("score", 6)).withColumn("slot", F.col("slot").cast("bigint"))


# Documents ranked by their texts. Vectors are counts of words by hash, so squared
# distances are whole numbers and copies of a text lie at distance 0 with equal keys.
DIM = 32
WORD_COUNTS = rf"""words AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS b FROM
      (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents)),
    counts AS (SELECT doc_id, b, count(*) AS c FROM words GROUP BY ALL),
    vecs AS (SELECT d.doc_id, md5(d.text) AS key, (SELECT list(coalesce(c, 0) :: DOUBLE ORDER BY i) FROM range({DIM}) r(i) LEFT JOIN counts ON counts.doc_id = d.doc_id AND b = i) AS v FROM documents d)"""


@query(
    f"""WITH {WORD_COUNTS},
    pairs AS (SELECT q.doc_id AS query_id, d.doc_id, q.key <> d.key AS differs, CAST(round(list_distance(q.v, d.v) ** 2) AS DOUBLE) AS distance FROM vecs q, vecs d),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS r FROM pairs),
    led AS (SELECT *, sum(CAST(differs AS INT)) OVER (PARTITION BY query_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS seen FROM ranked),
    kept AS (SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM led WHERE seen > 0)
    SELECT query_id, doc_id, distance, rank, CASE WHEN rank <= 3 THEN 'pos' ELSE 'hard' END AS band, round(10.0 / (distance + 0.01), 6) AS score
    FROM kept WHERE rank <= 3 OR rank BETWEEN 5 AND 24"""
)
def mine_bands_text(t: Tables) -> DataFrame:
    from corpuslab.operators.embed import word_count_vector

    # The embedded texts are written once and read by both searches.
    vecs = cut(
        t.wide("documents", "doc_id", "text").select("doc_id", word_count_vector(F.col("text"), DIM).alias("vec"), F.md5("text").alias("key"))
    )
    bands = mining.mine_bands(vecs.withColumnRenamed("doc_id", "query_id"), vecs, 3, 1, 20, mode="text")
    return bands.select(
        "query_id", "doc_id", "distance", F.col("rank").cast("bigint").alias("rank"), "band",
        F.round("score", 6).alias("score"),
    )


@query(
    f"""WITH RECURSIVE {sql_draws(SEED, OWN_DRAWS, "SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q, embeddings d", 5, "vec_id")}
    SELECT query_id, doc_id, pick AS rank FROM picks"""
)
def select_random(t: Tables) -> DataFrame:
    return selection.select_random(as_queries(t), as_docs(t), 5, SEED).withColumn("rank", F.col("rank").cast("bigint"))


# A second space over all dimensions, in which they count differently.
def tilted(df: DataFrame, steps: int = 3) -> DataFrame:
    return df.withColumn("vec", F.transform("vec", lambda x, i: x * (1 + i % steps)))


def sql_tilted(vec: str, steps: int = 3) -> str:
    return f"list_transform({vec}, lambda x, i: x * (1 + (i - 1) % {steps}))"


SQL_TWO_STAGE = f"""vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    wide AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_distance({sql_tilted("q.v")}, {sql_tilted("d.v")}) ** 2 AS distance, list_distance(q.v, d.v) ** 2 AS second FROM vecs q, vecs d),
    big AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) <= 100),
    small AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second, doc_id) AS rank FROM big)"""


@query(
    f"""WITH {SQL_TWO_STAGE} SELECT query_id, doc_id, round(distance, 6) AS distance, round(second, 6) AS second, rank FROM small WHERE rank <= 5"""
)
def select_two_stage(t: Tables) -> DataFrame:
    """Wide by the tilted vectors, then the exact distance decides."""
    def second(wide: DataFrame) -> DataFrame:
        return selection.second_distance(wide, as_queries(t), as_docs(t), "l2")

    # Both columns of distances come from one run.
    chosen = cut(selection.select_two_stage(tilted(as_queries(t)), tilted(as_docs(t)), 100, 5, second))
    return rounded(chosen).join(chosen.select("query_id", "doc_id", F.round("second", 6).alias("second")), ["query_id", "doc_id"])


@query(
    f"""WITH {SQL_TWO_STAGE.replace('<= 100', '<= 5').replace('second, doc_id', 'second DESC, doc_id')}
    SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM small"""
)
def resort_reversed(t: Tables) -> DataFrame:
    few = nn.nearest(tilted(as_queries(t)), tilted(as_docs(t)), 5, "l2").drop("rank")
    return rounded(selection.resort(selection.second_distance(few, as_queries(t), as_docs(t), "l2"), descending=True))


# Training groups: 2 positives, 40 hard; 8 ways with 2 easy.
SQL_GROUPS = f"""{sql_bands(2, 0, 40)},
    pairs_ AS (SELECT query_id, doc_id AS pos_id, score AS pos_score FROM banded WHERE band = 'pos'),
    {sql_draws(SEED + "|0", "SELECT query_id || '|' || pos_id AS draw_id, query_id FROM pairs_", "SELECT query_id, doc_id FROM banded WHERE band = 'easy'", 2)},
    hard_ AS (SELECT p.query_id, pos_id, doc_id, score, row_number() OVER (PARTITION BY p.query_id, pos_id ORDER BY md5('{SEED}|0|' || p.query_id || '|' || pos_id || '|' || doc_id)) AS slot
      FROM pairs_ p JOIN banded b ON b.query_id = p.query_id AND band = 'hard'),
    easy_ AS (SELECT p.draw_id, p.query_id, p.doc_id, b.score, pick FROM picks p JOIN banded b ON b.query_id = p.query_id AND b.doc_id = p.doc_id),
    groups AS (SELECT query_id, pos_id, 0 AS slot, pos_id AS doc_id, pos_score AS score FROM pairs_
      UNION ALL SELECT query_id, pos_id, slot, doc_id, score FROM hard_ WHERE slot <= 5
      UNION ALL SELECT query_id, CAST(string_split(draw_id, '|')[2] AS BIGINT), pick + 5, doc_id, score FROM easy_)"""


def groups_of(t: Tables) -> DataFrame:
    bands = mining.mine_bands(as_queries(t), as_docs(t), n_pos=2, gap=0, n_neg=40)
    return batching.nway_groups(bands, as_queries(t), as_docs(t), nway=8, easy_nway=2, seed=SEED)


@query(f"WITH RECURSIVE {SQL_GROUPS} SELECT query_id, pos_id, CAST(slot AS BIGINT) AS slot, doc_id, round(score, 6) AS score FROM groups")
def nway_groups(t: Tables) -> DataFrame:
    return groups_of(t).select(
        "query_id", "pos_id", F.col("slot").cast("bigint").alias("slot"), "doc_id", F.round("score", 6).alias("score")
    )


@query(
    f"""WITH RECURSIVE {SQL_GROUPS} SELECT query_id, pos_id, CAST(slot AS BIGINT) AS slot, doc_id, q.label || ' asks' AS query, d.label || ' tells' AS doc
    FROM groups JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = doc_id"""
)
def group_texts(t: Tables) -> DataFrame:
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.concat(F.col("label").cast("string"), F.lit(" asks")).alias("query"))
    docs = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.concat(F.col("label").cast("string"), F.lit(" tells")).alias("doc"))
    return batching.attach_texts(groups_of(t), queries, docs).select(
        "query_id", "pos_id", F.col("slot").cast("bigint").alias("slot"), "doc_id", "query", "doc"
    )


@query(
    f"""WITH {sql_bands(2, 0, 0)}, pairs_ AS (SELECT query_id, doc_id AS pos_id FROM banded WHERE band = 'pos'),
    o AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|3|' || query_id || '|' || pos_id), query_id, pos_id) - 1 AS ordinal, count(*) OVER () AS n FROM pairs_),
    r AS (SELECT *, ordinal % 4 AS rank, ordinal // 4 AS place_ FROM o)
    SELECT query_id, pos_id, ordinal, rank, place_ // 16 AS batch, place_ % 16 AS place, (place_ % 16) // 4 AS micro_batch, place_ // 16 < ((n - 1 - rank) // 4 + 1) // 16 AS complete FROM r"""
)
def nway_batches(t: Tables) -> DataFrame:
    """One epoch over the positives: 4 ranks, batches of 16 in 4 micro-batches."""
    pairs = mining.mine_bands(as_queries(t), as_docs(t), n_pos=2, gap=0, n_neg=0).select(
        "query_id", F.col("doc_id").alias("pos_id")
    )
    pairs = cut(pairs)
    cutup = batching.batches(batching.epoch_order(pairs, ["query_id", "pos_id"], SEED, 3), pairs.count(), 16, 4, 4)
    return cutup.select(
        "query_id", "pos_id", "complete", *[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "rank", "batch", "place", "micro_batch")]
    )


@query(
    """WITH q AS (SELECT list_transform(list_concat(quantile_cont(n_chars, [0.5, 0.75, 0.9, 0.95]), [max(n_chars)]), lambda x: CAST(floor(x) AS BIGINT)) AS b FROM documents)
    SELECT doc_id, n_chars, list_min(list_filter(b, lambda x: x >= n_chars)) AS bucket FROM documents, q"""
)
def length_buckets(t: Tables) -> DataFrame:
    return batching.length_buckets(t.documents.select("doc_id", "n_chars"), "n_chars")


@query(
    """WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('7|0|' || doc_id), doc_id) - 1 AS ordinal FROM documents),
    p AS (SELECT *, ordinal // 64 AS batch, count(*) OVER (PARTITION BY ordinal // 64) AS size FROM o),
    s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ordinal) - 1 AS old_place, row_number() OVER (PARTITION BY batch ORDER BY n_chars, ordinal) - 1 AS np FROM p)
    SELECT doc_id, batch, old_place, CASE WHEN size > 16 THEN np ELSE old_place END AS new_place,
      (CASE WHEN size > 16 THEN np ELSE old_place END) // 16 AS length_batch FROM s"""
)
def length_sorted(t: Tables) -> DataFrame:
    ordered = batching.epoch_order(t.documents.select("doc_id", "n_chars"), ["doc_id"], "7", 0)
    grouped = ordered.withColumn("batch", F.floor(F.col("ordinal") / 64))
    done = batching.sort_by_length(grouped, ["batch"], "n_chars", "ordinal", 16)
    return done.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("batch", "old_place", "new_place", "length_batch")])


SQL_TOKENS = r"toks AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS w FROM benchmark)"


def sql_windows(size: str, words: str = "w") -> str:
    return f"unnest(list_transform(range(greatest(1, CAST(ceil(len({words}) / {size}) AS BIGINT))), lambda k: {{'win': k, 'part': {words}[k * {size} + 1 : k * {size} + {size}]}}))"


@query(
    f"""WITH {SQL_TOKENS}, cutup AS (SELECT item_id, {sql_windows("21")} AS c FROM toks)
    SELECT item_id, CAST(c.win AS BIGINT) AS win, '[CLS] [D] ' || array_to_string(list_append(c.part, '[SEP]'), ' ') AS doc,
    CAST(len(list_filter(c.part, lambda x: NOT regexp_full_match(x, '[[:punct:]]'))) + 3 AS BIGINT) AS n_kept FROM cutup"""
)
def truncate_pad_docs(t: Tables) -> DataFrame:
    """Texts in windows of 24 tokens, markers included."""
    rows = t.benchmark.select("item_id", F.posexplode(batching.doc_tokens(batching.word_tokens(F.col("text")), 24)).alias("win", "tokens"))
    kept = F.size(F.filter(batching.keep_mask(F.col("tokens")), lambda k: k))
    return rows.select("item_id", F.col("win").cast("bigint").alias("win"), F.array_join("tokens", " ").alias("doc"), kept.cast("bigint").alias("n_kept"))


@query(
    f"""WITH {SQL_TOKENS}, q AS (SELECT item_id, len(w) AS n, {sql_windows("29")} AS c FROM toks), x AS (SELECT item_id, {sql_windows("6")} AS c FROM toks),
    both_ AS (SELECT coalesce(q.item_id, x.item_id) AS item_id, coalesce(q.c.win, x.c.win) AS win, coalesce(q.c.part, []) AS a, coalesce(x.c.part, []) AS b FROM q FULL JOIN x ON q.item_id = x.item_id AND q.c.win = x.c.win),
    core AS (SELECT *, list_concat(list_concat(['[CLS]', '[Q]'], a), ['[SEP]']) AS core FROM both_)
    SELECT c.item_id, CAST(c.win AS BIGINT) AS win, array_to_string(list_concat(core, list_transform(range(32 - len(core)), lambda i: '[MASK]')), ' ') AS query,
      array_to_string(list_append(b, '[SEP]'), ' ') AS context, CAST(least(500, greatest(32, len(w))) AS BIGINT) AS full_length FROM core c JOIN toks USING (item_id)"""
)
def pad_queries(t: Tables) -> DataFrame:
    """Queries in windows of 32 tokens, each with a window of 8 of the context."""
    words = batching.word_tokens(F.col("text"))
    rows = t.benchmark.select(
        "item_id", batching.query_maxlen(words, 32, True).cast("bigint").alias("full_length"),
        F.posexplode(batching.query_tokens(words, 32, context=words, context_maxlen=8)).alias("win", "tokens"),
    )
    return rows.select(
        "item_id", F.col("win").cast("bigint").alias("win"), "full_length",
        F.array_join(F.slice("tokens", 1, 32), " ").alias("query"), F.array_join(F.slice("tokens", 33, 100), " ").alias("context"),
    )


@query(
    f"""WITH {SQL_TOKENS}, p AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM toks)
    SELECT item_id, CAST(pos AS BIGINT) AS pos, token, NOT regexp_full_match(token, '[[:punct:]]') AS keep FROM p"""
)
def keep_mask(t: Tables) -> DataFrame:
    words = batching.word_tokens(F.col("text"))
    zipped = F.arrays_zip(words.alias("token"), batching.keep_mask(words).alias("keep"))
    return t.benchmark.select("item_id", F.posexplode(zipped).alias("pos", "z")).select(
        "item_id", F.col("pos").cast("bigint").alias("pos"), "z.token", "z.keep"
    )
