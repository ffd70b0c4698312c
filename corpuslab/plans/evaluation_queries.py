"""Registered queries: late interaction, losses, retrieval and classification metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import sqltext
from corpuslab.functions.vectors import pair_distance
from corpuslab.operators import evaluate, execution, interaction, losses
from corpuslab.operators import nearest as nn
from corpuslab.plans.derived import query_log, raw_catalog
from corpuslab.plans.mining_queries import SQL_GROUPS, groups_of, sql_tilted, tilted
from corpuslab.plans.registry import Tables, query
from corpuslab.plans.text_queries import SKELETON, nested, norm_log
from corpuslab.plans.vector_queries import as_docs, as_queries, sql_ranking

# Token matrices: four consecutive vectors make a query, eight a document; every
# seventh token of a document is masked.
def query_tokens(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 4).alias("query_id"), (F.col("vec_id") % 4).cast("int").alias("pos"), F.col("embedding").alias("vec")
    )


def doc_tokens(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 8).alias("doc_id"), (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.col("embedding").alias("vec"), (F.col("vec_id") % 7 != 0).alias("keep"),
    )


def candidates(t: Tables) -> DataFrame:
    near = nn.nearest(as_queries(t), as_docs(t), 10, "l2")
    ids = t.embeddings.select(F.col("vec_id").alias("token_id"))
    return interaction.candidate_pairs(
        near, ids.withColumn("text_id", F.floor(F.col("token_id") / 4)), ids.withColumn("text_id", F.floor(F.col("token_id") / 8))
    )


SQL_TOKEN_PAIRS = f"""{sql_ranking("l2")},
    cands AS (SELECT DISTINCT query_id // 4 AS query_id, doc_id // 8 AS doc_id FROM ranked WHERE rank <= 10),
    qt AS (SELECT vec_id // 4 AS query_id, vec_id % 4 AS pos, v FROM vecs),
    dt AS (SELECT vec_id // 8 AS doc_id, vec_id % 7 <> 0 AS keep, v FROM vecs)"""


def sql_maxsim(value: str, pairs: str = "cands") -> str:
    return f"""best AS (SELECT c.query_id, c.doc_id, pos, max({value}) AS best FROM {pairs} c JOIN qt USING (query_id) JOIN dt USING (doc_id) GROUP BY ALL)"""


DOT = "CASE WHEN keep THEN list_inner_product(qt.v, dt.v) ELSE -9999 END"


@query(
    f"""WITH {SQL_TOKEN_PAIRS}, {sql_maxsim(DOT)} SELECT query_id, doc_id, round(sum(best), 6) AS score FROM best GROUP BY ALL"""
)
def maxsim(t: Tables) -> DataFrame:
    scores = interaction.maxsim(candidates(t), query_tokens(t), doc_tokens(t))
    return scores.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {SQL_TOKEN_PAIRS}, {sql_maxsim("-(list_distance(qt.v, dt.v) ** 2)")} SELECT query_id, doc_id, round(sum(best), 6) AS score FROM best GROUP BY ALL"""
)
def maxsim_l2(t: Tables) -> DataFrame:
    scores = interaction.maxsim(candidates(t), query_tokens(t), doc_tokens(t), "l2")
    return scores.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {SQL_TOKEN_PAIRS}, {sql_maxsim(DOT)},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, pos >= 2 ORDER BY best DESC, pos) AS r FROM best)
    SELECT query_id, doc_id, round(sum(best), 6) AS score FROM r WHERE (pos < 2 AND r <= 1) OR (pos >= 2 AND r <= 2) GROUP BY query_id, doc_id"""
)
def maxsim_split(t: Tables) -> DataFrame:
    """Split after 2 query tokens: the best of the first part and 2 of the rest."""
    scores = interaction.maxsim_split(candidates(t), query_tokens(t), doc_tokens(t), length=2, n_first=1, n_rest=2)
    return scores.withColumn("score", F.round("score", 6))


SQL_RERANKED = (
    f"""WITH {sql_ranking("l2")}, qt AS (SELECT vec_id // 4 AS query_id, vec_id % 4 AS pos, v FROM vecs), dt AS (SELECT vec_id // 8 AS doc_id, vec_id % 7 <> 0 AS keep, v FROM vecs),
    cands AS (SELECT DISTINCT q.vec_id // 4 AS query_id, d.vec_id // 8 AS doc_id FROM vecs q, vecs d WHERE q.vec_id % 4 = 0 AND d.vec_id % 8 = 0), {sql_maxsim(DOT)},
    s AS (SELECT query_id, doc_id, sum(best) AS score FROM best GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s
    QUALIFY rank <= 5"""
)


@query(SQL_RERANKED)
def rerank_all(t: Tables) -> DataFrame:
    best = interaction.rerank_all(query_tokens(t), doc_tokens(t), 5)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(SQL_RERANKED)
def rerank_pruned(t: Tables) -> DataFrame:
    best = interaction.rerank_pruned(query_tokens(t), doc_tokens(t), 5)
    return best.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {SQL_TOKEN_PAIRS}, {sql_maxsim(DOT)}, s AS (SELECT query_id, doc_id, sum(best) AS score FROM best GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3"""
)
def rerank_candidates(t: Tables) -> DataFrame:
    """Two stages: documents near any token of the query, then late interaction."""
    scores = interaction.maxsim(candidates(t), query_tokens(t), doc_tokens(t))
    return interaction.best_by_maxsim(scores, 3).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


# Groups scored by the tilted vectors, with the mined score as the target.
def scored_groups(t: Tables) -> DataFrame:
    q = tilted(as_queries(t)).select("query_id", F.col("vec").alias("_q"))
    d = tilted(as_docs(t)).select("doc_id", F.col("vec").alias("_d"))
    return (
        groups_of(t).withColumnRenamed("score", "target").join(q, "query_id").join(d, "doc_id")
        .select("query_id", "pos_id", "slot", "target", (1 - pair_distance(F.col("_q"), F.col("_d"), "ip")).alias("score"))
    )


SQL_SCORED = f"""{SQL_GROUPS}, scored AS (SELECT query_id, pos_id, slot, g.score AS target,
    list_inner_product({sql_tilted("q.v")}, {sql_tilted("d.v")}) AS score FROM groups g JOIN vecs q ON q.vec_id = query_id JOIN vecs d ON d.vec_id = doc_id)"""
GROUP = ["query_id", "pos_id"]


@query(
    f"""WITH RECURSIVE {SQL_SCORED}, l AS (SELECT query_id, pos_id, ln(sum(exp(score))) AS a, ln(sum(CASE WHEN slot = 0 OR slot >= 6 THEN exp(score) END)) AS e, max(CASE WHEN slot = 0 THEN score END) AS s0 FROM scored GROUP BY ALL)
    SELECT query_id, pos_id, round(a - s0, 6) AS self_loss, round(e - s0, 6) AS easy_loss FROM l"""
)
def contrastive_ce(t: Tables) -> DataFrame:
    rows = scored_groups(t)
    own = losses.contrastive_ce(rows, GROUP).withColumnRenamed("loss", "self_loss")
    easy = losses.contrastive_ce(rows, GROUP, losses.easy_slots(8, 2)).withColumnRenamed("loss", "easy_loss")
    return own.join(easy, GROUP).select(*GROUP, F.round("self_loss", 6).alias("self_loss"), F.round("easy_loss", 6).alias("easy_loss"))


@query(
    f"""WITH RECURSIVE {SQL_SCORED}, l AS (SELECT *, target * 0.1 - ln(sum(exp(target * 0.1)) OVER w) AS lt, score - ln(sum(exp(score)) OVER w) AS ls FROM scored WINDOW w AS (PARTITION BY query_id, pos_id)),
    g AS (SELECT query_id, pos_id, sum(exp(lt) * (lt - ls)) AS loss FROM l GROUP BY ALL) SELECT round(avg(loss), 6) AS loss, count(*) AS n_groups FROM g"""
)
def listwise_kl(t: Tables) -> DataFrame:
    per_group = losses.listwise_kl(scored_groups(t), GROUP, alpha=0.1)
    return per_group.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n_groups"))


@query(
    f"""WITH RECURSIVE {SQL_SCORED}, g AS (SELECT query_id, pos_id, arg_max(slot, (score, -slot)) = arg_max(slot, (target, -slot)) AS hit FROM scored GROUP BY ALL)
    SELECT round(avg(CAST(hit AS INT)), 6) AS top1_rate, count(*) AS n_groups FROM g"""
)
def top1_rate(t: Tables) -> DataFrame:
    return losses.top1_rate(scored_groups(t), GROUP).withColumn("top1_rate", F.round("top1_rate", 6))


@query(
    f"""WITH RECURSIVE {SQL_SCORED}, m AS (SELECT avg(CASE WHEN slot = 0 THEN score END) AS p, avg(CASE WHEN slot = 1 THEN score END) AS n FROM scored)
    SELECT round(p, 6) AS positive, round(n, 6) AS negative, round(round(p, 2) - round(n, 2), 6) AS margin FROM m"""
)
def score_margin(t: Tables) -> DataFrame:
    m = losses.score_margin(scored_groups(t))
    return m.select(*[F.round(c, 6).alias(c) for c in ("positive", "negative", "margin")])


@query(
    """WITH r AS (SELECT doc_id, quality, toxic, ln(n_chars + 1) / 10 AS x, n_chars % 7 / 7.0 AS y FROM labels JOIN documents USING (doc_id)),
    one AS (SELECT doc_id % 50 AS sample, quality AS label, 1 / (1 + exp(CASE WHEN quality = 1 THEN y - x ELSE x - y END)) AS p FROM r),
    two AS (SELECT doc_id % 50 AS sample, toxic AS label, 1 / (1 + exp(CASE WHEN toxic = 1 THEN x - y ELSE y - x END)) AS p FROM r),
    f1 AS (SELECT sample, sum(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END * -((1 - p) ** 0.5) * ln(p + 1e-8)) / sum(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END) AS loss FROM one GROUP BY ALL),
    f2 AS (SELECT sample, sum(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END * -((1 - p) ** 0.5) * ln(p + 1e-8)) / sum(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END) AS loss FROM two GROUP BY ALL)
    SELECT round((SELECT avg(loss) FROM f1), 6) AS table_loss, round((SELECT avg(loss) FROM f2), 6) AS column_loss, round((SELECT avg(loss) FROM f1) + (SELECT avg(loss) FROM f2), 6) AS loss"""
)
def focal_loss(t: Tables) -> DataFrame:
    """Labels as two-class targets, logits made from the text lengths, 50 samples."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        (F.col("doc_id") % 50).alias("sample"), "quality", "toxic",
        (F.log(F.col("n_chars") + 1.0) / 10).alias("x"), ((F.col("n_chars") % 7) / 7.0).alias("y"),
    )
    one = rows.select("sample", F.col("quality").alias("label"), F.col("y").alias("logit0"), F.col("x").alias("logit1"))
    two = rows.select("sample", F.col("toxic").alias("label"), F.col("x").alias("logit0"), F.col("y").alias("logit1"))
    done = losses.classifier_loss(one, two, ["sample"], alpha=0.75)
    return done.select(*[F.round(c, 6).alias(c) for c in ("table_loss", "column_loss", "loss")])


# Two rankings: by all dimensions (golden) and by the first half (evaluated).
def golden(t: Tables, k: int = 10) -> DataFrame:
    return nn.nearest(as_queries(t), as_docs(t), k, "l2")


def evaluated(t: Tables, k: int = 10) -> DataFrame:
    return nn.nearest(tilted(as_queries(t)), tilted(as_docs(t)), k, "l2")


SQL_TWO = f"""vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    dists AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_distance(q.v, d.v) AS dist, list_cosine_similarity(q.v, d.v) AS cosine,
      list_distance({sql_tilted("q.v")}, {sql_tilted("d.v")}) ** 2 AS half FROM vecs q, vecs d),
    gold AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM dists QUALIFY rank <= 10),
    eval AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY half, doc_id) AS rank FROM dists QUALIFY rank <= 10)"""


@query(
    f"""WITH {SQL_TWO}, texts AS (SELECT vec_id, 'select ' || vec_id % 97 AS text FROM vecs),
    e AS (SELECT query_id, rank, text FROM eval JOIN texts ON vec_id = doc_id), g AS (SELECT query_id, rank, text FROM gold JOIN texts ON vec_id = doc_id),
    c AS (SELECT query_id, count(*) FILTER (e.rank <= 5 AND EXISTS (SELECT 1 FROM g WHERE g.query_id = e.query_id AND g.text = e.text AND g.rank <= 5)) AS r5,
      count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE g.query_id = e.query_id AND g.text = e.text AND g.rank <= 10)) AS r10 FROM e GROUP BY query_id)
    SELECT round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, count(*) AS n_queries FROM c"""
)
def recall_at_k(t: Tables) -> DataFrame:
    """Hits are counted by text; the texts repeat, so duplicates matter."""
    texts = t.embeddings.select(
        F.col("vec_id").alias("doc_id"), F.concat(F.lit("select "), (F.col("vec_id") % 97).cast("string")).alias("text")
    )
    done = evaluate.recall_at(evaluated(t).join(texts, "doc_id"), golden(t).join(texts, "doc_id"))
    return done.select(F.round("recall_5", 6).alias("recall_5"), F.round("recall_10", 6).alias("recall_10"), "n_queries")


@query(
    f"""WITH {SQL_TWO}, g AS (SELECT query_id, avg(dist) AS d FROM gold WHERE rank <= 5 GROUP BY ALL), e AS (SELECT query_id, avg(dist) AS d FROM eval WHERE rank <= 5 GROUP BY ALL)
    SELECT round(avg(g.d), 6) AS golden_distance, round(avg(e.d), 6) AS evaluated_distance, round(avg(e.d - g.d), 6) AS gap FROM g JOIN e USING (query_id)"""
)
def distance_gap(t: Tables) -> DataFrame:
    done = evaluate.distance_gap(evaluated(t, 5), golden(t, 5), as_queries(t), as_docs(t))
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query(
    f"""WITH {SQL_TWO}, g AS (SELECT query_id, avg(dist) AS d FROM gold WHERE rank BETWEEN 2 AND 5 GROUP BY ALL), e AS (SELECT query_id, avg(dist) AS d FROM eval WHERE rank BETWEEN 2 AND 5 GROUP BY ALL)
    SELECT round(avg(g.d), 6) AS golden_distance, round(avg(e.d), 6) AS evaluated_distance, round(avg(e.d - g.d), 6) AS gap FROM g JOIN e USING (query_id)"""
)
def distance_gap_on_train(t: Tables) -> DataFrame:
    """The queries are in the collection, so the first neighbour does not count."""
    done = evaluate.distance_gap(evaluated(t, 5), golden(t, 5), as_queries(t), as_docs(t), skip_first=True)
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query(
    f"""WITH {SQL_TWO}, e AS (SELECT query_id, avg(cosine) AS c FROM eval WHERE rank <= 5 GROUP BY ALL) SELECT round(avg(c), 6) AS mean_cosine FROM e"""
)
def mean_cosine(t: Tables) -> DataFrame:
    done = evaluate.mean_cosine(evaluated(t, 5), as_queries(t), as_docs(t))
    return done.select(F.round("mean_cosine", 6).alias("mean_cosine"))


@query(
    f"""WITH {SQL_TWO} SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS ids FROM eval WHERE rank <= 5 GROUP BY query_id"""
)
def prediction_map(t: Tables) -> DataFrame:
    done = evaluate.prediction_map(evaluated(t))
    return done.select("query_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


RUNS = {"epoch_1": 7, "epoch_2": 5, "epoch_10": 3, "epoch_20": 1}


@query(
    "WITH "
    + SQL_TWO
    + ", runs AS ("
    + " UNION ALL ".join(
        f"""SELECT {int(name.split('_')[1])} AS epoch, * FROM (SELECT q.vec_id AS query_id, list_distance(q.v, d.v) AS dist, list_cosine_similarity(q.v, d.v) AS cosine,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance({sql_tilted("q.v", steps)}, {sql_tilted("d.v", steps)}) ** 2, d.vec_id) AS rank FROM vecs q, vecs d QUALIFY rank <= 5)"""
        for name, steps in RUNS.items()
    )
    + """), g AS (SELECT query_id, avg(dist) AS d FROM gold WHERE rank <= 5 GROUP BY ALL), e AS (SELECT epoch, query_id, avg(dist) AS d, avg(cosine) AS c FROM runs GROUP BY ALL)
    SELECT epoch, round(avg(g.d), 6) AS golden_distance, round(avg(e.d), 6) AS evaluated_distance, round(avg(e.d - g.d), 6) AS gap, round(avg(c), 6) AS mean_cosine FROM e JOIN g USING (query_id) GROUP BY epoch"""
)
def epoch_sweep(t: Tables) -> DataFrame:
    """Four runs at once: rankings by vectors less and less tilted, the last by the plain ones."""
    runs = [
        nn.nearest(
            tilted(as_queries(t), steps), tilted(as_docs(t), steps), 5, "l2"
        ).withColumn("run_name", F.lit(name))
        for name, steps in RUNS.items()
    ]
    done = evaluate.epoch_sweep(reduce(DataFrame.unionByName, runs), golden(t, 5), as_queries(t), as_docs(t))
    return done.select("epoch", *[F.round(c, 6).alias(c) for c in done.columns if c != "epoch"])


@query(
    """WITH o AS (SELECT user_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, max(n) AS n, round(max(CASE WHEN i = 1 THEN value END) * 0.999 ** max(n) + 0.001 * sum(value * 0.999 ** (n - i)), 6) AS ema FROM o GROUP BY user_id"""
)
def ema_by_user(t: Tables) -> DataFrame:
    done = evaluate.ema(t.events, "user_id", ["ts", "event_id"], "value")
    return done.withColumn("ema", F.round("ema", 6))


def predictions(t: Tables) -> DataFrame:
    """Toxicity guessed from the length of the text."""
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("toxic").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("prediction"), F.col("n_chars").alias("score")
    )


SQL_PREDICTIONS = "p AS (SELECT toxic AS label, CAST(n_chars > 1500 AS INT) AS prediction, n_chars AS score FROM labels JOIN documents USING (doc_id))"


@query(
    f"""WITH {SQL_PREDICTIONS}, c AS (SELECT k AS cls, count(*) FILTER (label = k AND prediction = k) AS hit, count(*) FILTER (label <> k AND prediction = k) AS f, count(*) FILTER (label = k AND prediction <> k) AS m FROM p, (VALUES (0), (1)) v(k) GROUP BY k),
    s AS (SELECT cls, hit / (hit + f) AS pr, hit / (hit + m) AS re, 2 * hit / (2 * hit + f + m) AS f1, CAST(hit + m AS DOUBLE) AS su, hit FROM c)
    SELECT CASE cls WHEN 0 THEN 'negatives' ELSE 'positives' END AS row, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, su AS support FROM s
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(su), 6), round(sum(hit) / sum(su), 6), round(sum(hit) / sum(su), 6), sum(su) FROM s
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(su) FROM s
    UNION ALL SELECT 'weighted avg', round(sum(pr * su) / sum(su), 6), round(sum(re * su) / sum(su), 6), round(sum(f1 * su) / sum(su), 6), sum(su) FROM s"""
)
def class_report(t: Tables) -> DataFrame:
    report = evaluate.classification_report(predictions(t))
    return report.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    f"""WITH {SQL_PREDICTIONS}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p),
    n AS (SELECT sum(label) AS pos, sum(1 - label) AS neg, sum(CASE WHEN label = 1 THEN r END) AS s FROM r) SELECT round(CAST((s - pos * (pos + 1) / 2) / (pos * neg) AS DOUBLE), 6) AS auc FROM n"""
)
def auc(t: Tables) -> DataFrame:
    return evaluate.auc(predictions(t)).select(F.round("auc", 6).alias("auc"))


# Predictions for the query log: lower case for some, a changed literal for others.
def predicted_log(t: Tables) -> DataFrame:
    kind = F.col("log_id") % 5
    prediction = (
        F.when(kind == 0, F.lower("sql"))
        .when(kind == 1, F.regexp_replace("sql", r"\d+;?$", "1"))
        .when(kind == 2, F.replace(F.col("sql"), F.lit("o_orderkey"), F.lit("o_custkey")))
        .otherwise(F.concat(F.lit(" "), F.col("sql"), F.lit(" ;")))
    )
    return query_log(t).select("log_id", "db_id", F.col("sql").alias("gold"), prediction.alias("prediction"))


SQL_PREDICTED = f"""{SKELETON},
    plog AS (SELECT log_id, db_id, CASE log_id % 5 WHEN 0 THEN lower(sql) WHEN 1 THEN regexp_replace(sql, '\\d+;?$', '1') WHEN 2 THEN replace(sql, 'o_orderkey', 'o_custkey') ELSE ' ' || sql || ' ;' END AS sql FROM qlog)"""


def _second_chain(text: str) -> str:
    """The same CTE chain under other names, starting from the predicted log."""
    import re

    body = text[text.index("spaced AS"):]
    for name in ("spaced", "cased", "sorted", "unaliased", "norm", "masked", "skel"):
        body = re.sub(rf"\b{name}\b", f"{name}_p", body)
    return re.sub(r"\bqlog\b", "plog", body)


SQL_MATCHES = SQL_PREDICTED + ", " + _second_chain(SKELETON) + """,
    m AS (SELECT norm.log_id, norm.norm_sql = norm_p.norm_sql AS exact, skel.sql_skeleton = skel_p.sql_skeleton AS same_skeleton, norm.norm_sql AS norm_sql
      FROM norm JOIN norm_p USING (log_id) JOIN skel USING (log_id) JOIN skel_p USING (log_id))"""


def matches(t: Tables) -> DataFrame:
    return evaluate.exact_match(predicted_log(t), nested(t))


@query(f"WITH {SQL_MATCHES} SELECT log_id, exact, same_skeleton FROM m")
def exact_match(t: Tables) -> DataFrame:
    return matches(t).select("log_id", "exact", "same_skeleton")


@query(
    f"""WITH {SQL_MATCHES}, g AS (SELECT exact, CASE WHEN contains(norm_sql, 'join') THEN 'join' WHEN regexp_matches(norm_sql, '\\(\\s*select\\b|\\bunion\\b') THEN 'nested' ELSE '' END AS tag,
      CASE WHEN log_id % 3 = 0 THEN 'easy' ELSE 'hard' END AS hardness FROM m WHERE log_id % 11 <> 0),
    u AS (SELECT 'tag' AS kind, tag AS value, exact FROM g WHERE tag <> '' UNION ALL SELECT 'tags', tag, exact FROM g UNION ALL SELECT 'hardness', hardness, exact FROM g UNION ALL SELECT 'all', 'all', exact FROM g)
    SELECT kind, value, count(*) FILTER (exact) AS correct, count(*) AS total FROM u GROUP BY ALL"""
)
def accuracy_by_tag(t: Tables) -> DataFrame:
    # The normal form is a column of its own, so the tags read it and do not work it out for each test.
    rows = norm_log(t).select(
        "log_id",
        sqltext.tag_list(F.col("norm_sql")).alias("tags"),
        F.when(F.col("log_id") % 3 == 0, F.lit("easy")).otherwise(F.lit("hard")).alias("hardness"),
        F.when(F.col("log_id") % 11 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("turn_idx"),
    )
    judged = evaluate.exact_match(predicted_log(t)).select("log_id", F.col("exact").alias("correct"))
    return evaluate.accuracy_by(rows.join(judged, "log_id"))


@query(
    f"""WITH {SQL_MATCHES} SELECT log_id FROM m WHERE NOT exact"""
)
def wrong_predictions(t: Tables) -> DataFrame:
    return evaluate.wrong_rows(evaluate.exact_match(predicted_log(t)), "log_id", "exact")


# A prediction file over the order log: pairs (gold, prediction) in turn, {p} and {s} from the order. The flag
# says whether the prediction can run at all.
PAIRS = [
    ("SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderpriority = '{p}' GROUP BY 1", "SELECT o_orderstatus, count(o_orderkey) FROM orders WHERE o_orderpriority IN ('{p}') GROUP BY o_orderstatus", True),
    ("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = '{s}'", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus = '{s}'", True),
    ("SELECT o_custkey FROM orders WHERE o_orderpriority = '{p}' AND o_orderstatus = '{s}'", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '{p}' AND o_orderstatus = '{s}'", True),
    ("SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = '{s}' AND o_totalprice > 300000", "SELECT c.c_name AS who FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND NOT o.o_totalprice <= 300000 AND o.o_orderstatus = '{s}'", True),
    ("SELECT c_custkey, c_name FROM customer", "SELECT c_custkey FROM customer", True),
    ("SELECT count(*) FROM orders WHERE o_orderpriority = '{p}'", "SELECT CAST(sum(1) AS DOUBLE) FROM orders WHERE o_orderpriority = '{p}'", True),
    ("SELECT c_custkey FROM customer", "SELECT no_such_{s} FROM customer", False),
    ("SELECT c_custkey FROM customer", "SELECT CAST(c_name AS INT) FROM customer", False),
    ("SELECT c_custkey FROM customer", "DROP VIEW customer", False),
    ("SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = '{s}'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = '{s}' ORDER BY o_orderkey DESC LIMIT 1", True),
    ("SELECT o_orderpriority, o_orderstatus FROM orders", "SELECT o_orderpriority, o_orderstatus FROM orders UNION ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE 1 = 0", True),
]
PRIORITIES, STATUSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ("F", "O", "P")


def _sql_matches() -> str:
    """What is to be, for each pair and each value it takes, by comparing the results themselves."""
    out = []
    for i, (gold, prediction, runs) in enumerate(PAIRS):
        for p in PRIORITIES if "{p}" in gold else ("",):
            for s in STATUSES if "{s}" in gold else ("",):
                a, b = (x.replace("{p}", p).replace("{s}", s) for x in (gold, prediction))
                same = f"NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a}))" if runs and a.split(" FROM ")[0].count(",") == b.split(" FROM ")[0].count(",") else "FALSE"
                out.append(f"SELECT {i} AS turn, {f"'{p}'" if p else 'NULL'} AS p, {f"'{s}'" if s else 'NULL'} AS s, {same} AS match")
    return " UNION ALL ".join(out)


def prediction_pairs(t: Tables) -> DataFrame:
    def text(which: int):
        turn, out = F.col("o_orderkey") % len(PAIRS), F.lit(None).cast("string")
        for i, pair in enumerate(PAIRS):
            out = F.when(turn == i, F.lit(pair[which])).otherwise(out)
        return F.replace(F.replace(out, F.lit("{p}"), F.col("o_orderpriority")), F.lit("{s}"), F.col("o_orderstatus"))

    rows = t.wide("orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return rows.select(F.col("o_orderkey").alias("log_id"), F.lit("shop").alias("db_id"), text(0).alias("gold"), text(1).alias("prediction"))


@query(
    f"""WITH known AS MATERIALIZED ({_sql_matches()}) SELECT o_orderkey AS log_id, match FROM orders
    JOIN known ON turn = o_orderkey % {len(PAIRS)} AND coalesce(p = o_orderpriority, TRUE) AND coalesce(s = o_orderstatus, TRUE)"""
)
def execution_match(t: Tables) -> DataFrame:
    tables = {n: f"{t.folder}/{n}.parquet" for n in ("orders", "customer")}
    return execution.execution_match(prediction_pairs(t), {"shop": tables}).select("log_id", "match")


@query(
    f"""WITH {SQL_MATCHES} SELECT round(avg(CAST(exact AS INT)), 6) AS exact_match, round(avg(CAST(same_skeleton AS INT)), 6) AS skeleton_match, (SELECT count(*) FROM norm) AS n_golds FROM m"""
)
def merged_metrics(t: Tables) -> DataFrame:
    scores = matches(t).agg(
        F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_match"),
        F.round(F.avg(F.col("same_skeleton").cast("double")), 6).alias("skeleton_match"),
    )
    return evaluate.merge_metrics(scores, query_log(t).agg(F.count("*").alias("n_golds")))


@query(
    """SELECT o_orderkey AS log_id, 'db' || o_custkey AS db_id, 'Customer,Orders,' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS tables,
    CAST(9 + c_nationkey % 3 + 2 AS BIGINT) AS n_columns, '1,4,9,10' AS primary_keys, '5,9' AS fk_columns, '1,1' AS fk_targets FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def gold_records(t: Tables) -> DataFrame:
    golds = evaluate.register_golds(query_log(t), raw_catalog(t))

    def text(name: str):
        return F.array_join(F.col(name).cast("array<string>"), ",")

    return golds.select(
        "log_id", "db_id", text("db_table_names").alias("tables"), F.size("column_name").cast("bigint").alias("n_columns"),
        text("db_primary_keys").alias("primary_keys"), text("column_id").alias("fk_columns"), text("other_column_id").alias("fk_targets"),
    )
