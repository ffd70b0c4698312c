import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluate, interaction, losses
from corpuslab.session import cut


def tokens(spark, name, texts, keep=None):
    rows = [
        (i, p, [float(x) for x in v], True if keep is None else keep[i][p]) for i, t in enumerate(texts) for p, v in enumerate(t)
    ]
    return spark.createDataFrame(rows, f"{name} int, pos int, vec array<double>, keep boolean")


def test_maxsim_fixture(spark):
    q = tokens(spark, "query_id", [[(1, 0), (0, 1)]])
    d = tokens(spark, "doc_id", [[(1, 0), (0.6, 0.8)]])
    pairs = spark.createDataFrame([(0, 0)], "query_id int, doc_id int")
    assert math.isclose(interaction.maxsim(pairs, q, d).first().score, 1.8)
    assert math.isclose(interaction.maxsim(pairs, q, d, "l2").first().score, -0.4)


def test_maxsim_pieces_masks_and_split(spark):
    rng = np.random.default_rng(7)
    qs = [rng.standard_normal((n, 3)) for n in (70, 150)]
    ds = [rng.standard_normal((n, 3)) for n in (5, 130, 3)]
    keep = [list(map(bool, rng.random(len(d)) < 0.7)) for d in ds]
    keep[2] = [False] * 3
    q, d = tokens(spark, "query_id", qs), tokens(spark, "doc_id", ds, keep)
    pairs = spark.createDataFrame([(a, b) for a in range(2) for b in range(3)], "query_id int, doc_id int")
    scores = {(r.query_id, r.doc_id): r.score for r in interaction.maxsim(pairs, q, d).collect()}
    split = {(r.query_id, r.doc_id): r.score for r in interaction.maxsim_split(pairs, q, d).collect()}
    for (a, b), score in scores.items():
        table = qs[a] @ ds[b].T
        table[:, ~np.array(keep[b])] = -9999
        best = table.max(axis=1)
        assert math.isclose(score, best.sum(), rel_tol=1e-9)
        rest = best[64:]
        want = np.sort(best[:64])[-32:].sum() + (np.sort(rest)[-8:].sum() if len(rest) >= 8 else 0)
        assert math.isclose(split[a, b], want, rel_tol=1e-9)
    top = interaction.rerank_all(q, d, 2).collect()
    for a in range(2):
        order = sorted(range(3), key=lambda b: (-scores[a, b], b))[:2]
        assert [r.doc_id for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == a] == order


def clustered(rng, texts, centres, spread):
    out = []
    for i in range(texts):
        # A text's tokens come from three centres.
        own = rng.integers(0, len(centres), 3) if spread < 1 else rng.integers(0, len(centres), 8)
        out.append(centres[rng.choice(own, 2 + i % 7)] + spread * rng.standard_normal((2 + i % 7, centres.shape[1])))
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_rerank_pruned_equals_all(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((24, 16)) * 2
    q = tokens(spark, "query_id", clustered(rng, 40, centres, spread))
    docs = clustered(rng, 600, centres, spread)
    keep = [list(map(bool, rng.random(len(d)) < 0.9)) for d in docs]
    keep[3] = [False] * len(docs[3])
    docs += docs[10:20]  # ties
    keep += keep[10:20]
    d = tokens(spark, "doc_id", docs, keep)
    counted = {}
    got = interaction.rerank_pruned(q, d, 4, cells=64, counted=counted).collect()
    want = interaction.rerank_all(q, d, 4).collect()
    assert {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in got} == {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 9)) for r in want}
    assert len(got) == 160 and counted["all"] == 40 * 610
    print("scored share", spread, counted["scored"] / counted["all"])
    assert spread > 1 or counted["scored"] < 0.15 * counted["all"]


def test_rerank_all_cuts_queries_finer(spark, monkeypatch):
    """A pair of blocks takes as long as its queries times its documents, so more queries make more tasks, not longer ones."""
    q = spark.createDataFrame([(i, 0, [float(i)]) for i in range(64)], "query_id int, pos int, vec array<double>")
    d = spark.createDataFrame([(i, 0, [float(i)]) for i in range(64)], "doc_id int, pos int, vec array<double>")
    made, blocks = [], interaction._blocks
    monkeypatch.setattr(interaction, "_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    assert len(interaction.rerank_all(q, d, 2, block_tokens=32).collect()) == 128
    assert made == [16, 2]


def test_rerank_pruned_lists_no_pairs(spark, monkeypatch):
    """Where nothing can be pruned, what is kept on the way grows with the texts, not with their pairs. Copies tie by id."""
    rng = np.random.default_rng(3)
    vecs = rng.standard_normal((400, 8))
    vecs[200:] = vecs[:200]
    q = spark.createDataFrame([(i // 2, i % 2, v.tolist()) for i, v in enumerate(vecs[:100])], "query_id int, pos int, vec array<double>")
    d = spark.createDataFrame([(i // 2, i % 2, v.tolist()) for i, v in enumerate(vecs)], "doc_id int, pos int, vec array<double>")
    kept = []
    monkeypatch.setattr(interaction, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = interaction.rerank_pruned(q, d, 4, cells=4).collect()
    assert max(df.count() for df in kept) <= 50 * 4
    want = interaction.rerank_all(q, d, 4, block_tokens=16).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == sorted((r.query_id, r["rank"], r.doc_id) for r in want)
    assert all(r.doc_id < 100 for r in got if r["rank"] == 1)


def test_rerank_pruned_small(spark):
    """Fewer documents than k, texts without a kept token, groups, small blocks, no documents."""
    rng = np.random.default_rng(6)
    docs = [rng.standard_normal((n, 3)) for n in (1, 4, 2, 6, 3)]
    d = tokens(spark, "doc_id", docs, [[True], [True] * 4, [False] * 2, [True, False] * 3, [True] * 3]).withColumn("type", F.col("doc_id") % 2)
    q = tokens(spark, "query_id", [rng.standard_normal((n, 3)) for n in (2, 3, 5)]).withColumn("type", F.col("query_id") % 2)
    for by in (None, ["type"]):
        for block in (4, 65_536):
            got, want = (sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in f(q, d, 9, by=by, block_tokens=block).collect()) for f in (interaction.rerank_pruned, interaction.rerank_all))
            assert got == want and len(got) == (15 if by is None else 8)
    assert interaction.rerank_pruned(q, d.limit(0), 3).isEmpty()


def rows_of(matrices, **columns):
    return pa.table({"m": pa.array([m.tolist() for m in matrices], pa.list_(pa.list_(pa.float64()))), **columns})


@pytest.mark.parametrize("spread, scale", [(0.02, 1.0), (3.0, 1.0), (3.0, 1e17), (3.0, float("nan"))])
def test_blocks_are_scored_by_products_of_many_tokens(monkeypatch, spread, scale):
    """Where bounds spare little, documents are not taken one query at a time; the k best are those of a full sort, whatever the blocks."""
    rng, taken, within = np.random.default_rng(15), [], interaction._best_within
    monkeypatch.setattr(interaction, "_best_within", lambda *a: taken.append(1) or within(*a))
    centres = rng.standard_normal((16, 8)) * 4
    asked = [centres[rng.choice(16, 1 + i % 5)] + spread * rng.standard_normal((1 + i % 5, 8)) for i in range(90)]
    docs = [centres[rng.choice(rng.integers(0, 16, 2), i % 12)] + spread * rng.standard_normal((i % 12, 8)) for i in range(300)]
    docs += docs[:40]
    if np.isfinite(scale):
        docs = [m * scale for m in docs]
    else:
        docs[17][0, 0] = np.inf
    cells = [np.unique([((t - centres * (scale if np.isfinite(scale) else 1)) ** 2).sum(axis=1).argmin() for t in m]).astype(np.int32) if len(m) else np.zeros(0, np.int32) for m in docs]
    far = float(max(np.sqrt(((t - c) ** 2).sum()) for m in docs for t in m for c in centres if np.isfinite(t).all())) if spread > 1 else 0.2 * scale
    held = rows_of(docs, doc_id=np.arange(340), cells=pa.array([c.tolist() for c in cells], pa.list_(pa.int32())), reach=pa.array([[far] * len(c) for c in cells], pa.list_(pa.float64())))
    left = rows_of(asked, query_id=np.arange(90), floor=np.full(90, -np.inf))
    block = interaction._Asked(left, 4, centres * (scale if np.isfinite(scale) else 1))
    for some in (held.slice(0, 100), held.slice(100, 3), held.slice(103)):
        block.meet(some)
    out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("distance", pa.float64())])
    got = block.found(out).to_pylist()
    if np.isfinite(scale):
        for i, m in enumerate(asked):
            score = [float((d @ m.T).max(axis=0).sum()) if len(d) else interaction.NO_TOKEN * len(m) for d in docs]
            want = sorted(range(340), key=lambda j: (-score[j], j))[:4]
            assert [(r["doc_id"], -r["distance"]) for r in got if r["query_id"] == i] == [(j, score[j]) for j in want]
    assert bool(taken) == (spread < 1 or not np.isfinite(scale))


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(16)
    centres = rng.standard_normal((8, 5))
    docs = [rng.standard_normal((n, 5)) for n in rng.integers(1, 9, 200)]
    own = [((d[:, None] - centres) ** 2).sum(2).argmin(axis=1) for d in docs]
    cells = [np.unique(o) for o in own]
    reach = [np.array([np.sqrt(((d[o == c] - centres[c]) ** 2).sum(1)).max() for c in u]) for d, o, u in zip(docs, own, cells)]
    sizes = np.array([len(c) for c in cells] + [0])
    asked = [rng.standard_normal((n, 5)) for n in (3, 1, 0, 7, 3)]
    for matrix, bound in zip(asked, interaction._bounds(asked, centres, np.concatenate(cells), np.concatenate(reach), sizes, True)):
        score = np.array([(d @ matrix.T).max(axis=0).sum() if len(matrix) else 0.0 for d in docs])
        plain = np.array([(matrix @ centres[c].T + np.sqrt((matrix**2).sum(1))[:, None] * r).max(axis=1).sum() for c, r in zip(cells, reach)])
        assert (bound[:-1] >= score).all() and np.allclose(bound[:-1], plain, atol=1e-3) and bound[-1] == interaction.NO_TOKEN * len(matrix)


def test_recall_counts_texts(spark):
    e = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate("aabcd")], "query_id int, rank int, text string")
    g = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate("abxyz")], "query_id int, rank int, text string")
    assert evaluate.recall_at(e, g).first().recall_5 == 3.0


def test_ema(spark):
    rows = spark.createDataFrame([("r", 0, 10.0), ("r", 1, 0.0), ("s", 0, 10.0)], "run string, step int, loss double")
    out = {r.run: r.ema for r in evaluate.ema(rows, "run", ["step"], "loss").collect()}
    assert math.isclose(out["r"], 9.99) and math.isclose(out["s"], 10.0)


def test_ema_of_a_hot_key(spark):
    n = 30000
    rows = spark.range(n, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("step"), (F.col("id") % 17).cast("double").alias("x")
    )
    want = {}
    for r in rows.orderBy("step").collect():
        want[r.k] = 0.999 * want.get(r.k, r.x) + 0.001 * r.x
    got = {r.k: r.ema for r in evaluate.ema(rows, "k", ["step"], "x").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.4), (1, 0.4), (0, 0.4)], "label int, score double")
    assert evaluate.auc(rows).first().auc == 0.75


def test_report_without_positives(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    report = {r.row: r for r in evaluate.classification_report(rows).collect()}
    assert report["positives"].precision == 0 and report["negatives"].f1 == 1 and report["accuracy"].precision == 1


def test_result_match(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    same = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "q int, r string")
    fewer = spark.createDataFrame([(2, None), (1, "x")], "q int, r string")
    assert evaluate.result_match(a, same).first().match
    assert not evaluate.result_match(a, fewer).first().match
    assert not evaluate.result_match(a, fewer.select("q")).first().match


def test_accuracy_skips_negative_turns(spark):
    rows = spark.createDataFrame(
        [(True, ["join", "nested"], "easy", 0), (False, ["join"], "hard", 0), (False, [], "hard", -1)],
        "correct boolean, tags array<string>, hardness string, turn_idx int",
    )
    got = {(r.kind, r.value): (r.correct, r.total) for r in evaluate.accuracy_by(rows).collect()}
    assert got["tag", "join"] == (1, 2) and got["tag", "nested"] == (1, 1)
    assert got["tags", "join+nested"] == (1, 1) and got["hardness", "hard"] == (0, 1) and got["all", "all"] == (1, 2)


def test_losses(spark):
    rng = np.random.default_rng(8)
    scores, targets = rng.standard_normal((6, 8)), rng.standard_normal((6, 8))
    rows = spark.createDataFrame(
        [(g, s, float(scores[g, s]), float(targets[g, s])) for g in range(6) for s in range(8)],
        "g int, slot int, score double, target double",
    )

    def log_softmax(x):
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    ce = {r.g: r.loss for r in losses.contrastive_ce(rows, ["g"]).collect()}
    assert np.allclose([ce[g] for g in range(6)], -log_softmax(scores)[:, 0])
    easy = {r.g: r.loss for r in losses.contrastive_ce(rows, ["g"], losses.easy_slots(8, 2)).collect()}
    assert np.allclose([easy[g] for g in range(6)], -log_softmax(scores[:, [0, 6, 7]])[:, 0])
    kl = {r.g: r.loss for r in losses.listwise_kl(rows, ["g"], 0.5).collect()}
    lt = log_softmax(targets * 0.5)
    assert np.allclose([kl[g] for g in range(6)], (np.exp(lt) * (lt - log_softmax(scores))).sum(axis=1))
    rate = losses.top1_rate(rows, ["g"]).first().top1_rate
    assert math.isclose(rate, (scores.argmax(1) == targets.argmax(1)).mean())
    assert losses.top1_rate(rows, ["g"], ("g", 0)).first().n_groups == 1


def test_filters(spark):
    rows = spark.createDataFrame(
        [("wta_1", ["join"], None), ("x", ["nested"], "m")], "db_id string, difficulty_type array<string>, domain string"
    )
    assert evaluate.filtered_samples(rows, mini_test=True).count() == 1
    assert evaluate.filtered_samples(rows, difficulty_types=["nested", "join"], domains=["m"]).first().db_id == "x"
    with pytest.raises(ValueError):
        evaluate.filtered_samples(rows, db_ids=["none"], must_exist=True)


def test_epoch_order(spark):
    names = spark.createDataFrame([("epoch_10",), ("run/epoch_2",)], "n string")
    assert sorted(r.e for r in names.select(evaluate.epoch_number(F.col("n")).alias("e")).collect()) == [2, 10]


def test_filter_reaches_the_scan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("lang").alias("db_id"))
    plan = evaluate.filtered_samples(docs, ["fr"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in plan or "PushedFilters: [In(lang" in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_execution_match(spark, folder):
    """Untrusted predictions: commands are refused, failures count for their own id, views stay."""
    spark.range(3).createOrReplaceTempView("customer")
    gold = "SELECT c_custkey FROM customer"
    statements = [
        ("same", gold, "SELECT c_custkey AS k FROM customer"), ("fails", gold, "SELECT CAST(c_name AS INT) FROM customer"),
        ("drops", gold, "DROP VIEW customer"), ("writes", gold, "WITH x AS (SELECT 1) INSERT INTO customer SELECT * FROM x"), ("none", gold, "no sql"), ("after", gold, gold),
    ]
    out = {r.id: r.match for r in evaluate.execution_match(spark, statements, {"customer": f"{folder}/customer.parquet"}).collect()}
    assert out == {"same": True, "fails": False, "drops": False, "writes": False, "none": False, "after": True}
    assert spark.table("customer").count() == 3
    with pytest.raises(Exception):
        evaluate.execution_match(spark, [("x", "SELECT nothing FROM customer", gold)], {"customer": f"{folder}/customer.parquet"})


def test_rerank_all_has_a_task_for_each_pair_of_blocks(spark, monkeypatch):
    from corpuslab.operators import nearest as nn

    monkeypatch.setattr(nn, "FEW_TASKS", 4)
    q = spark.createDataFrame([(i, 0, [float(i)]) for i in range(64)], "query_id int, pos int, vec array<double>")
    found = interaction.rerank_all(q, q.withColumnRenamed("query_id", "doc_id"), 2, block_tokens=32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and ", 32\n" in plan and len(found.collect()) == 128


def test_tags_read_one_normal_form(spark, folder, monkeypatch):
    """Three normal forms, of the log, the gold and the prediction, and not one for each test of the tags."""
    from corpuslab.plans import load

    monkeypatch.setattr(evaluate, "accuracy_by", lambda rows: rows)
    plan = load().QUERIES["accuracy_by_tag"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 3


def test_epoch_sweep_copies_no_vectors(spark, tmp_path):
    """With several blocks of queries no run repeats vectors for the blocks that they meet. The last run ranks as the golden lists do."""
    from __spark_entry__ import queries

    rng = np.random.default_rng(17)
    rows = pa.table({"vec_id": np.arange(9000), "embedding": pa.array(rng.standard_normal((9000, 4)).tolist(), pa.list_(pa.float32())), "label": pa.array(np.zeros(9000), pa.int32())})
    pq.write_table(rows, f"{tmp_path}/embeddings.parquet")
    found = queries()["epoch_sweep"](spark, str(tmp_path))
    assert "explode" not in found._jdf.queryExecution().toString()
    got = {r.epoch: r for r in found.collect()}
    assert sorted(got) == [1, 2, 10, 20] and got[20].gap == 0 and got[20].golden_distance == got[1].golden_distance
    assert min(got[i].gap for i in (1, 2, 10)) > 0
