import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import batching, mining, ordering, selection
from corpuslab.operators import nearest as nn
from corpuslab.sources import sinks


def line(spark, places, texts=None):
    rows = [(i, [float(x), 0.0], (texts or "x" * len(places))[i]) for i, x in enumerate(places)]
    docs = spark.createDataFrame(rows, "doc_id bigint, vec array<double>, key string")
    return docs.withColumnRenamed("doc_id", "query_id"), docs


def test_bands_of_one_query(spark):
    # Squared distances 0, 0.5, 0.6, 1, 2; texts s t s u v.
    places = [0, 0.5**0.5, 0.6**0.5, 1, 2**0.5]
    q, d = line(spark, places, "stsuv")
    bands = mining.mine_bands(q.where("query_id = 0"), d, n_pos=1, gap=1, n_neg=1, mode="text", keep_gap=True)
    got = [(r.doc_id, r.band, round(r.score, 6)) for r in bands.orderBy("rank").collect()]
    assert got == [(1, "pos", 19.607843), (2, "gap", round(10 / 0.61, 6)), (3, "hard", 9.90099)]
    sizes = mining.easy_band_sizes(q.where("query_id = 0"), d, 1, 1, 1).first()
    assert (sizes.run, sizes.first_rank, sizes.n_easy) == (1, 4, 1)
    drawn = mining.easy_draws(q.where("query_id = 0"), d, 3, "s", 1, 1, 1).collect()
    # Only one document is easy, so that one is all there is.
    assert [(r.doc_id, round(r.score, 6)) for r in drawn] == [(4, 4.975124)]


def test_all_copies_give_nothing(spark):
    q, d = line(spark, [1, 1, 1])
    assert mining.mine_bands(q, d, 1, 0, 1).isEmpty()
    assert mining.mine_bands(q, d, 1, 0, 1, mode="text").isEmpty()


def test_draws_are_complete_and_distinct(spark):
    # A third of all documents are copies of the query, which draws skip.
    q, d = line(spark, [0] * 30 + list(range(1, 61)))
    drawn = mining.easy_draws(q.where("query_id < 3"), d, 40, "seed", n_pos=5, gap=2, n_neg=10)
    rows = drawn.collect()
    assert len(rows) == 3 * 40
    for query in range(3):
        ids = [r.doc_id for r in rows if r.query_id == query]
        assert len(set(ids)) == 40
        # Ranks 1..17 after the run are documents 30..46.
        assert all(i > 46 for i in ids)
    everything = mining.easy_draws(q.where("query_id = 0"), d, 1000, "seed", n_pos=5, gap=2, n_neg=10)
    assert sorted(r.doc_id for r in everything.collect()) == list(range(47, 90))


def test_pos_neg(spark):
    q, d = line(spark, [0, 0, 0] + list(range(1, 41)))
    rows = mining.mine_pos_neg(q.where("query_id = 0"), d, 5, "9").collect()
    pos = [r for r in rows if r.band == "pos"]
    neg = [r for r in rows if r.band == "neg"]
    assert sorted(r.doc_id for r in pos) == [3, 4, 5, 6, 7]
    assert len({r.doc_id for r in neg}) == 5
    # Not a positive, not among the 6 nearest, not the last.
    assert not {r.doc_id for r in neg} & ({0, 1, 2, 3, 4, 5, 6, 7} | {42})
    assert all(abs(r.score - 10 / (r.doc_id - 2) ** 2) < 1e-9 for r in neg)
    text = sinks.pos_neg_lines(mining.mine_pos_neg(q.where("query_id = 0"), d, 5, "9")).first().line
    assert text.startswith('["0", ["3", ') and text.count("[") == 11


def test_shuffled_is_a_permutation():
    for size in (1, 2, 3, 4, 5, 17, 64, 65, 1000):
        for key in range(3):
            keys = np.tile(np.array([key * 7919 + 11, 5 << key, 123456 + key, 0xFFFFFF - key]), (size, 1))
            got = mining.shuffled(np.arange(size), np.full(size, size), keys)
            assert sorted(got.tolist()) == list(range(size))
    far = mining.shuffled(np.arange(1000), np.full(1000, 10**11), np.tile(np.arange(4), (1000, 1)))
    assert len(set(far.tolist())) == 1000 and 0 <= far.min() and far.max() < 10**11 and far.std() > 10**10


def test_draws_are_even(spark):
    """Over many draws every free document comes equally often, the others never."""
    q, d = line(spark, [0, 0, 0] + list(range(1, 18)))
    asked = q.where("query_id = 0").crossJoin(spark.range(600)).select(F.col("id").cast("string").alias("draw_id"), "query_id", "vec")
    out = spark.createDataFrame([(0, i) for i in (4, 9, 10, 19)], "query_id bigint, doc_id bigint")
    rows = mining.draw(asked, d, 4, "s", out, skip_zero=True).collect()
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert len(rows) == 2400 and set(count) == set(range(3, 20)) - {4, 9, 10, 19}
    assert max(abs(n - 2400 / 13) for n in count.values()) < 60
    firsts = {r.doc_id for r in rows if r.pick == 1}
    assert firsts == set(count)


def test_draws_skip_copies_by_direction(spark):
    rows = [(0, [1.0, 0.1, 0.3]), (1, [3.0, 0.3, 0.9]), (2, [0.7, 0.07, 0.21]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [-1.0, -0.1, -0.3])]
    d = spark.createDataFrame(rows, "doc_id bigint, vec array<double>")
    q = d.where("doc_id = 0").select(F.lit("a").alias("draw_id"), F.col("doc_id").alias("query_id"), "vec")
    assert {r.doc_id for r in mining.draw(q, d, 9, "s", None, "cosine", skip_zero=True).collect()} == {3, 4, 5}
    assert {r.doc_id for r in mining.draw(q, d, 9, "s", None, "l2", skip_zero=True).collect()} == {1, 2, 3, 4, 5}
    assert len(mining.draw(q, d, 9, "s").collect()) == 6


def test_jobs_do_not_grow_with_documents(spark):
    """What is excluded and how many documents there are changes no number of jobs."""
    tracker, seen = spark.sparkContext.statusTracker(), []
    for i, many in enumerate((40, 4000)):
        q, d = line(spark, [0] * (many // 2) + list(range(1, many // 2 + 1)))
        spark.sparkContext.setJobGroup(f"draws{i}", "")
        mining.draw(q.where("query_id < 5").withColumn("draw_id", F.col("query_id").cast("string")), d, 10, "s", None, skip_zero=True).collect()
        seen.append(len(tracker.getJobIdsForGroup(f"draws{i}")))
    spark.sparkContext.setJobGroup("", "")
    assert seen[0] == seen[1]


def test_groups(spark):
    q, d = line(spark, range(120))
    bands = mining.mine_bands(q, d, n_pos=2, gap=1, n_neg=40, keep_gap=True)
    groups = batching.nway_groups(bands, q, d, nway=32, easy_nway=5, seed="1").collect()
    by_pair = {}
    for r in groups:
        by_pair.setdefault((r.query_id, r.pos_id), {})[r.slot] = r.doc_id
    assert len(by_pair) == 240
    rank = {(r.query_id, r.doc_id): r["rank"] for r in bands.collect()}
    for (query, pos), slots in by_pair.items():
        assert sorted(slots) == list(range(32)) and slots[0] == pos
        assert len(set(slots.values())) == 32 and query not in slots.values()
        assert all(4 <= rank[query, slots[i]] <= 43 for i in range(1, 27))
        assert all((query, slots[i]) not in rank for i in range(27, 32))
    again = batching.nway_groups(bands, q, d, nway=32, easy_nway=5, seed="1", epoch=1).collect()
    assert set(map(tuple, again)) != set(map(tuple, groups))


def test_shortage_is_an_error(spark):
    q, d = line(spark, range(20))
    bands = mining.mine_bands(q, d, n_pos=1, gap=0, n_neg=5)
    with pytest.raises(Exception, match="too few negatives"):
        batching.nway_groups(bands, q, d, nway=8, easy_nway=1).collect()
    with pytest.raises(ValueError):
        batching.nway_groups(bands, q, d, nway=8, easy_nway=7)


def test_batches_mark_the_incomplete_one(spark):
    rows = batching.epoch_order(spark.range(35).withColumnRenamed("id", "pair"), ["pair"], "s", 0)
    cut = batching.batches(rows, 35, 16, accumsteps=4)
    got = cut.collect()
    assert len(got) == 35 and {(r.batch, r.complete) for r in got} == {(0, True), (1, True), (2, False)} and {r.micro_batch for r in got} == {0, 1, 2, 3}
    assert sorted(r.ordinal for r in rows.collect()) == list(range(35))
    two = batching.batches(rows, 35, 4, nranks=2).where("complete").groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in two} == {0: 16, 1: 16}


def test_sort_by_length(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 1, 4, 1, 3])], "g int, o int, n int")
    done = batching.sort_by_length(rows, ["g"], "n", "o", 2).orderBy("o").collect()
    assert [r.new_place for r in done] == [4, 0, 3, 1, 2]
    assert [r.old_place for r in done] == [0, 1, 2, 3, 4]
    short = batching.sort_by_length(rows, ["g"], "n", "o", 5).orderBy("o").collect()
    assert [r.new_place for r in short] == [0, 1, 2, 3, 4]


def test_length_buckets(spark):
    rows = spark.createDataFrame([(i,) for i in range(1, 101)], "n int")
    got = {r.n: r.bucket for r in batching.length_buckets(rows, "n").collect()}
    assert got[1] == got[50] == 50 and got[51] == got[75] == 75 and got[76] == 90 and got[95] == 95 and got[96] == 100


def test_padding(spark):
    row = spark.createDataFrame([(["a", ",", "b", "c"],)], "t array<string>")
    out = row.select(
        batching.doc_tokens(F.col("t"), 6).alias("d"), batching.query_tokens(F.col("t"), 9).alias("q"),
        batching.query_tokens(F.col("t"), 6, full_length=True).alias("full"),
        batching.query_tokens(F.col("t"), 7, context=F.col("t"), context_maxlen=4).alias("both"),
        batching.keep_mask(F.array(*[F.lit(x) for x in ("a", ",", "[PAD]")])).alias("k"),
    ).first()
    assert out.d == [["[CLS]", "[D]", "a", ",", "b", "[SEP]"], ["[CLS]", "[D]", "c", "[SEP]"]]
    assert out.q == [["[CLS]", "[Q]", "a", ",", "b", "c", "[SEP]", "[MASK]", "[MASK]"]]
    assert out.full == [["[CLS]", "[Q]", "a", ",", "b", "[SEP]"], ["[CLS]", "[Q]", "c", "[SEP]", "[MASK]", "[MASK]"]]
    assert out.both == [["[CLS]", "[Q]", "a", ",", "b", "c", "[SEP]", "a", ",", "[SEP]"], ["[CLS]", "[Q]", "[SEP]", *["[MASK]"] * 4, "b", "c", "[SEP]"]]
    assert out.k == [True, False, False]
    two = spark.createDataFrame([(0, ["a"]), (0, ["a", "b"])], "g int, t array<string>")
    assert sorted(map(len, (r.t for r in batching.pad_longest(two, ["g"], "t").collect()))) == [2, 2]


def test_sorted_ordinal_and_totals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("w"))
    assert all(r.x == r.ordinal for r in ordering.sorted_ordinal(rows, ["x"]).collect())
    assert all(r.x == r.w_below for r in ordering.running_totals(rows, "x", ["w"], buckets=16).collect())


def test_rerank_formats():
    selection.check_rerank_formats("question", "sql", "spider", type_filter=True)
    selection.check_rerank_formats("question_evidence", "sql", "bird")
    for bad in (("question", "x", "bird"), ("question_evidence", "sql", "spider"), ("sql", "sql", "bird")):
        with pytest.raises(ValueError):
            selection.check_rerank_formats(*bad)
    with pytest.raises(ValueError):
        selection.check_rerank_formats("question_evidence", "sql", "bird", type_filter=True)


def test_rerank_whole_pool_by_type(spark):
    rows = spark.createDataFrame(
        [("a", "red fox", "fox runs", ["x"]), ("b", "blue fish", "fish swims blue", ["x"]), ("c", "red fish", "blue fish red fish", [])],
        "id string, question string, sql string, difficulty_type array<string>",
    )
    every = selection.rerank_by_text(rows, rows, 2).collect()
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in every}
    assert got["c", 1] == ("c", 2.0) and got["b", 1] == ("b", 2.0) and got["b", 2] == ("c", 2.0)
    typed = selection.rerank_by_text(rows, rows, 5, type_tags="difficulty_type").collect()
    assert {(r.query_id, r.doc_id) for r in typed} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")}
    picked = selection.select_examples(rows, rows, 1, fields="QUESTION_SQL", similarity="COSINE")
    assert all(r.query_id == r.doc_id for r in picked.collect())


def test_text_mode_searches_twice(spark):
    """The first search is written once, not run again for what the second one asks of its queries."""
    q, d = line(spark, [0, 1, 2, 3], "aabb")
    plan = mining.after_own_run(q, d, 2, mode="text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_two_stages_run_once(spark, folder):
    from corpuslab.plans import load

    plan = load().QUERIES["select_two_stage"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan


def test_run_by_text_searches_all_documents_once(spark, monkeypatch):
    """Documents with the query's text are searched among themselves, and only where some may come after the run; rows without a text are alike."""
    rng, searched, plain = np.random.default_rng(12), [], nn.nearest
    monkeypatch.setattr(nn, "nearest", lambda q, d, *a, **how: searched.append((q.count(), how.get("only_same_key", False))) or plain(q, d, *a, **how))
    for apart in (False, True):
        vectors = rng.integers(0, 2, (60, 2)).astype(float)
        texts = ["abc"[i] for i in rng.integers(0, 3, 60)] if not apart else [f"{v[0]}{v[1]}" for v in vectors]
        texts = [None if x in ("c", "0.00.0") else x for x in texts]
        docs = spark.createDataFrame([(i, v.tolist(), x) for i, (v, x) in enumerate(zip(vectors, texts))], "doc_id bigint, vec array<double>, key string")
        searched.clear()
        got = {(r.query_id, r["rank"], r.doc_id) for r in mining.after_own_run(docs.withColumnRenamed("doc_id", "query_id"), docs, 7, mode="text").collect()}
        want = set()
        for i in range(60):
            order = sorted(range(60), key=lambda j: (((vectors[i] - vectors[j]) ** 2).sum(), j))
            while order and texts[order[0]] == texts[i]:
                order.pop(0)
            want |= {(i, r + 1, j) for r, j in enumerate(order[:7])}
        assert got == want
        assert [own for _, own in searched] == [False, True]
        assert not apart or searched[1][0] == 0
