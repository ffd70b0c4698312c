import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions.vectors import native_distance, unit
from corpuslab.operators import mining
from corpuslab.operators import coded
from corpuslab.operators import nearest as nn


def native_nearest(q, d, k, metric):
    pairs = q.crossJoin(d.withColumnRenamed("vec", "dvec"))
    return nn.top(pairs.select("query_id", "doc_id", native_distance(F.col("vec"), F.col("dvec"), metric).alias("distance")), k)


def frames(spark, vectors, tags=None):
    rows = [(i, [float(x) for x in v], int(tags[i]) if tags is not None else 0) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, "doc_id bigint, vec array<float>, tag int")
    return docs.withColumnRenamed("doc_id", "query_id"), docs


def as_set(df):
    return {(r.query_id, r.doc_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_kernel_equals_native(spark, metric):
    vectors = np.random.default_rng(1).integers(-3, 4, (90, 3))  # many ties and copies
    q, d = frames(spark, vectors)
    got, want = nn.nearest(q, d, 7, metric, block_rows=16), native_nearest(q, d, 7, metric)
    if metric == "cosine":  # equal angles differ by rounding between the two forms
        def sets(df):
            return sorted((r.query_id, round(r.distance, 9)) for r in df.collect())
        assert sets(got) == sets(want)
    else:
        assert as_set(got) == as_set(want)


def test_hot_group_is_split_and_whole(spark):
    rng = np.random.default_rng(2)
    vectors, tags = rng.standard_normal((120, 4)), (rng.random(120) < 0.3).astype(int)
    q, d = frames(spark, vectors, tags)
    got = nn.nearest(q, d, 5, "l2", by=["tag"], block_rows=10)
    want = set()
    for i in range(120):
        same = [j for j in range(120) if tags[j] == tags[i]]
        v = np.array(vectors, dtype=np.float32).astype(float)
        same.sort(key=lambda j: (((v[i] - v[j]) ** 2).sum(), j))
        want |= {(i, j, r + 1) for r, j in enumerate(same[:5])}
    assert as_set(got) == want


def test_string_ids(spark):
    _, d = frames(spark, [[0, 0], [1, 0], [1, 0], [3, 0]])
    d = d.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = nn.nearest(d.withColumnRenamed("doc_id", "query_id"), d, 2)
    assert ("d0", "d1", 2) in as_set(got) and ("d2", "d1", 1) in as_set(got)


def brute_ranking(vectors, i):
    return sorted(range(len(vectors)), key=lambda j: (((vectors[i] - vectors[j]) ** 2).sum(), j))


def test_zero_distance_and_farthest(spark):
    vectors = np.random.default_rng(3).integers(0, 3, (40, 2)).astype(float)
    q, d = frames(spark, vectors)
    got = nn.nearest(q, d, 4, drop_zero=True, block_rows=8)
    last = nn.nearest(q, d, 1, farthest=True, block_rows=8)
    want, want_last = set(), set()
    for i in range(40):
        order = [j for j in brute_ranking(vectors, i) if (vectors[i] != vectors[j]).any()]
        want |= {(i, j, r + 1) for r, j in enumerate(order[:4])}
        want_last.add((i, brute_ranking(vectors, i)[-1], 1))
    assert as_set(got) == want
    assert as_set(last) == want_last


def test_leading_run_by_text(spark):
    rng = np.random.default_rng(4)
    vectors, texts = rng.integers(0, 2, (40, 2)).astype(float), rng.integers(0, 3, 40)
    q, d = frames(spark, vectors, texts)
    q, d = q.withColumnRenamed("tag", "key"), d.withColumnRenamed("tag", "key")
    got = mining.after_own_run(q, d, 5, mode="text")
    want = set()
    for i in range(40):
        order = brute_ranking(vectors, i)
        while order and texts[order[0]] == texts[i]:
            order.pop(0)
        want |= {(i, j, r + 1) for r, j in enumerate(order[:5])}
    assert as_set(got) == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_pruned_search_is_exact(spark, metric):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 5)) * 10
    vectors = centres[rng.integers(0, 6, 300)] + rng.standard_normal((300, 5)) * 0.3
    q, d = frames(spark, vectors)
    got = nn.nearest_pruned(q, d, 6, metric, cells=12, probes=1, seed=3)
    want = nn.nearest(q, d, 6, metric)
    assert as_set(got) == as_set(want)


def test_lsh_recall(spark, folder):
    vecs = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    d = q.withColumnRenamed("query_id", "doc_id")
    exact = as_set(nn.nearest(q, d, 5))
    near = nn.nearest_lsh(q, d, 5, 64, width=1.0, tables=8, hashes=1)
    found = {(a, b) for a, b, _ in as_set(near)}
    assert sum((a, b) in found for a, b, _ in exact) / len(exact) > 0.9


def test_lsh_recall_of_the_registered_query(spark, folder, monkeypatch):
    """Recall@5 of `knn_lsh` as registered, over all embeddings, by an index under which not nearly all pairs meet."""
    from __spark_entry__ import queries

    used, plain = {}, nn.bucketed
    monkeypatch.setattr(nn, "bucketed", lambda df, *how: used.update(how=how) or plain(df, *how))
    found = {(a, b) for a, b, _ in as_set(queries()["knn_lsh"](spark, folder))}
    vecs = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    exact = {(a, b) for a, b, _ in as_set(nn.nearest(q, q.withColumnRenamed("query_id", "doc_id"), 5))}
    assert len(exact & found) / len(exact) > 0.9
    rows = plain(q, *used["how"]).select("query_id", "_table", "_bucket").toPandas()
    n, met = rows["query_id"].nunique(), set()
    for _, ids in rows.groupby(["_table", "_bucket"])["query_id"]:
        met |= {(a, b) for a in ids for b in ids}
    assert len(met) < 0.75 * n * n


def test_coded_recall_of_the_registered_query(spark):
    """Recall@5 of `knn_coded` as registered, with under a tenth of the pairs compared by their vectors."""
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.01"
    found = as_set(queries()["knn_coded"](spark, folder))
    vecs = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    exact = as_set(nn.nearest(q, q.withColumnRenamed("query_id", "doc_id"), 5))
    pairs = {(a, b) for a, b, _ in found}
    assert sum((a, b) in pairs for a, b, _ in exact) / len(exact) > 0.9 and len(found) == len(exact)
    assert 40 < 0.1 * vecs.count()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_coded_search(spark, metric):
    """All ranked exactly: the result of exact search. Few: what is found has its exact distance and the right order."""
    rng = np.random.default_rng(8)
    q, d = frames(spark, rng.standard_normal((300, 7)))
    want = nn.nearest(q, d, 6, metric)
    assert as_set(coded.nearest_coded(q, d, 6, metric, rerank=300, parts=3, block_rows=64)) == as_set(want)
    few = coded.nearest_coded(q, d, 6, metric, rerank=30, parts=7, entries=16, sample=100, block_rows=64).collect()
    exact = {(r.query_id, r.doc_id): round(r.distance, 9) for r in nn.nearest(q, d, 300, metric).collect()}
    assert all(exact[r.query_id, r.doc_id] == round(r.distance, 9) for r in few)
    best = {(r.query_id, r.doc_id) for r in want.collect()}
    assert sum((r.query_id, r.doc_id) in best for r in few) > 0.9 * len(best)
    assert coded.nearest_coded(q, d.limit(0), 3).isEmpty()
    with pytest.raises(ValueError):
        coded.nearest_coded(q, d, 3, "ip")


def test_unit_keeps_zero(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r.u for r in rows.select(unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_no_pair_table_in_the_plan(spark, folder):
    vecs = spark.read.parquet(f"{folder}/embeddings.parquet")
    q = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    plan = nn.nearest(q, q.withColumnRenamed("query_id", "doc_id"), 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_rows_without_vectors(spark):
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, vec array<double>")
    d = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [2.0, 1.0])], "doc_id long, vec array<double>")
    assert [(r.query_id, r.doc_id) for r in nn.nearest(q, d, 5).collect()] == [(1, 1), (1, 3)]
    assert nn.nearest_pruned(q, d.where("vec IS NULL"), 2).count() == 0
    uneven = d.unionByName(spark.createDataFrame([(4, [1.0])], "doc_id long, vec array<double>"))
    with pytest.raises(Exception, match="vectors of"):
        nn.nearest(q, uneven, 2).collect()


def test_block_takes_little_memory():
    """What the kernel holds beside its two blocks is a bounded part of their product; the nominated rows are those of a full sort."""
    import tracemalloc

    rng = np.random.default_rng(5)
    q, d = rng.integers(0, 4, (3000, 6)).astype(float), rng.integers(0, 4, (4000, 6)).astype(float)
    ids = rng.permutation(len(d))
    tracemalloc.start()
    rows, cols, dist = nn.block_best(q, d, ids, 7, "l2")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.5 * 8 * len(q) * len(d)
    for row in (0, 1777, 2999):
        every = ((q[row] - d) ** 2).sum(1)
        order = np.lexsort((ids, every))[:7]
        assert cols[rows == row].tolist() == order.tolist() and dist[rows == row].tolist() == every[order].tolist()


def test_tables_of_codes_take_little_memory():
    """A block of any number of queries holds the tables of a bounded number."""
    import tracemalloc

    rng = np.random.default_rng(5)
    books = [rng.random((256, 2)) for _ in range(4)]
    vectors, held = rng.random((8192, 8)), rng.integers(0, 256, (4, 50)).astype(np.uint8)
    tracemalloc.start()
    found = [(best, distance) for best, distance in coded._nominated(vectors, books, held, 5)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 8192 and most < 0.5 * 8192 * 4 * 256 * 8
    for row in (0, 1023, 1024, 8191):
        every = sum(((vectors[row, 2 * i : 2 * i + 2] - books[i][held[i]]) ** 2).sum(1) for i in range(4))
        assert sorted(found[row][0]) == sorted(np.argsort(every)[:5]) and np.allclose(found[row][1], every[found[row][0]])


def test_kernel_takes_short_numbers_where_they_do(spark, monkeypatch):
    """Products are of short numbers unless the vectors lie far from zero or are not finite; the rows are those of a full sort."""
    rng, kinds, factors = np.random.default_rng(8), [], nn._factors
    monkeypatch.setattr(nn, "_factors", lambda *a: kinds.append(a[3]) or factors(*a))
    monkeypatch.setattr(nn, "_WIDTH", 300)
    q, d = rng.standard_normal((40, 5)), rng.standard_normal((900, 5))
    d[7] = 1e7  # one long vector does not make the others coarse
    for shift, wanted in ((0.0, {np.float32}), (1e6, {np.float32, np.float64})):
        for far, k in ((False, 1), (False, 9), (True, 2)):
            kinds.clear()
            rows, cols, dist = nn.block_best(q + shift, d + shift, np.arange(900), k, "l2", far)
            assert set(kinds) == wanted or far
            every = ((q[:, None] + shift - (d[None] + shift)) ** 2).sum(2)
            order = np.argsort(-every if far else every, axis=1, kind="stable")
            for row in range(40):
                assert sorted(dist[rows == row]) == sorted(np.sort(-every[row] if far else every[row])[:k] * (-1 if far else 1))
                assert shift or set(cols[rows == row]) == set(order[row][:k])


def test_search_passes_on_few_rows(spark):
    """A query brings k rows from each block of documents, which hold more rows than those of queries."""
    q, d = frames(spark, np.random.default_rng(9).standard_normal((64, 3)))
    assert nn.nearest(q, d, 3, block_rows=8, keep_rank=False).count() == 3 * 64


def test_many_pairs_of_blocks_are_tasks_of_their_own(spark):
    q, d = frames(spark, np.random.default_rng(9).standard_normal((64, 3)))
    assert nn.dealt(q, d, nn.FEW_TASKS + 44, ["tag"])[0].rdd.getNumPartitions() == nn.FEW_TASKS + 44
    assert nn.dealt(q, d, nn.FEW_TASKS, ["tag"])[0] is q


def test_blocks_are_not_copied_for_each_other(spark):
    """Rows of vectors are not repeated for the blocks of the other side: only packed blocks meet, each in a row."""
    q, d = frames(spark, np.random.default_rng(10).standard_normal((900, 4)))
    found = nn.nearest(q, d, 3, block_rows=90)
    plan = found._jdf.queryExecution().toString()
    assert "explode" not in plan and "CartesianProduct" in plan
    assert as_set(found) == as_set(nn.nearest(q, d, 3))


@pytest.mark.parametrize("how", [{}, {"farthest": True}, {"drop_zero": True}])
def test_lengths_only_spare_work(spark, how):
    """Blocks by length, one length that most rows have, lengths without a range, sides of unlike lengths: the rows are those of a full sort."""
    rng = np.random.default_rng(11)
    vectors = rng.integers(-2, 3, (500, 3)) * np.where(rng.random((500, 1)) < 0.5, 1.0, rng.integers(1, 200, (500, 1)))
    vectors[:200] = np.eye(3)[rng.integers(0, 3, 200)]
    vectors[200:210] = 0
    q, d = frames(spark, vectors)
    q = q.where("query_id % 3 > 0 AND (query_id < 400 OR query_id > 480)")
    got = {(r.query_id, r["rank"]): r.doc_id for r in nn.nearest(q, d.where("doc_id < 450"), 6, block_rows=40, **how).collect()}
    for i in [r.query_id for r in q.collect()]:
        every = [((vectors[i] - vectors[j]) ** 2).sum() for j in range(450)]
        order = sorted((j for j in range(450) if not how.get("drop_zero") or every[j] > 0), key=lambda j: (every[j], j), reverse="farthest" in how)
        assert [got[i, r + 1] for r in range(6)] == order[:6]


def test_blocks_of_other_lengths_are_passed_over(monkeypatch):
    """Sorted by length, most of the products are never formed."""
    rng, formed, matmul = np.random.default_rng(13), [], np.matmul
    d = rng.standard_normal((4000, 4)) * rng.integers(1, 5000, 4000)[:, None]
    d = d[np.argsort((d * d).sum(axis=1))]
    q = d[::10]
    monkeypatch.setattr(nn, "_WIDTH", 20)
    monkeypatch.setattr(nn.np, "matmul", lambda a, b, **how: formed.append(a.shape[0] * b.shape[1]) or matmul(a, b, **how))
    monkeypatch.setattr(nn, "_CHUNK_CELLS", 640)
    rows, cols, dist = nn.block_best(q, d, np.arange(4000), 1, "l2", bound=np.full(400, 1e4))
    assert cols.tolist() == list(range(0, 4000, 10)) and not dist.any() and sum(formed) < 0.5 * 400 * 4000


def test_coded_blocks_are_not_copied_for_each_other(spark, monkeypatch):
    """A task passes on `rerank` rows a query, not each pair of blocks; codes meet the queries by products, not by tables read entry by entry."""
    q, d = frames(spark, np.random.default_rng(14).standard_normal((600, 8)))
    met, plain = [], coded.top
    monkeypatch.setattr(coded, "top", lambda df, k: met.append(df) or plain(df, k))
    few = coded.nearest_coded(q, d, 4, rerank=20, parts=4, entries=32, block_rows=20)
    assert few.count() == 4 * 600
    plan = met[0]._jdf.queryExecution().toString()
    assert "explode" not in plan and "CartesianProduct" in plan
    assert met[0].count() < 600 * 20 * 30 / 4
    one = coded.nearest_coded(q, d, 4, rerank=20, parts=4, entries=32, block_rows=600)
    assert as_set(few) == as_set(one)
