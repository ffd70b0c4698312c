"""What the stages write and send between tasks beside their results."""

import random

from corpuslab.llm import neardup, quality, tiling


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_quality_writes_no_texts(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60 if i % 3 else 20), f"s{i % 4}") for i in range(40)] + [(40, None, "s0"), (41, "", None), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = quality.judged(docs, keep=["doc_id"]).select("doc_id", "n_words", "host_rate", "kept")
    written, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df: written.append(df.columns) or cut(df))
    out = quality.judged(docs)
    assert written and not any("text" in columns for columns in written)
    assert sorted(map(str, out.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert {(r.doc_id, r.text, r.source) for r in out.collect()} == set(rows)


def test_near_duplicates_send_sketches_of_shared_nodes_only(spark, monkeypatch):
    rng = random.Random(2)
    alone = [(i, prose(rng, 80)) for i in range(200)]
    pairs = [(i, text + " " + end) for i, text in enumerate((prose(rng, 80) for _ in range(5)), 1000) for end in ("x", "y")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(alone + pairs)], "doc_id long, text string")
    sent, slim = [], neardup.slim
    monkeypatch.setattr(neardup, "slim", lambda classes, slots: sent.append(classes.count()) or slim(classes, slots))
    got = {r["doc_id"]: r["component_id"] for r in neardup.grouped(docs).collect()}
    assert got == {i: i if i < 200 else i - i % 2 for i in range(210)}
    assert 10 <= sent[0] < 100


def test_sets_of_other_classes_stay_out(spark):
    """The second confirmation joins the sets of its own pairs alone, though those of the first are there."""
    rng = random.Random(3)
    texts = [text + " " + end for text in (prose(rng, 80) for _ in range(6)) for end in ("x", "y")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = neardup.sketched(docs, 5).select("class", "text_key", "doc_id")
    name = {r["doc_id"]: bytes(r["class"]) for r in classes.collect()}
    join = neardup.Join(docs, classes, 5, neardup.Rule(80), "text")
    first = spark.createDataFrame([(name[i],) for i in range(10)], "class binary")
    second = spark.createDataFrame([(name[i],) for i in (0, 11)], "class binary")
    assert {bytes(r["class"]) for r in join.full_sets(first).collect()} == {name[i] for i in range(10)}
    assert {bytes(r["class"]) for r in join.full_sets(second).collect()} == {name[0], name[11]}


def test_overlaps_list_the_texts_that_they_need(spark, monkeypatch):
    rng = random.Random(4)
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, prose(rng, 50) + " " + item), (2, prose(rng, 90)), (3, None)], "doc_id long, text string")
    lists, listed = [], tiling.listed
    monkeypatch.setattr(tiling, "listed", lambda keys, *a: lists.append(keys.columns) or listed(keys, *a))
    assert tiling.overlaps(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 1
    assert ["doc_key"] in lists
