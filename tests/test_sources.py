import json

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import documents
from corpuslab.operators import embed, linking, masking
from corpuslab.session import cut
from corpuslab.sources import jsonarray, samples, sinks
from corpuslab.sources.collection import VectorCollection, collection_name
from corpuslab.streaming.ingest import ingest_stream


def write_samples(tmp_path):
    rows = [{"question": f"q{i}", "db_id": "d", "query": f"select {i}", "question_id": 10 + i} for i in range(5)]
    path = tmp_path / "dev.json"
    path.write_text(json.dumps(rows, indent=2))
    return str(path)


def test_read_samples(spark, tmp_path):
    got = samples.read_samples(spark, write_samples(tmp_path), "spider").orderBy("ordinal").collect()
    assert [(r.ordinal, r.sql, r.question_id) for r in got] == [(i, f"select {i}", 10 + i) for i in range(5)]
    with pytest.raises(ValueError):
        samples.read_samples(spark, "x", "other")


def odd_records():
    """Strings that hold brackets, quotes and escapes; nested objects and arrays; long and short records."""
    texts = ["", "}", "{", '"', "\\", '\\"}', "[{", "}]", "a\nb", "é 東京", '\\\\"', "},{", '{"a": "}"}', "x" * 5000, "\u2028}", "}" * 50, '"' * 30]
    return [{"i": i, "t": texts[i % len(texts)], "n": {"a": [texts[(i * 7) % len(texts)], {"b": [i, [i]]}], "c": None}} for i in range(700)]


ODD_SCHEMA = "i long, t string, n struct<c:string>"


@pytest.mark.parametrize("indent,size", [(None, 64), (2, 97), (None, 4096), (1, 1 << 27)])
def test_json_array_in_parts(spark, tmp_path, indent, size):
    """Whatever the borders of the splits, rows and places are those of the file."""
    path, want = tmp_path / "a.json", odd_records()
    if size < 100:
        want = want[:40]
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        texts = jsonarray.records(spark, str(path)).orderBy("ordinal").collect()
        assert [r.ordinal for r in texts] == list(range(len(want))) and [json.loads(r.text) for r in texts] == want
        got = jsonarray.read_array(spark, str(path), ODD_SCHEMA).orderBy("ordinal").collect()
        plain = spark.read.schema(ODD_SCHEMA).option("multiLine", True).json(str(path)).collect()
        assert [(r.i, r.t, r.n) for r in got] == [(r.i, r.t, r.n) for r in plain]
        assert size > 100 or spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 40
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_json_array_forms(spark, tmp_path):
    def read(text):
        path = tmp_path / f"f{abs(hash(text))}.json"
        path.write_text(text)
        return [(r.ordinal, json.loads(r.text)) for r in jsonarray.records(spark, str(path)).orderBy("ordinal").collect()]

    assert read("[]") == read("") == read(" [ ] \n") == []
    assert read('{"a": 1}') == [(0, {"a": 1})] and read('[{"a": 1}]') == [(0, {"a": 1})]
    assert read('{"a": {}}\n{"b": [{}]}\n') == [(0, {"a": {}}), (1, {"b": [{}]})]
    for bad in ('[{"a": 1}, 7, {"b": 2}]', '[{"a": 1}, {"b": {"c": 2}', '[{"a": "open}]'):
        with pytest.raises(Exception, match="not an array of objects|ends inside a record"):
            read(bad)
    two = tmp_path / "two"
    two.mkdir()
    for i in range(2):
        (two / f"{i}.json").write_text(json.dumps([{"k": 10 * i + j} for j in range(3)]))
    assert [json.loads(r.text)["k"] for r in jsonarray.records(spark, str(two)).orderBy("ordinal").collect()] == [0, 1, 2, 10, 11, 12]


def test_write_array(spark, tmp_path):
    """One file that json.load reads; a failed job leaves the old one and nothing else."""
    path = str(tmp_path / "out.json")
    df = spark.range(0, 1000, numPartitions=7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('}"{ '), "id")).alias("t"), F.array("id").alias("a"))
    jsonarray.write_array(df, path, [F.col("id").desc()])
    want = [{"id": i, "t": f'}}"{{ {i}' if i % 3 else None, "a": [i]} for i in range(999, -1, -1)]
    with open(path) as f:
        assert json.load(f) == want
    broken = df.withColumn("t", F.when(F.col("id") == 900, F.raise_error(F.lit("killed"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="killed"):
        jsonarray.write_array(broken, path)
    with open(path) as f:
        assert json.load(f) == want
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.json"]
    jsonarray.write_array(df.limit(0), path)
    with open(path) as f:
        assert json.load(f) == []
    back = jsonarray.read_array(spark, path, "id long")
    assert back.isEmpty()


def test_predictions(spark, tmp_path):
    base = samples.read_samples(spark, write_samples(tmp_path), "spider")
    good, short = tmp_path / "a.sql", tmp_path / "b.sql"
    good.write_text("".join(f"select {i} join\n" for i in range(5)))
    short.write_text("select 1\n")
    got = samples.attach_predictions(base, [str(good), str(good)]).orderBy("ordinal").collect()
    assert [r.predicted_sql_list[1].sql for r in got] == [f"select {i} join" for i in range(5)]
    assert got[0].predicted_sql_list[0].difficulty_type == "non-nested"
    with pytest.raises(ValueError):
        samples.attach_predictions(base, [str(short)])


def test_file_order_over_many_parts(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(0, 5000, numPartitions=6).select(F.col("id").cast("string").alias("value")).write.text(path)
    rows = samples.read_predictions(spark, path).collect()
    assert all(int(r.prediction) == r.ordinal for r in rows)


def test_store(spark):
    a = spark.createDataFrame([("1", "x", 0), ("2", "y", 1), ("1", "z", 2)], "id string, v string, place int")
    b = spark.createDataFrame([("2", "w", 0)], "id string, v string, place int")
    store = samples.latest_by_id([a, b])
    assert {(r.id, r.v) for r in store.collect()} == {("1", "z"), ("2", "w")}
    ids = spark.createDataFrame([("1",)], "id string")
    assert samples.lookup(store, ids).first().v == "z"
    with pytest.raises(KeyError):
        samples.lookup(store, spark.createDataFrame([("9",)], "id string"))


def test_ids(spark):
    row = spark.createDataFrame([(None, 7, ""), (3, 8, "k")], "qid long, o long, g string")
    got = row.select(linking.dev_id("bird", F.col("qid"), F.col("o")).alias("d"), linking.train_id("spider", F.col("g"), F.col("o")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("bird_dev_7", "spider_train_id_7"), ("bird_dev_3", "spider_train_id_k")]


def test_sinks(spark, tmp_path):
    bands = spark.createDataFrame(
        [("q", 'd"1', 1, "pos", 0.5), ("q", "d2", 2, "hard", 0.25), ("q", "d3", 3, "hard", 0.125)],
        "query_id string, doc_id string, rank int, band string, score double",
    )
    sinks.write_positives(bands, str(tmp_path / "pos"))
    assert json.loads(spark.read.text(str(tmp_path / "pos")).first().value) == ["q", ['d"1', 0.5]]
    sinks.write_negatives(bands, str(tmp_path / "neg"))
    row = sinks.negative_map(sinks.read_negatives(spark, str(tmp_path / "neg"))).first()
    assert row.difficulty_ids == ["d2", "d3"] and row.difficulty_scores == [0.25, 0.125] and row.easy_ids == []
    with pytest.raises(Exception):
        sinks.read_negatives(spark, str(tmp_path / "none"))
    docs = spark.createDataFrame([("a\nb",), ("c",)], "document string").coalesce(1)
    sinks.write_dump(docs, str(tmp_path / "dump"))
    text = "".join(p.read_text() for p in (tmp_path / "dump").glob("part-*"))
    assert text == "a\nb\n\n\n\n\nc\n\n\n\n\n"


def docs(spark, ids):
    return spark.createDataFrame(
        [(i, f"select {w} from t{i}", ["join"] if w == "a" else []) for i, w in ids], "id string, sql string, difficulty_type array<string>"
    )


def test_collection(spark, tmp_path):
    root, name = str(tmp_path), collection_name("default", "EUCLIDEAN", "SQL", ["s"])
    assert name == "default_EUCLIDEAN_SQL_s"
    held = VectorCollection.create(spark, root, name, fields="SQL")
    with pytest.raises(ValueError):
        held.rows()
    assert held.insert(docs(spark, [("1", "a"), ("2", "b")]), "p1", "one")
    assert not held.insert(docs(spark, [("8", "a")]), "p1", "one")
    assert held.insert(docs(spark, [("2", "changed"), ("3", "c")]), "p2", "two")
    back = VectorCollection.load(spark, root, name)
    assert back.settings["datasets"] == ["one", "two"]
    assert {(r.id, r.document, r.tag_join, r.domain) for r in back.rows().collect()} == {
        ("1", "select a from t1", True, ""), ("2", "select b from t2", False, ""), ("3", "select c from t3", False, ""),
    }
    q = back.rows().select(F.col("id").alias("query_id"), "vec").where("id = '3'")
    found = back.query(q, 2).orderBy("rank").collect()
    assert found[0].doc_id == "3" and found[0].distance == 0 and len(found) == 2
    assert back.query(q, 2, F.col("tag_join")).first().document == "select a from t1"
    VectorCollection.create(spark, root, name, fields="SQL")
    assert VectorCollection.load(spark, root, name).settings["datasets"] == []
    with pytest.raises(FileNotFoundError):
        VectorCollection.load(spark, root, "none")
    for bad in ({"similarity": "L7"}, {"fields": "X"}, {"method": "big"}):
        with pytest.raises(ValueError):
            VectorCollection.create(spark, root, "n", **bad)


def test_stream_ingest(spark, tmp_path):
    schema = "id string, sql string, difficulty_type array<string>"
    arriving = str(tmp_path / "in")
    docs(spark, [("1", "a"), ("2", "b")]).write.mode("append").parquet(arriving)
    held = VectorCollection.create(spark, str(tmp_path / "c"), "n", fields="SQL")
    for step in range(2):
        stream = spark.readStream.schema(schema).parquet(arriving)
        ingest_stream(stream, held, "s", str(tmp_path / "ck")).awaitTermination(120)
        docs(spark, [("2", "later"), ("3", "c")]).write.mode("append").parquet(arriving)
    assert {(r.id, r.document) for r in held.rows().collect()} == {
        ("1", "select a from t1"), ("2", "select b from t2"), ("3", "select c from t3")
    }


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "aa bb"), (2, "aa aa"), (3, "")], "id int, text string")
    vecs = {r.id: r.vec for r in embed.embed(rows, "text").collect()}
    other = embed.embed(spark.createDataFrame([(1, "Über café 日本"), (2, "日本")], "id int, text string"), "text").collect()
    assert sum(x > 0 for x in other[0].vec) == 3 and any(other[1].vec)
    assert len(vecs[1]) == 64 and abs(sum(x * x for x in vecs[1]) - 1) < 1e-9 and not any(vecs[3])
    lengths = embed.batch_encoder(lambda s: s.map(lambda x: [float(len(x))]))
    assert {r.id: r.vec for r in embed.embed(rows, "text", lengths).collect()} == {1: [5.0], 2: [5.0], 3: [0.0]}


def test_formats_raise():
    for fn in (documents.document, documents.query_text, documents.doc_text):
        with pytest.raises(ValueError):
            fn("none")


def test_masking(spark):
    asked = spark.createDataFrame([(1, "Show the Name and grade of Ann"), (2, "Quiet")], "question_id int, question string")
    items = spark.createDataFrame([(1, ["student", "grade name"]), (2, ["x"])], "question_id int, items array<string>")
    tokens = asked.select("question_id", F.posexplode(masking.question_words(F.col("question"))).alias("pos", "token"))
    tokens = tokens.withColumn("tag", F.when(F.col("token").isin("name", "grade", "ann"), F.lit("NOUN")).otherwise(F.lit("X")))
    vocab = masking.vocabulary(items)
    assert [(r.item_idx, r.word, r.token_idx) for r in vocab.where("question_id = 1").orderBy("token_idx").collect()] == [
        (0, "student", 0), (1, "grade", 1), (1, "name", 2),
    ]
    sens = tokens.join(vocab, "question_id").select("question_id", "pos", "token_idx", F.lit(0.5).alias("value"))
    scores = masking.token_scores(tokens, vocab, sens)
    got = {(r.question_id, r.token): r.score for r in scores.collect()}
    assert abs(got[1, "grade"] - (2.5 / 2 + 0.9) / 2) < 1e-12 and abs(got[1, "the"] - 0.5) < 1e-12
    out = {r.question_id: r.skeleton for r in masking.mask_questions(asked, scores).collect()}
    assert out == {1: "Show the Name and [Mask] of [Mask]", 2: "Quiet"}


def mask_tables(spark, twice=1):
    asked = spark.createDataFrame([(1, "one two"), (2, "two three four")] * twice, "question_id int, question string")
    tokens = asked.select("question_id", F.posexplode(masking.question_words(F.col("question"))).alias("pos", "token")).withColumn("tag", F.lit("X"))
    items = spark.createDataFrame([(1, ["two", "a b"]), (2, ["c"])] * twice, "question_id int, items array<string>")
    vocab = masking.vocabulary(items)
    sens = tokens.distinct().join(vocab.distinct(), "question_id").select("question_id", "pos", "token_idx", (F.col("pos") + F.col("token_idx")).cast("double").alias("value"))
    return asked, tokens, vocab, sens


def test_masking_broadcasts_nothing(spark):
    """Item words, scores and chosen words grow with the questions."""
    asked, tokens, vocab, sens = (cut(df) for df in mask_tables(spark))
    scores = masking.token_scores(tokens, vocab, sens)
    for df in (scores, masking.mask_questions(asked, scores)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_masking_of_items_that_come_twice(spark):
    """A word of an item that is listed twice counts twice."""
    once, twice = ({(r.question_id, r.pos): r.score for r in masking.token_scores(tokens.distinct(), vocab, sens).collect()}
                   for _, tokens, vocab, sens in (mask_tables(spark), mask_tables(spark, 2)))
    assert once[1, 0] == round((1 / 3 / 2 + 2 / 3 / 2) / 2 / 2, 12) and once[2, 2] == 0.5
    assert twice[1, 0] == 2 * once[1, 0] and twice[2, 2] == 2 * once[2, 2]


def numbered_samples(spark, ids):
    return spark.createDataFrame([(str(i), f"select {i}", []) for i in ids], "id string, sql string, difficulty_type array<string>")


def test_two_writers(spark, tmp_path, monkeypatch):
    """Both read the same version; the second one's commit fails, and its work is done again on top of the first."""
    root = str(tmp_path)
    VectorCollection.create(spark, root, "n", fields="SQL")
    first, second = (VectorCollection.load(spark, root, "n") for _ in range(2))
    commit, tried = VectorCollection._commit, []

    def late(self, settings):
        if self is second and not tried:
            tried.append(True)
            assert first.insert(numbered_samples(spark, range(10)), "a", "a")
        return commit(self, settings)

    monkeypatch.setattr(VectorCollection, "_commit", late)
    assert second.insert(numbered_samples(spark, range(5, 20)), "b", "b")
    held = VectorCollection.load(spark, root, "n")
    assert held.settings["datasets"] == ["a", "b"] and held.version == 3
    rows = held.rows().collect()
    assert sorted(int(r.id) for r in rows) == list(range(20)) and {r.dataset for r in rows if int(r.id) in range(5, 10)} == {"a"}
    assert not first.insert(numbered_samples(spark, [99]), "b", "b")
    assert len(list((tmp_path / "n" / "data").iterdir())) == 2 and not list((tmp_path / "n" / "waiting").iterdir())


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    VectorCollection.create(spark, root, "n", fields="SQL")

    def write(i):
        return VectorCollection.load(spark, root, "n").insert(numbered_samples(spark, range(4 * i, 4 * i + 8)), f"p{i}", f"d{i}")

    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(write, range(4)))
    held = VectorCollection.load(spark, root, "n")
    assert sorted(held.settings["datasets"]) == ["d0", "d1", "d2", "d3"]
    assert sorted(int(r.id) for r in held.rows().collect()) == list(range(20))
