import json

from pyspark.sql import functions as F

from corpuslab.operators import catalog as cat
from corpuslab.operators import linking
from corpuslab.sources import samples

RAW = {
    "db_id": "d",
    "table_names_original": ["A", "B"],
    "table_names": ["table a", "table b"],
    "column_names_original": [[-1, "*"], [0, "X"], [0, "Y"], [1, "Z"]],
    "column_names": [[-1, "*"], [0, "x name"], [0, "y"], [1, "z"]],
    "column_types": ["text", "number", "text", "number"],
    "primary_keys": [1, [2, 1]],
    "foreign_keys": [[3, 1]],
}


def raw(spark, tmp_path):
    path = tmp_path / "tables.json"
    path.write_text(json.dumps([RAW], indent=1))
    return samples.read_catalogs(spark, str(path))


def test_read_and_reshape(spark, tmp_path):
    r = raw(spark, tmp_path)
    flat = cat.catalog_columns(r).orderBy("column_idx").collect()
    assert [(c.table_name_original, c.column_name_original, c.column_type) for c in flat] == [
        ("a", "x", "number"), ("a", "y", "text"), ("b", "z", "number"),
    ]
    keys = cat.catalog_primary_keys(r).orderBy("key_idx").collect()
    assert [(k.table_name_original, k.column_name_original) for k in keys] == [("a", ["x"]), ("a", ["y", "x"])]
    fk = cat.catalog_foreign_keys(r).first()
    assert tuple(fk)[2:] == ("b", "z", "a", "x")


def test_texts(spark, tmp_path):
    n = cat.nested_catalog(raw(spark, tmp_path))
    s = F.col("db_schema")
    row = n.select(
        cat.schema_text(cat.table_columns(s)).alias("text"), cat.dotted_text(cat.table_columns(s)).alias("dotted"),
        cat.flat_list(s).alias("flat"), cat.column_descriptions(s, F.col("fk")).alias("d"),
        cat.column_descriptions(s, F.col("fk"), mark_keys=False).alias("plain"),
    ).first()
    assert row.text == "Table a, columns = [x,y]\nTable b, columns = [z]"
    assert row.dotted == "a.x,a.y,b.z"
    assert row.flat == ["a", "x", "y", "b", "z"]
    assert row.d == [["x name ( [FK] ) ", "y"], ["z ( [FK] ) "]]
    assert row.plain == [["x name", "y"], ["z"]]


def test_description_with_values(spark, tmp_path):
    n = cat.nested_catalog(raw(spark, tmp_path))
    filled = F.transform("db_schema", lambda t: t.withField("db_contents", F.array(F.array(F.lit("v1"), F.lit("v2")))))
    d = n.withColumn("db_schema", filled).select(cat.column_descriptions(F.col("db_schema"), F.col("fk")).alias("d")).first().d
    assert d[0] == ["x name ( v1 , v2 , [FK] ) ", "y"]


def test_labels_and_links(spark, tmp_path):
    n = cat.nested_catalog(raw(spark, tmp_path))
    log = spark.createDataFrame([(1, "d", "select x , a.y from a where q = 1")], "log_id int, db_id string, norm_sql string")
    row = linking.linked(log, n).first()
    assert row.table_labels == [1, 0]
    assert row.column_labels == [[1, 1], [0]]
    assert row.schema_links == ["a.x", "a.y", "a"]


def test_prepared_schema_round_trip(spark, tmp_path):
    n = cat.nested_catalog(raw(spark, tmp_path))
    rows = spark.createDataFrame(
        [("1", "What’s x ", None, "d", "SELECT x FROM A;", "SELECT y FROM A")],
        "id string, question string, evidence string, db_id string, sql string, second string",
    )
    done = linking.prepare(rows, n, alternative="second")
    path = str(tmp_path / "prepared")
    done.write.json(path)
    back = samples.read_prepared(spark, path).first()
    assert (back.question, back.norm_sql, back.natsql, back.sql_skeleton) == ("What's x", "select x from a", "SELECT y FROM A", "select _ from _")
    assert back.db_schema[0].column_names_original == ["x", "y"] and back.pk[1].column_name_original == ["y", "x"]
    test = linking.prepare(rows, n, mode="test", alternative="second").first()
    assert (test.sql, test.norm_sql, test.sql_skeleton, test.natsql, test.schema_links) == ("", "", "", "", [])


def test_contents_attached_by_position(spark):
    schema = f"id string, db_schema array<{samples.TABLE_DDL}>, fk array<{samples.FK_DDL}>"
    tables = [("t", "t", ["A", "B"], ["a", "b"], ["text", "text"], []), ("u", "u", ["A"], ["a"], ["text"], [])]
    rows = spark.createDataFrame([("1", tables, [("t", "b", "u", "a")]), ("2", tables, []), ("3", [], [])], schema)
    found = spark.createDataFrame(
        [("1", "T", "B", ["x", "y"]), ("1", "u", "a", ["z"]), ("1", "u", "gone", ["w"]), ("2", "t", "a", None), ("9", "t", "a", ["q"])],
        "id string, table_name string, column_name string, contents array<string>",
    )
    out = {r.id: r for r in cat.with_contents(rows, found).withColumn("d", cat.column_descriptions(F.col("db_schema"), F.col("fk"))).collect()}
    assert len(out) == 3 and out["1"].db_schema[0].db_contents == [[], ["x", "y"]] and out["2"].db_schema[0].db_contents == [[], []]
    assert out["1"].d == [["A", "B ( x , y , [FK] ) "], ["A ( z , [FK] ) "]] and out["2"].d == [["A", "B"], ["A"]] and out["3"].db_schema == []


def test_catalog_is_not_broadcast(spark):
    """However small the file behind it: what tasks hold does not grow with all databases."""
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "db_id string, n int")
    names = spark.createDataFrame([("a", ["x"]), ("c", ["y"]), (None, ["z"])], "db_id string, names array<string>")
    joined = linking.attach_catalog(rows, names)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in joined.collect()] == [("a", 1, ["x"])]
