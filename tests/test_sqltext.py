import pytest
from pyspark.sql import functions as F

from corpuslab.functions import sqltext as st
from corpuslab.operators import querylog


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "s string").select(fn(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT a FROM t;", "select a from t"),
        ("SELECT count(*) FROM t WHERE a=\"X y\"", "select count ( * ) from t where a = 'X y'"),
        ("select a from t order by b", "select a from t order by b asc"),
        ("select a from t order by max(b) limit 3", "select a from t order by max ( b ) asc limit 3"),
        ("select a from t order by b desc", "select a from t order by b desc"),
        # A name that only contains `desc` does not count as a direction.
        ("select description from t order by b", "select description from t order by b asc"),
        ("SELECT T1.a FROM x AS T1 JOIN y AS T2 ON T1.i = T2.i", "select x.a from x join y on x.i = y.i"),
        # t1 is a whole word: t10 and names containing t1 stay.
        ("select t1.a , t10.b , art1 from x as t1 join y as t10 on t1.i = t10.i", "select x.a , y.b , art1 from x join y on x.i = y.i"),
        ("select a from t where b >= -1.5", "select a from t where b >= -1.5"),
        ("  select a\n from t ;", "select a from t"),
    ],
)
def test_normalize(spark, text, expected):
    assert one(spark, text, st.normalize) == expected


def test_case_is_kept_inside_quotes(spark):
    assert one(spark, "SELECT 'It IS' FROM T", st.lower_outside_quotes) == "select 'It IS' from t"


@pytest.mark.parametrize(
    "masked, expected",
    [
        ("select _ , _ , _ from _ where _ = _ and _ > _ or _ <= _", "select _ from _ where _"),
        ("select _ from _ join _ on _ = _ join _ on _ = _ and _ = _ where _ = _", "select _ from _ where _"),
        ("select _ from _ where _ in ( select _ from _ )", "select _ from _ where _ in ( select _ from _ )"),
    ],
)
def test_collapse(spark, masked, expected):
    assert one(spark, masked, st.collapse_skeleton) == expected


@pytest.mark.parametrize(
    "text, tags, kind, parts",
    [
        ("select * from (select * from table1) t1 union select * from table2", ["nested"], "nested", ["select * from table1"]),
        ("select * from table1 inner join table2 on table1.id = table2.id", ["join"], "non-nested", []),
        (
            "select * from users where id in (\n select user_id from orders where order_date > '2022-01-01'\n)"
            " and exists (\n select 1 from products where products.id = users.favorite_product_id\n)",
            ["nested"], "nested",
            [
                "select user_id from orders where order_date > '2022-01-01'",
                "select 1 from products where products.id = users.favorite_product_id",
            ],
        ),
        ("select a from t where b in (select c from (select d from e))", ["nested"], "nested", ["select c from (select d from e)"]),
        ("select max(a) from t where b = '(select union'", [], "easy", []),
        ("select f((select a from b), g(1)) from t", ["nested"], "nested", ["select a from b"]),
        ("select a from t where b in (select c from d where e = ')')", ["nested"], "nested", ["select c from d where e = ')'"]),
    ],
)
def test_tags_and_subqueries(spark, text, tags, kind, parts):
    assert one(spark, text, st.tag_list) == tags
    assert one(spark, text, st.type_class) == kind
    assert one(spark, text, st.subqueries) == parts


def test_strict_join(spark):
    assert one(spark, "select join_date from t", st.has_join)
    assert not one(spark, "select join_date from t", lambda c: st.has_join(c, strict=True))


@pytest.mark.parametrize(
    "counts, level",
    [((1, 0, 0), "easy"), ((2, 0, 1), "medium"), ((3, 0, 2), "hard"), ((1, 1, 0), "hard"), ((3, 0, 3), "extra")],
)
def test_hardness(spark, counts, level):
    row = spark.createDataFrame([counts], "a int, b int, c int")
    assert row.select(st.hardness(F.col("a"), F.col("b"), F.col("c")).alias("h")).first().h == level


def test_fingerprints(spark):
    log = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "c")], "sql_skeleton string, norm_sql string")
    rows = {r.sql_skeleton: tuple(r)[1:] for r in querylog.fingerprint_counts(log).collect()}
    assert rows == {"s": (3, 2, "a"), "t": (1, 1, "c")}


STRUCTURES = [
    ("select a from t", (0, 0, 0)),
    ("select a , b from t", (0, 0, 1)),
    ("select count ( * ) from t", (0, 0, 0)),
    ("select count ( * ) , max ( a ) from t", (0, 0, 2)),
    ("select a from t where b = 1", (1, 0, 0)),
    ("select a from t where b = 1 and c = 2", (1, 0, 1)),
    ("select a from t where b = 1 or c = 2", (2, 0, 1)),
    ("select a from t where b between 1 and 2", (1, 0, 0)),
    ("select a from t where b between 1 and 2 and c like 'x%'", (2, 0, 1)),
    ("select a from t where b = 'where x or y like z'", (1, 0, 0)),
    ("select a from t group by a", (1, 0, 0)),
    ("select a , b from t group by a , b", (1, 0, 2)),
    ("select a from t group by a having count ( * ) > 3", (1, 0, 0)),
    ("select a , count ( * ) from t group by a having count ( * ) > 3", (1, 0, 2)),
    ("select a from t order by b asc", (1, 0, 0)),
    ("select a from t order by b desc limit 3", (2, 0, 0)),
    ("select a from t order by count ( * ) desc limit 1", (2, 0, 0)),
    ("select t.a from t join u on t.i = u.i", (1, 0, 0)),
    ("select t.a from t join u on t.i = u.i join v on v.i = u.i where v.x > 1", (3, 0, 0)),
    ("select t.a from t , u where t.i = u.i", (2, 0, 0)),
    ("select a from t where b in ( select c from u )", (1, 1, 0)),
    ("select a from t where b in ( select c from u where d = 1 or e = 2 )", (1, 1, 0)),
    ("select a from t where b in ( select c from u where d in ( select e from v ) )", (1, 1, 0)),
    ("select a from t where b > ( select avg ( b ) from t ) and c not in ( select d from u )", (1, 2, 1)),
    ("select a from ( select b from u where c = 1 ) where a = 2", (1, 0, 0)),
    ("select a from ( select b from u ) join ( select c from v ) on b = c", (1, 0, 0)),
    ("select a from t union select b from u", (0, 1, 0)),
    ("select a from t where x = 1 intersect select a from t where x = 2", (1, 1, 0)),
    ("select a from t except select b from u where c like 'q' or d = 1", (0, 1, 0)),
    ("select a from t union select b from u union select c from v", (0, 1, 0)),
    ("select a from t group by a having max ( b ) > ( select min ( c ) from u )", (1, 1, 0)),
    ("select max ( a ) , min ( b ) , c from t where d like 'x' or e like 'y' group by c , d order by c asc limit 2", (7, 0, 4)),
]


def test_structure_counts(spark):
    """Counted by hand."""
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STRUCTURES)], "i int, s string")
    got = {r.i: (r.a, r.b, r.c) for r in rows.select("i", *[c.alias(n) for n, c in zip("abc", querylog.structure_counts(F.col("s")))]).collect()}
    for i, (statement, want) in enumerate(STRUCTURES):
        assert got[i] == want, statement
