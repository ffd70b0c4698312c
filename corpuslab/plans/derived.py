"""Corpora derived from the given tables: a query log from the orders and one small
database per customer. Each comes as a DataFrame and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.plans.registry import Tables


def query_log(t: Tables) -> DataFrame:
    """One statement per order (log_id, db_id, sql), six forms in turn."""
    price = F.floor("o_totalprice").cast("bigint").cast("string")
    form = F.col("o_orderkey") % 6
    text = (
        F.when(form == 0, F.concat(
            F.lit("SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey"
                  " WHERE T2.o_totalprice > "), price, F.lit(";")))
        .when(form == 1, F.concat(
            F.lit('SELECT count(*) FROM orders WHERE o_orderpriority = "'), F.col("o_orderpriority"), F.lit('"')))
        .when(form == 2, F.concat(
            F.lit("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer"
                  " WHERE c_acctbal > "), F.col("o_custkey").cast("string"), F.lit(")")))
        .when(form == 3, F.lit("SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer"))
        .when(form == 4, F.concat(
            F.lit("SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT "),
            (F.col("o_orderkey") % 10 + 1).cast("string")))
        .otherwise(F.concat(
            F.lit("SELECT o_orderkey , o_custkey FROM orders WHERE o_orderstatus = '"), F.col("o_orderstatus"),
            F.lit("' AND o_totalprice <= "), price))
    )
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return t.wide("orders", *columns).select(
        F.col("o_orderkey").alias("log_id"),
        F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("db_id"),
        text.alias("sql"),
    )


QUERY_LOG = """
qlog AS (SELECT o_orderkey AS log_id, 'db' || o_custkey AS db_id, CASE o_orderkey % 6
  WHEN 0 THEN 'SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_totalprice > ' || CAST(floor(o_totalprice) AS BIGINT) || ';'
  WHEN 1 THEN 'SELECT count(*) FROM orders WHERE o_orderpriority = "' || o_orderpriority || '"'
  WHEN 2 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > ' || o_custkey || ')'
  WHEN 3 THEN 'SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer'
  WHEN 4 THEN 'SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT ' || (o_orderkey % 10 + 1)
  ELSE 'SELECT o_orderkey , o_custkey FROM orders WHERE o_orderstatus = ''' || o_orderstatus || ''' AND o_totalprice <= ' || CAST(floor(o_totalprice) AS BIGINT)
  END AS sql FROM orders)"""

# Normal form of the log by the general rules: quotes, token blanks, case outside
# literals, sort direction, aliases.
NORMAL_LOG = QUERY_LOG + r""",
spaced AS (SELECT *, array_to_string(regexp_extract_all(
    replace(regexp_replace(trim(sql), ';$', ''), '"', ''''),
    '''[^'']*''|\w+(?:\.\w+)?|<>|<=|>=|!=|[^\s\w]'), ' ') AS s1 FROM qlog),
cased AS (SELECT *, array_to_string([CASE WHEN i % 2 = 1 THEN lower(string_split(s1, '''')[i]) ELSE string_split(s1, '''')[i] END
    FOR i IN range(1, len(string_split(s1, '''')) + 1)], '''') AS s2 FROM spaced),
sorted AS (SELECT *, CASE WHEN s2 LIKE '%order by%' AND NOT regexp_matches(s2, '\b(asc|desc)\b')
    THEN regexp_replace(s2, 'order by (\w+(?:\.\w+)?)', 'order by \1 asc', 'g') ELSE s2 END AS s3 FROM cased),
unaliased AS (SELECT *, regexp_extract(s3, '(?:from|join) (\w+) as t1\b', 1) AS a1,
    regexp_extract(s3, '(?:from|join) (\w+) as t2\b', 1) AS a2,
    regexp_replace(regexp_replace(s3, '\bas t1 ', '', 'g'), '\bas t2 ', '', 'g') AS s4 FROM sorted),
norm AS (SELECT log_id, db_id, sql, CASE WHEN a1 = '' THEN s3
    ELSE regexp_replace(regexp_replace(s4, '\bt1\b', a1, 'g'), '\bt2\b', a2, 'g') END AS norm_sql FROM unaliased)"""


def raw_catalog(t: Tables) -> DataFrame:
    """One database per customer: two fixed tables and a third that depends on the
    customer's segment and nation, with 1 to 3 columns beyond its key."""
    segment = F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 20)))
    fixed = [
        ("-1", "*", "*", "text"),
        ("0", "C_CustKey", "Customer Key", "number"),
        ("0", "C_Name", "Customer Name", "text"),
        ("0", "C_AcctBal", "Account Balance", "number"),
        ("1", "O_OrderKey", "Order Key", "number"),
        ("1", "O_CustKey", "Customer Key", "number"),
        ("1", "O_TotalPrice", "Total Price", "number"),
        ("1", "O_OrderStatus", "Order Status", "text"),
        ("1", "O_OrderPriority", "Order Priority", "text"),
    ]
    extra = F.sequence(F.lit(1), F.col("c_nationkey") % 3 + 2)

    def column(position: int, prefix: str):
        head = F.array(*[F.array(F.lit(row[0]), F.lit(row[position])) for row in fixed])
        tail = F.transform(
            extra, lambda i: F.array(F.lit("2"), F.concat(segment, F.lit(prefix), i.cast("string")))
        )
        return F.concat(head, tail)

    return t.wide("customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.concat(F.lit("db"), F.col("c_custkey").cast("string")).alias("db_id"),
        F.array(F.lit("Customer"), F.lit("Orders"), segment).alias("table_names_original"),
        F.array(F.lit("Customer Data"), F.lit("Order Data"), segment).alias("table_names"),
        column(1, "_Col").alias("column_names_original"),
        column(2, " Column ").alias("column_names"),
        F.concat(
            F.array(*[F.lit(row[3]) for row in fixed]), F.transform(extra, lambda i: F.lit("number"))
        ).alias("column_types"),
        F.array(F.array(F.lit(1)), F.array(F.lit(4)), F.array(F.lit(9), F.lit(10))).alias("primary_keys"),
        F.array(F.array(F.lit(5), F.lit(1)), F.array(F.lit(9), F.lit(1))).alias("foreign_keys"),
    )


# The same databases, one row per column, by position in the catalog.
CATALOG = """
seg AS (SELECT 'db' || c_custkey AS db_id, lower(c_mktsegment) AS seg, c_nationkey % 3 + 2 AS n_extra FROM customer),
fixed(column_idx, table_idx, table_name_original, table_name, column_name_original, column_name, column_type) AS (VALUES
 (1,0,'customer','customer data','c_custkey','customer key','number'),
 (2,0,'customer','customer data','c_name','customer name','text'),
 (3,0,'customer','customer data','c_acctbal','account balance','number'),
 (4,1,'orders','order data','o_orderkey','order key','number'),
 (5,1,'orders','order data','o_custkey','customer key','number'),
 (6,1,'orders','order data','o_totalprice','total price','number'),
 (7,1,'orders','order data','o_orderstatus','order status','text'),
 (8,1,'orders','order data','o_orderpriority','order priority','text')),
cat AS (SELECT db_id, CAST(column_idx AS BIGINT) AS column_idx, CAST(table_idx AS BIGINT) AS table_idx, table_name_original, table_name,
   column_name_original, column_name, column_type FROM seg, fixed
 UNION ALL SELECT db_id, 8 + i, 2, seg, seg, seg || '_col' || i, seg || ' column ' || i, 'number'
   FROM (SELECT *, unnest(range(1, n_extra + 1)) AS i FROM seg))"""
