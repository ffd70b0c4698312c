"""Jobs over a query log: fingerprint groups, tag totals, sub-query rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import sqltext
from corpuslab.operators import catalog as cat
from corpuslab.operators.linking import attach_catalog


def normalized(log: DataFrame, sql: str = "sql") -> DataFrame:
    return log.withColumn("norm_sql", sqltext.normalize(F.col(sql)))


def with_skeleton(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Skeleton of each statement under the names of its own database."""
    names = catalog.select("db_id", cat.maskable_names(F.col("db_schema")).alias("_names"))
    return (
        attach_catalog(log, names)
        .withColumn("sql_skeleton", sqltext.skeleton(F.col("norm_sql"), F.col("_names")))
        .drop("_names")
    )


def fingerprint_counts(log: DataFrame) -> DataFrame:
    """Statements per skeleton, distinct variants and a sample.

    Grouping first by (skeleton, statement) keeps the distinct count free of
    per-group sets: both steps combine on the map side, so a hot skeleton is spread
    over its statements.
    """
    variants = log.groupBy("sql_skeleton", "norm_sql").agg(F.count("*").alias("n"))
    return variants.groupBy("sql_skeleton").agg(
        F.sum("n").alias("n_statements"),
        F.count("*").alias("n_variants"),
        F.min("norm_sql").alias("sample"),
    )


def subquery_rows(log: DataFrame, key: str = "log_id") -> DataFrame:
    return log.select(key, F.posexplode(sqltext.subqueries(F.col("norm_sql"))).alias("pos", "subquery"))


def tag_totals(log: DataFrame, tags: str = "tags") -> DataFrame:
    """Count and share per tag and per tag combination."""
    total = F.sum("n").over(_everything())
    pairs = log.groupBy(F.array_join(tags, "+").alias("tag")).agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("share", F.col("n") / total).withColumn("level", F.lit("combination"))
    single = (
        pairs.select(F.explode(F.split("tag", r"\+")).alias("tag"), "n", "share")
        .where("tag <> ''")
        .groupBy("tag")
        .agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
        .withColumn("level", F.lit("tag"))
    )
    return pairs.unionByName(single)


def _everything():
    from pyspark.sql import Window

    # Only ever used on the handful of aggregated tag combinations.
    return Window.partitionBy(F.lit(0))


def hardness_counts(sql: Column) -> tuple[Column, Column, Column]:
    """Three component counts taken from the text of a normalised statement: clauses
    (where, group, order, limit, join, or, like), nested parts, further items."""
    text = sqltext.without_literals(sql)
    clauses = F.regexp_count(text, F.lit(r"\b(where|group by|order by|limit|join|or|like)\b"))
    nested = F.regexp_count(text, F.lit(r"\(\s*select\b|\b(union|intersect|except)\b"))
    aggregates = F.regexp_count(text, F.lit(r"\b(max|min|count|sum|avg) \("))
    conditions = F.regexp_count(text, F.lit(r"\band\b"))
    further = (aggregates > 1).cast("int") + (conditions > 0).cast("int")
    return clauses, nested, further


# The clauses of a select in their order, and the words that join two arms.
CLAUSES = ["select", "from", "where", "group by", "having", "order by", "limit"]
ARMS = r" (?:union all|union|intersect|except) "


def clauses_of(sql: Column) -> dict[str, Column]:
    """The clauses of the outermost select of a normalised statement (tokens a blank apart), as texts
    with a blank at each end; null where the statement has none. Sub-queries read `( ? )`, literals `''`; `arms` is the number of
    selects that set operations join.

    The statement is folded by depth once (`sqltext.subqueries`), so what is left holds the outer level only."""
    plain = sqltext.without_literals(F.lower(sql))
    outer = F.aggregate(sqltext.subqueries(plain), plain, lambda text, part: F.replace(text, part, F.lit("?")))
    arms = F.split(F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(outer, r"[(),;]", " $0 "), r"\s+", " "), F.lit(" ")), ARMS)
    first = F.get(arms, F.lit(0))
    out = {"arms": F.size(arms)}
    for i, name in enumerate(CLAUSES):
        behind = "|".join([f" {n} " for n in CLAUSES[i + 1 :]] + ["$"])
        text = F.regexp_extract(first, rf" {name} (.*?)(?:{behind})", 1)
        out[name] = F.when(first.contains(f" {name} "), F.concat(F.lit(" "), text, F.lit(" ")))
    return out


def _flat(text: Column) -> Column:
    """Without what stands in parentheses, three deep."""
    for _ in range(3):
        text = F.regexp_replace(text, r"\([^()]*\)", "")
    return text


def structure_counts(sql: Column) -> tuple[Column, Column, Column]:
    """Three component counts of a normalised statement, from its clauses.

    clauses   where, group by, order by and limit, the tables beyond the first, each `or`, each `like`
    nested    sub-queries in conditions, and one for a set operation
    further   of more than one aggregate, selected item, condition, and grouping item: how many hold"""
    parts = clauses_of(sql)

    def count(names: list[str], pattern: str) -> Column:
        return sum((F.coalesce(F.regexp_count(parts[n], F.lit(pattern)), F.lit(0)) for n in names[1:]), F.coalesce(F.regexp_count(parts[names[0]], F.lit(pattern)), F.lit(0)))

    def there(name: str) -> Column:
        return parts[name].isNotNull().cast("int")

    tables = F.coalesce(F.regexp_count(_flat(parts["from"]), F.lit(r"\bjoin\b|,")), F.lit(0))
    clauses = sum((there(n) for n in ("group by", "order by", "limit")), there("where")) + tables + count(["from", "where", "having"], r"\b(?:or|like)\b")
    # A sub-query behind from, join or a comma is a table.
    as_tables = F.coalesce(F.regexp_count(F.concat(F.lit(" ,"), parts["from"]), F.lit(r"(?:,|\bjoin) \( \? \)")), F.lit(0))
    nested = count(["from", "where", "having"], r"\( \? \)") - as_tables + (parts["arms"] > 1).cast("int")
    aggregates = count(["select", "where", "group by", "having", "order by"], r"\b(?:max|min|count|sum|avg) \(")
    # The `and` of a between joins no two conditions.
    conditions = F.coalesce(F.regexp_count(F.regexp_replace(parts["where"], r"\bbetween \S+ and\b", "between"), F.lit(r"\b(?:and|or)\b")), F.lit(0))
    items = {n: F.coalesce(F.regexp_count(_flat(parts[n]), F.lit(",")), F.lit(0)) for n in ("select", "group by")}
    further = (aggregates > 1).cast("int") + (items["select"] > 0).cast("int") + (conditions > 0).cast("int") + (items["group by"] > 0).cast("int")
    return clauses, nested, further
