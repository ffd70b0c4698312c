"""Repair of misspelt table and column names in predicted statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import sqltext

# Fixed values.
MAX_DISTANCE = 3
RESERVED = [
    "select", "from", "where", "group", "by", "order", "limit", "intersect", "union", "except", "join", "on", "as", "not",
    "between", "in", "like", "is", "exists", "max", "min", "count", "sum", "avg", "and", "or", "desc", "asc", "having",
    "distinct", "inner", "left", "right", "full", "outer", "cross", "natural", "using", "all", "case", "when", "then",
    "else", "end", "null", "with", "offset", "cast", "true", "false",
]
NAME = r"[A-Za-z_]\w*"
FUNCTION = rf"({NAME})\s*\("
# After AS, or after the table of FROM and JOIN and of a comma in between.
ALIAS = rf"(?i)\bas\s+({NAME})"
TABLE_ALIAS = rf"(?i)\b(?:from|join)\s+{NAME}\s+({NAME})"
# Literals stay whole.
PIECES = r"'[^']*'|\"[^\"]*\"|\w+|[^\w'\"]+|['\"]"


def declared(sql: Column) -> Column:
    """Lower-case names of the functions and the aliases of a statement."""
    text = sqltext.without_literals(sqltext.single_quotes(sql))
    lists = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (FUNCTION, ALIAS, TABLE_ALIAS)]
    return F.transform(F.array_distinct(F.concat(*lists)), F.lower)


def identifiers(sql: Column, others: Column) -> Column:
    """Distinct names of tables and columns in a statement: words outside literals that are no
    key words and none of `others`."""
    text = sqltext.without_literals(sqltext.single_quotes(sql))
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))
    return F.filter(names, lambda n: ~F.lower(n).isin(*RESERVED) & ~F.array_contains(others, F.lower(n)))


def renames(unknown: Column, names: Column, nearest: bool = False) -> Column:
    """Map from unknown names to names of the catalog (an array in catalog order).

    Among names within distance 3 the last one wins, or with `nearest` the closest. Names with none
    so near have no entry."""
    def best(word: Column) -> Column:
        near = F.filter(
            F.transform(names, lambda n, i: F.struct(F.levenshtein(word, n, MAX_DISTANCE).alias("distance"), i.alias("pos"), n.alias("name"))),
            lambda c: c["distance"] >= 0,
        )
        order = F.transform(near, lambda c: F.struct((-c["distance"] if nearest else F.lit(0)).alias("closeness"), c["pos"].alias("pos"), c["name"].alias("name")))
        return F.array_max(order)["name"]

    pairs = F.transform(unknown, lambda w: F.struct(w.alias("key"), best(w).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def repair(log: DataFrame, names: DataFrame, sql: str = "sql", nearest: bool = False) -> DataFrame:
    """`log` with column `repaired`: words that are no name of their database become the name
    that `renames` finds, all at once. names: db_id, pos, name.

    Row-local but for one join with the list of names of a database; only names that the list does not
    hold are measured against it. Statements of unknown databases stay as they are."""
    lists = names.groupBy("db_id").agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("_n"))
    lists = lists.select("db_id", F.transform("_n", lambda n: n["name"]).alias("_names"))
    # As output of a generator, a list is computed once a row and not once for each use.
    rows = log.join(lists, "db_id", "left").select("*", F.explode(F.array(F.coalesce(declared(F.col(sql)), F.array()))).alias("_others"))
    unknown = F.array_except(identifiers(F.col(sql), F.col("_others")), F.coalesce("_names", F.array()))
    rows = rows.select("*", F.explode(F.array(F.coalesce(unknown, F.array()))).alias("_unknown"))
    changes = F.when(F.col("_names").isNotNull() & (F.size("_unknown") > 0), renames(F.col("_unknown"), F.col("_names"), nearest))
    rows = rows.select("*", F.explode(F.array(changes)).alias("_changes"))
    pieces = F.regexp_extract_all(sql, F.lit(PIECES), F.lit(0))
    renamed = F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at("_changes", t), t)), "")
    repaired = F.when(F.coalesce(F.cardinality("_changes"), F.lit(0)) > 0, renamed).otherwise(F.col(sql))
    return rows.withColumn("repaired", repaired).select(*log.columns, "repaired")
