"""Registered queries over the derived query log and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import sqltext
from corpuslab.operators import catalog as cat
from corpuslab.operators import linking, querylog
from corpuslab.plans.derived import CATALOG, NORMAL_LOG, QUERY_LOG, query_log, raw_catalog
from corpuslab.plans.registry import Tables, query


def norm_log(t: Tables) -> DataFrame:
    return querylog.normalized(query_log(t))


def nested(t: Tables) -> DataFrame:
    return cat.nested_catalog(raw_catalog(t))


@query(
    """SELECT doc_id, trim(replace(replace(replace(replace(replace(text, 'th', '“th”'), '‘', ''''), '’', ''''), '“', ''''), '”', ''''), chr(32) || chr(10)) AS question
    FROM documents"""
)
def straight_quotes(t: Tables) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit("th"), F.lit("“th”"))
    return t.wide("documents", "doc_id", "text").select("doc_id", sqltext.straighten_quotes(marked).alias("question"))


@query(f"WITH {NORMAL_LOG} SELECT log_id, db_id, norm_sql FROM norm")
def log_normalise(t: Tables) -> DataFrame:
    return norm_log(t).select("log_id", "db_id", "norm_sql")


SKELETON = (
    NORMAL_LOG
    + r""",
masked AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(norm_sql, '''[^'']*''', '_', 'g'),
  '\b(customer|orders)(\.\w+)?|\b[co]_\w+|\*', '_', 'g'), '(^| )-?\d+(\.\d+)?( |$)', '\1_\3', 'g') AS m FROM norm),
skel AS (SELECT log_id, db_id, norm_sql, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(m, ' on _ = _', ''),
  '_ (join _ ?)+', '_ ', 'g'), '_( , _)+', '_', 'g'), '_ (=|!=|>|>=|<|<=) _', '_', 'g'),
  'where _( (and|or) _)+', 'where _', 'g') AS sql_skeleton FROM masked)"""
)


@query(f"WITH {SKELETON} SELECT log_id, sql_skeleton FROM skel")
def log_skeleton(t: Tables) -> DataFrame:
    return querylog.with_skeleton(norm_log(t), nested(t)).select("log_id", "sql_skeleton")


@query(
    f"""WITH {SKELETON} SELECT sql_skeleton, count(*) AS n_statements, count(DISTINCT norm_sql) AS n_variants,
    min(norm_sql) AS sample FROM skel GROUP BY sql_skeleton"""
)
def log_fingerprint_counts(t: Tables) -> DataFrame:
    return querylog.fingerprint_counts(querylog.with_skeleton(norm_log(t), nested(t)))


@query(
    f"""WITH {NORMAL_LOG}, tok AS (SELECT log_id, list_filter(regexp_split_to_array(norm_sql, '\\s+'), lambda x: x <> '') AS w FROM norm)
    SELECT log_id, CAST(len(w) AS BIGINT) AS n_tokens,
      array_to_string(list_filter(w, lambda x: contains(x, '.') AND x <> '@.@'), ' ') AS used_columns,
      array_to_string(flatten(list_transform(w, lambda x: string_split(x, '.'))), ' ') AS split_tokens FROM tok"""
)
def log_tokens(t: Tables) -> DataFrame:
    tokens = norm_log(t).select("log_id", sqltext.blank_tokens(F.col("norm_sql")).alias("w"))
    return tokens.select(
        "log_id",
        F.size("w").cast("bigint").alias("n_tokens"),
        F.array_join(sqltext.dotted_columns(F.col("w")), " ").alias("used_columns"),
        F.array_join(sqltext.split_dotted(F.col("w")), " ").alias("split_tokens"),
    )


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) AS token FROM documents)
    SELECT d.doc_id, count(token) AS n_tokens, CAST(sum(CASE WHEN regexp_full_match(token, '-?[0-9]+(\\.[0-9]+)?') THEN 1 ELSE 0 END) AS BIGINT) AS n_numbers
    FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def numeric_tokens(t: Tables) -> DataFrame:
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \n]+"), F.lit(0))
    return t.wide("documents", "doc_id", "text").select(
        "doc_id",
        F.size(tokens).cast("bigint").alias("n_tokens"),
        F.size(F.filter(tokens, sqltext.is_number_token)).cast("bigint").alias("n_numbers"),
    )


TAGS = (
    NORMAL_LOG
    + r""",
tagged AS (SELECT log_id, norm_sql, contains(norm_sql, 'join') AS has_join,
  regexp_matches(regexp_replace(norm_sql, '''[^'']*''', '''''', 'g'), '\b(union|intersect|except)\b') AS has_set_operation,
  regexp_matches(regexp_replace(norm_sql, '''[^'']*''', '''''', 'g'), '\(\s*select\b') AS has_subquery FROM norm)"""
)


@query(
    f"""WITH {TAGS} SELECT log_id, has_join, has_set_operation, has_subquery,
    CASE WHEN has_join AND (has_set_operation OR has_subquery) THEN 'join,nested' WHEN has_join THEN 'join'
         WHEN has_set_operation OR has_subquery THEN 'nested' ELSE '' END AS tags,
    CASE WHEN has_join THEN 'non-nested' WHEN has_set_operation OR has_subquery THEN 'nested' ELSE 'easy' END AS type_class
    FROM tagged"""
)
def log_tags(t: Tables) -> DataFrame:
    sql = F.col("norm_sql")
    return norm_log(t).select(
        "log_id",
        sqltext.has_join(sql).alias("has_join"),
        sqltext.has_set_operation(sql).alias("has_set_operation"),
        sqltext.has_subquery(sql).alias("has_subquery"),
        F.array_join(sqltext.tag_list(sql), ",").alias("tags"),
        sqltext.type_class(sql).alias("type_class"),
    )


@query(
    f"""WITH {NORMAL_LOG} SELECT log_id, CAST(0 AS BIGINT) AS pos, trim(regexp_extract(norm_sql, '\\(\\s*(select[^()]*)\\)', 1)) AS subquery
    FROM norm WHERE regexp_matches(norm_sql, '\\(\\s*select\\b')"""
)
def log_subqueries(t: Tables) -> DataFrame:
    return querylog.subquery_rows(norm_log(t)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"""WITH {NORMAL_LOG}, plain AS (SELECT log_id, regexp_replace(norm_sql, '''[^'']*''', '''''', 'g') AS s FROM norm),
    c AS (SELECT log_id, len(regexp_extract_all(s, '\\b(where|group by|order by|limit|join|or|like)\\b')) AS comp1,
      len(regexp_extract_all(s, '\\(\\s*select\\b|\\b(union|intersect|except)\\b')) AS comp2,
      CAST(len(regexp_extract_all(s, '\\b(max|min|count|sum|avg) \\(')) > 1 AS BIGINT)
        + CAST(len(regexp_extract_all(s, '\\band\\b')) > 0 AS BIGINT) AS others FROM plain)
    SELECT log_id, CAST(comp1 AS BIGINT) AS comp1, CAST(comp2 AS BIGINT) AS comp2, CAST(others AS BIGINT) AS others,
      CASE WHEN comp1 <= 1 AND others = 0 AND comp2 = 0 THEN 'easy'
        WHEN comp2 = 0 AND ((others <= 2 AND comp1 <= 1) OR (comp1 <= 2 AND others < 2)) THEN 'medium'
        WHEN (comp2 = 0 AND others > 2 AND comp1 <= 2) OR (comp2 = 0 AND comp1 = 3 AND others <= 2)
          OR (comp1 <= 1 AND others = 0 AND comp2 <= 1) THEN 'hard' ELSE 'extra' END AS hardness FROM c"""
)
def log_hardness(t: Tables) -> DataFrame:
    counts = querylog.hardness_counts(F.col("norm_sql"))
    named = norm_log(t).select(
        "log_id", *[c.cast("bigint").alias(n) for c, n in zip(counts, ("comp1", "comp2", "others"))]
    )
    return named.withColumn("hardness", sqltext.hardness(F.col("comp1"), F.col("comp2"), F.col("others")))


@query(
    f"""WITH {TAGS}, g AS (SELECT CASE WHEN has_join AND (has_set_operation OR has_subquery) THEN 'join+nested' WHEN has_join THEN 'join'
         WHEN has_set_operation OR has_subquery THEN 'nested' ELSE '' END AS tag, count(*) AS n FROM tagged GROUP BY 1),
    s AS (SELECT tag, n, n / (SELECT sum(n) FROM g) AS share FROM g)
    SELECT 'combination' AS level, tag, n, round(CAST(share AS DOUBLE), 6) AS share FROM s
    UNION ALL SELECT 'tag', u, CAST(sum(n) AS BIGINT), round(CAST(sum(share) AS DOUBLE), 6) FROM (SELECT unnest(string_split(tag, '+')) AS u, n, share FROM s WHERE tag <> '') GROUP BY u"""
)
def log_tag_counts(t: Tables) -> DataFrame:
    tagged = norm_log(t).withColumn("tags", sqltext.tag_list(F.col("norm_sql")))
    return querylog.tag_totals(tagged).withColumn("share", F.round("share", 6))


@query(
    f"""WITH {TAGS} SELECT log_id, has_join AS "join", has_set_operation OR has_subquery AS nested FROM tagged"""
)
def tag_metadata(t: Tables) -> DataFrame:
    tagged = norm_log(t).withColumn("tags", sqltext.tag_list(F.col("norm_sql")))
    return tagged.select("log_id", *[c.alias(n) for n, c in sqltext.tag_flags(F.col("tags")).items()])


@query(f"WITH {CATALOG} SELECT * FROM cat")
def catalog_columns(t: Tables) -> DataFrame:
    flat = cat.catalog_columns(raw_catalog(t))
    return flat.withColumn("table_idx", F.col("table_idx").cast("bigint")).withColumn(
        "column_idx", F.col("column_idx").cast("bigint")
    )


@query(
    f"""WITH {CATALOG} SELECT db_id, CAST(0 AS BIGINT) AS key_idx, 'customer' AS table_name, 'c_custkey' AS column_names FROM seg
    UNION ALL SELECT db_id, 1, 'orders', 'o_orderkey' FROM seg
    UNION ALL SELECT db_id, 2, seg, seg || '_col1,' || seg || '_col2' FROM seg"""
)
def catalog_primary_keys(t: Tables) -> DataFrame:
    return cat.catalog_primary_keys(raw_catalog(t)).select(
        "db_id",
        F.col("key_idx").cast("bigint").alias("key_idx"),
        F.col("table_name_original").alias("table_name"),
        F.array_join("column_name_original", ",").alias("column_names"),
    )


@query(
    f"""WITH {CATALOG} SELECT db_id, CAST(0 AS BIGINT) AS key_idx, 'orders.o_custkey' AS source, 'customer.c_custkey' AS target FROM seg
    UNION ALL SELECT db_id, 1, seg || '.' || seg || '_col1', 'customer.c_custkey' FROM seg"""
)
def catalog_foreign_keys(t: Tables) -> DataFrame:
    return cat.catalog_foreign_keys(raw_catalog(t)).select(
        "db_id",
        F.col("key_idx").cast("bigint").alias("key_idx"),
        F.concat_ws(".", "source_table_name_original", "source_column_name_original").alias("source"),
        F.concat_ws(".", "target_table_name_original", "target_column_name_original").alias("target"),
    )


GROUPED = (
    CATALOG
    + """,
tabs AS (SELECT db_id, table_idx, table_name_original AS tab, string_agg(column_name_original, ',' ORDER BY column_idx) AS cols,
  string_agg(tab_col, ',' ORDER BY column_idx) AS dotted FROM (SELECT *, table_name_original || '.' || column_name_original AS tab_col FROM cat)
  GROUP BY ALL)"""
)


@query(
    f"""WITH {GROUPED} SELECT db_id, string_agg(tab, ',' ORDER BY table_idx) AS tables, string_agg(cols, ',' ORDER BY table_idx) AS columns,
    string_agg(tab || ',' || cols, ',' ORDER BY table_idx) AS flat,
    string_agg('Table ' || tab || ', columns = [' || cols || ']', chr(10) ORDER BY table_idx) AS text,
    string_agg(dotted, ',' ORDER BY table_idx) AS dotted FROM tabs GROUP BY db_id"""
)
def catalog_text(t: Tables) -> DataFrame:
    schema = F.col("db_schema")
    return nested(t).select(
        "db_id",
        F.array_join(cat.table_list(schema), ",").alias("tables"),
        F.array_join(cat.column_list(schema), ",").alias("columns"),
        F.array_join(cat.flat_list(schema), ",").alias("flat"),
        cat.schema_text(cat.table_columns(schema)).alias("text"),
        cat.dotted_text(cat.table_columns(schema)).alias("dotted"),
    )


@query(
    f"""WITH {CATALOG} SELECT db_id, string_agg(column_name || CASE WHEN column_name_original IN ('c_custkey', 'o_custkey') OR column_name_original = table_name_original || '_col1'
      THEN ' ( [FK] ) ' ELSE '' END, '|' ORDER BY column_idx) AS descriptions FROM cat GROUP BY db_id"""
)
def catalog_fk_columns(t: Tables) -> DataFrame:
    described = cat.column_descriptions(F.col("db_schema"), F.col("fk"))
    return nested(t).select("db_id", F.array_join(F.flatten(described), "|").alias("descriptions"))


LABELS = (
    NORMAL_LOG
    + ","
    + CATALOG
    + """,
toks AS (SELECT log_id, db_id, regexp_split_to_array(norm_sql, '\\s+') AS w FROM norm),
lab AS (SELECT log_id, c.*, CAST(list_contains(w, table_name_original) AS BIGINT) AS table_label,
   CAST(list_contains(w, table_name_original) AND (list_contains(w, column_name_original) OR list_contains(w, table_name_original || '.' || column_name_original)) AS BIGINT) AS column_label
   FROM toks JOIN cat c USING (db_id)),
per_table AS (SELECT log_id, table_idx, table_name_original AS tab, table_label, string_agg(column_label, ',' ORDER BY column_idx) AS labels,
   string_agg(table_name_original || '.' || column_name_original, ',' ORDER BY column_idx) FILTER (column_label = 1) AS links,
   coalesce(string_agg(column_name_original, ',' ORDER BY column_idx) FILTER (column_label = 1), '') AS used_cols
   FROM lab GROUP BY ALL)"""
)


@query(
    f"""WITH {LABELS} SELECT log_id, string_agg(table_label, ',' ORDER BY table_idx) AS table_labels,
    string_agg(labels, '|' ORDER BY table_idx) AS column_labels FROM per_table GROUP BY log_id"""
)
def schema_labels(t: Tables) -> DataFrame:
    found = linking.linked(norm_log(t), nested(t))
    return found.select(
        "log_id",
        F.array_join(F.col("table_labels").cast("array<string>"), ",").alias("table_labels"),
        F.array_join(
            F.transform("column_labels", lambda c: F.array_join(c.cast("array<string>"), ",")), "|"
        ).alias("column_labels"),
    )


@query(
    f"""WITH {LABELS} SELECT log_id, coalesce(string_agg(CASE WHEN links IS NULL THEN tab ELSE links || ',' || tab END, ',' ORDER BY table_idx) FILTER (table_label = 1), '') AS schema_links,
    coalesce(string_agg(links, ',' ORDER BY table_idx) FILTER (table_label = 1), '') AS dotted,
    coalesce(string_agg('Table ' || tab || ', columns = [' || used_cols || ']', chr(10) ORDER BY table_idx) FILTER (table_label = 1), '') AS used_text
    FROM per_table GROUP BY log_id"""
)
def schema_links(t: Tables) -> DataFrame:
    found = linking.linked(norm_log(t), nested(t))
    return found.select(
        "log_id",
        F.array_join("schema_links", ",").alias("schema_links"),
        cat.dotted_text(F.col("used")).alias("dotted"),
        cat.schema_text(F.col("used")).alias("used_text"),
    )


def log_samples(t: Tables) -> DataFrame:
    """The query log as samples: the question names the order, evidence is given for some."""
    return query_log(t).select(
        linking.dev_id("bird", F.col("log_id"), F.col("log_id")).alias("id"),
        F.concat(F.lit(" ‘Order’ "), F.col("log_id").cast("string"), F.lit(" of "), F.col("db_id"), F.lit("?  ")).alias("question"),
        F.when(F.col("log_id") % 2 == 0, F.concat(F.lit("asked of "), F.col("db_id"))).alias("evidence"),
        "db_id",
        "sql",
    )


PREPARED = (
    LABELS
    + """,
    links AS (SELECT log_id, coalesce(string_agg(CASE WHEN links IS NULL THEN tab ELSE links || ',' || tab END, ',' ORDER BY table_idx) FILTER (table_label = 1), '') AS schema_links,
      string_agg(labels, '|' ORDER BY table_idx) AS column_labels,
      coalesce(string_agg('Table ' || tab || ', columns = [' || used_cols || ']', chr(10) ORDER BY table_idx) FILTER (table_label = 1), '') AS golden
      FROM per_table GROUP BY log_id),"""
    + SKELETON[len(NORMAL_LOG) + 1:]
    + """,
    tabs AS (SELECT db_id, table_idx, table_name_original AS tab, string_agg(column_name_original, ',' ORDER BY column_idx) AS cols FROM cat GROUP BY ALL),
    seqs AS (SELECT db_id, string_agg('Table ' || tab || ', columns = [' || cols || ']', chr(10) ORDER BY table_idx) AS db_schema_sequence FROM tabs GROUP BY db_id),
    prep AS (SELECT norm.log_id, norm.db_id, '''Order'' ' || norm.log_id || ' of ' || norm.db_id || '?' AS question,
      CASE WHEN norm.log_id % 2 = 0 THEN 'asked of ' || norm.db_id END AS evidence, norm.sql, norm.norm_sql, sql_skeleton, schema_links, column_labels,
      golden, db_schema_sequence,
      CASE WHEN contains(norm.norm_sql, 'join') THEN 'join' WHEN regexp_matches(norm.norm_sql, '\\(\\s*select\\b|\\bunion\\b') THEN 'nested' ELSE '' END AS tags
      FROM norm JOIN links USING (log_id) JOIN skel USING (log_id) JOIN seqs ON seqs.db_id = norm.db_id)"""
)


@query(
    f"""WITH {PREPARED} SELECT 'bird_dev_' || log_id AS id, db_id, question, evidence, sql, norm_sql, sql_skeleton, schema_links, column_labels, tags FROM prep"""
)
def prepared_samples(t: Tables) -> DataFrame:
    done = linking.prepare(log_samples(t), nested(t))
    return done.select(
        "id", "db_id", "question", "evidence", "sql", "norm_sql", "sql_skeleton",
        F.array_join("schema_links", ",").alias("schema_links"),
        F.array_join(
            F.transform("column_labels", lambda c: F.array_join(c.cast("array<string>"), ",")), "|"
        ).alias("column_labels"),
        F.array_join("difficulty_type", ",").alias("tags"),
    )


@query(
    f"""WITH {PREPARED} SELECT 'bird_train_id_bird_dev_' || log_id AS id, question, evidence, sql, sql_skeleton, db_schema_sequence,
    golden AS golden_schema_link_sequence, db_id FROM prep"""
)
def retrieval_samples(t: Tables) -> DataFrame:
    done = linking.prepare(log_samples(t), nested(t))
    new_id = linking.train_id("bird", F.col("id"), F.lit(None))
    return linking.retrieval_samples(done, new_id).select(
        "id", "question", "evidence", "sql", "sql_skeleton", "db_schema_sequence", "golden_schema_link_sequence", "db_id"
    )


@query(
    f"""WITH {QUERY_LOG} SELECT 'bird_dev_' || log_id AS id, '''Order'' ' || log_id || ' of ' || db_id || '?' AS question, '' AS sql, '' AS norm_sql, '' AS sql_skeleton,
    '0,0,0' AS table_labels, '' AS schema_links FROM qlog"""
)
def test_mode_samples(t: Tables) -> DataFrame:
    done = linking.prepare(log_samples(t), nested(t), mode="test")
    return done.select(
        "id", "question", "sql", "norm_sql", "sql_skeleton",
        F.array_join(F.col("table_labels").cast("array<string>"), ",").alias("table_labels"),
        F.array_join("schema_links", ",").alias("schema_links"),
    )


@query(
    f"""WITH {LABELS}, fkc AS (SELECT *, column_name || CASE WHEN column_name_original IN ('c_custkey', 'o_custkey') OR column_name_original = table_name_original || '_col1'
      THEN ' ( [FK] ) ' ELSE '' END AS info FROM lab)
    SELECT 'bird_dev_' || log_id AS id, string_agg(DISTINCT table_name, '|' ORDER BY table_name) AS table_names,
      string_agg(info, '|' ORDER BY column_idx) AS column_infos, string_agg(column_label, ',' ORDER BY column_idx) AS column_labels
    FROM fkc GROUP BY log_id"""
)
def classifier_samples(t: Tables) -> DataFrame:
    done = cat.classifier_samples(linking.prepare(log_samples(t), nested(t)))
    return done.select(
        "id",
        F.array_join(F.array_sort("table_names"), "|").alias("table_names"),
        F.array_join(F.flatten("column_infos"), "|").alias("column_infos"),
        F.array_join(F.col("column_labels").cast("array<string>"), ",").alias("column_labels"),
    )


# Values that a statement names, for the columns that it compares them with.
NAMED_VALUES = [("o_orderpriority", 'o_orderpriority = "([^"]*)"'), ("o_orderstatus", "o_orderstatus = '([^']*)'")]


def named_contents(t: Tables) -> DataFrame:
    """(id, table_name, column_name, contents) of the log's samples."""
    found = F.array(*[F.struct(F.lit(c).alias("column_name"), F.regexp_extract("sql", pattern, 1).alias("v")) for c, pattern in NAMED_VALUES])
    rows = query_log(t).select(F.concat(F.lit("bird_dev_"), F.col("log_id").cast("string")).alias("id"), F.explode(found).alias("f")).where("f.v <> ''")
    # The column's name in another case than the schema's.
    return rows.select("id", F.lit("Orders").alias("table_name"), F.upper("f.column_name").alias("column_name"), F.array("f.v", F.lower("f.v")).alias("contents"))


@query(
    f"""WITH {LABELS}, v AS (SELECT log_id, regexp_extract(sql, 'o_orderpriority = "([^"]*)"', 1) AS p, regexp_extract(sql, 'o_orderstatus = ''([^'']*)''', 1) AS s FROM qlog),
    fkc AS (SELECT lab.*, column_name || CASE WHEN column_name_original IN ('c_custkey', 'o_custkey') OR column_name_original = table_name_original || '_col1' THEN ' ( [FK] ) '
      WHEN column_name_original = 'o_orderpriority' AND p <> '' THEN ' ( ' || p || ' , ' || lower(p) || ' ) '
      WHEN column_name_original = 'o_orderstatus' AND s <> '' THEN ' ( ' || s || ' , ' || lower(s) || ' ) ' ELSE '' END AS info FROM lab JOIN v ON v.log_id = lab.log_id)
    SELECT 'bird_dev_' || log_id AS id, string_agg(info, '|' ORDER BY column_idx) AS column_infos FROM fkc GROUP BY log_id"""
)
def classifier_samples_filled(t: Tables) -> DataFrame:
    """Column descriptions that hold the values found for the sample."""
    prepared = cat.with_contents(linking.prepare(log_samples(t), nested(t)), named_contents(t))
    return cat.classifier_samples(prepared).select("id", F.array_join(F.flatten("column_infos"), "|").alias("column_infos"))


# Component counts of the six forms of the log, counted by hand.
FORM_COUNTS = [(2, 0, 0, "medium"), (1, 0, 0, "easy"), (1, 1, 0, "hard"), (0, 1, 0, "hard"), (2, 0, 0, "medium"), (1, 0, 2, "medium")]


@query(
    f"""SELECT o_orderkey AS log_id, comp1, comp2, others, hardness FROM orders
    JOIN (VALUES {", ".join(f"({i}, {a}, {b}, {c}, '{h}')" for i, (a, b, c, h) in enumerate(FORM_COUNTS))}) f(form, comp1, comp2, others, hardness) ON form = o_orderkey % 6"""
)
def log_structure(t: Tables) -> DataFrame:
    """Hardness by the clauses of each statement."""
    named = norm_log(t).select("log_id", *[c.cast("int").alias(n) for n, c in zip(("comp1", "comp2", "others"), querylog.structure_counts(F.col("norm_sql")))])
    return named.withColumn("hardness", sqltext.hardness(F.col("comp1"), F.col("comp2"), F.col("others")))
