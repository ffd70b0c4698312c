"""Registered queries: sources and sinks, documents, linking of values, repair, masking,
embedding and collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import documents
from corpuslab.functions.matching import KEY_TERMS, SEPARATORS, STOP_WORDS
from corpuslab.operators import catalog as cat
from corpuslab.operators import embed, evaluate, linking, masking, mining, repair, selection, valuelink
from corpuslab.operators.ordering import sorted_ordinal
from corpuslab.plans.derived import CATALOG, NORMAL_LOG, QUERY_LOG, query_log, raw_catalog
from corpuslab.plans.mining_queries import DIM, SEED, WORD_COUNTS, sql_bands
from corpuslab.plans.registry import ORACLES, Tables, query
from corpuslab.plans.text_queries import norm_log
from corpuslab.plans.vector_queries import as_docs, as_queries
from corpuslab.session import cut, new_folder
from corpuslab.sources import samples as src
from corpuslab.sources import sinks
from corpuslab.sources.collection import VectorCollection, collection_name


@query(
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders),
    b AS (SELECT o_orderkey AS other_key, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders)
    SELECT ordinal, o_orderkey, other_key FROM a JOIN b USING (ordinal)"""
)
def paired_by_position(t: Tables) -> DataFrame:
    """The orders by key beside the orders by date, place by place."""
    a = sorted_ordinal(t.orders.select("o_orderkey"), ["o_orderkey"])
    b = sorted_ordinal(t.orders.select("o_orderdate", F.col("o_orderkey").alias("other_key")), ["o_orderdate", "other_key"])
    return src.pair_by_position(a, b.drop("o_orderdate"))


@query(
    f"""WITH {QUERY_LOG}, o AS (SELECT *, row_number() OVER (ORDER BY log_id) - 1 AS ordinal FROM qlog)
    SELECT ordinal, log_id, sql AS first_sql, CASE WHEN contains(lower(sql), 'join') THEN 'non-nested' WHEN regexp_matches(lower(sql), '\\(\\s*select\\b|\\bunion\\b') THEN 'nested' ELSE 'easy' END AS first_type,
      lower(sql) AS second_sql, CAST(2 AS BIGINT) AS n_predictions FROM o"""
)
def predictions_attached(t: Tables) -> DataFrame:
    """Two prediction files, one statement per line, written first and read back."""
    ordered = sorted_ordinal(query_log(t), ["log_id"])
    paths = []
    for text in (F.col("sql"), F.lower("sql")):
        paths.append(new_folder(t.spark, "predictions"))
        ordered.orderBy("ordinal").select(text.alias("value")).write.text(paths[-1])
    done = src.attach_predictions(ordered.select("ordinal", "log_id"), paths)
    listed = F.col("predicted_sql_list")
    return done.select(
        "ordinal", "log_id", listed[0]["sql"].alias("first_sql"), listed[0]["difficulty_type"].alias("first_type"),
        listed[1]["sql"].alias("second_sql"), F.size(listed).cast("bigint").alias("n_predictions"),
    )


@query(
    """WITH u AS (SELECT conv_id || '-' || turn // 2 AS id, 0 AS f, conv_id * 100 + turn AS r, role, text FROM conversations
    UNION ALL SELECT conv_id || '-' || turn // 2, 1, conv_id * 100 + turn, role, upper(role) FROM conversations WHERE turn % 3 = 0)
    SELECT id, r, role, text FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY f DESC, r DESC) = 1"""
)
def latest_by_id(t: Tables) -> DataFrame:
    """Conversations keyed by pairs of turns, and a second file that reissues some."""
    first = t.conversations.select(
        F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2)).alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("r"),
        "role", "text", "turn",
    )
    second = first.where("turn % 3 = 0").withColumn("text", F.upper("role"))
    return src.latest_by_id([first.drop("turn"), second.drop("turn")], "id", "r")


@query("SELECT l.doc_id, quality, toxic, lang, source, text FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def lookup_by_id(t: Tables) -> DataFrame:
    """Documents for the labelled ids; an unknown id would raise."""
    return src.lookup(t.documents.select("doc_id", "text", "lang", "source"), t.labels, "doc_id")


@query("SELECT doc_id, lang AS db_id, source AS domain FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3', 'src10') AND n_chars % 2 = 0")
def filtered_samples(t: Tables) -> DataFrame:
    """Documents as samples: the language is the database, the parity of the length a tag."""
    rows = t.documents.select(
        "doc_id", F.col("lang").alias("db_id"), F.col("source").alias("domain"),
        F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("nested"))).otherwise(F.array(F.lit("join"))).alias("difficulty_type"),
    )
    kept = evaluate.filtered_samples(rows, ["fr", "de"], ["nested"], ["src1", "src2", "src3", "src10"], must_exist=True)
    return kept.drop("difficulty_type")


TEXT_COLUMNS = {
    "part": ["p_name", "p_brand", "p_type"],
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "supplier": ["s_name"],
}


@query(
    " UNION ALL ".join(
        f"SELECT DISTINCT '{table}' AS table_name, '{c}' AS column_name, {c} AS value FROM {table}"
        for table, columns in TEXT_COLUMNS.items()
        for c in columns
    )
)
def column_values(t: Tables) -> DataFrame:
    parts = [src.column_values(getattr(t, table), table, columns) for table, columns in TEXT_COLUMNS.items()]
    return reduce(DataFrame.unionAll, parts)


@query(
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal FROM conversations)
    SELECT conv_id, turn, 'spider_dev_' || CASE WHEN turn % 2 = 0 THEN conv_id * 10 + turn ELSE ordinal END AS dev_id,
      'bird_train_id_' || CASE WHEN role = 'user' THEN role || turn ELSE CAST(ordinal AS VARCHAR) END AS train_id FROM o"""
)
def sample_ids(t: Tables) -> DataFrame:
    rows = sorted_ordinal(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    own = F.when(F.col("turn") % 2 == 0, F.col("conv_id") * 10 + F.col("turn"))
    given = F.when(F.col("role") == "user", F.concat(F.col("role"), F.col("turn").cast("string"))).otherwise(F.lit(""))
    return rows.select(
        "conv_id", "turn", linking.dev_id("spider", own, F.col("ordinal")).alias("dev_id"),
        linking.train_id("bird", given, F.col("ordinal")).alias("train_id"),
    )


def turn_pairs(t: Tables) -> DataFrame:
    """User turns with the assistant's answer: question, sql (the answer), evidence (the role)."""
    asked = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = t.conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sql")
    )
    return asked.join(answers, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "question", "sql",
        F.when(F.col("turn") > 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("evidence"),
        F.regexp_replace("sql", r"[\p{L}\p{N}]+", "_").alias("sql_skeleton"),
        F.concat(F.lit("Table conv, columns = ["), F.col("conv_id").cast("string"), F.lit("]")).alias("db_schema_sequence"),
        F.concat(F.lit("conv."), F.col("turn").cast("string")).alias("schema_link"),
    )


SQL_TURNS = """turns AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS question, b.text AS sql, CASE WHEN a.turn > 0 THEN 'turn ' || a.turn END AS evidence,
    regexp_replace(b.text, '[\\p{L}\\p{N}]+', '_', 'g') AS skel, 'Table conv, columns = [' || a.conv_id || ']' AS seq, 'conv.' || a.turn AS link
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


@query(
    f"""WITH {SQL_TURNS}, n AS (SELECT *, chr(10) AS nl FROM turns) SELECT id, question AS "QUESTION", sql AS "SQL", skel AS "SQL_SKELETON", seq AS "DB_SCHEMA", link AS "SCHEMA_LINK",
    question || nl || sql AS "QUESTION_SQL", question || nl || skel AS "QUESTION_SQL_SKELETON", question || nl || link || nl || sql AS "FULL" FROM n"""
)
def collection_documents(t: Tables) -> DataFrame:
    return turn_pairs(t).select("id", *[documents.document(f).alias(f) for f in documents.EMBEDDING_FIELDS])


@query(
    f"""WITH {SQL_TURNS}, n AS (SELECT *, chr(10) AS nl, question || ' ' || coalesce(evidence, '') AS qe FROM turns) SELECT id, question AS q_question, question || nl || sql AS q_question_sql,
    qe AS q_question_evidence, qe || nl || sql AS q_question_evidence_sql, sql AS d_sql, question || nl || sql AS d_question_sql FROM n"""
)
def ranking_texts(t: Tables) -> DataFrame:
    forms = ["question", "question_sql", "question_evidence", "question_evidence_sql"]
    return turn_pairs(t).select(
        "id",
        *[documents.query_text(f).alias(f"q_{f}") for f in forms],
        *[documents.doc_text(f).alias(f"d_{f}") for f in documents.DOC_FORMATS],
    )


def document_words(t: Tables) -> DataFrame:
    """Every distinct word of the documents as a value of the column of its language."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("value")
    return t.wide("documents", "lang", "text").select("lang", words).distinct().select(
        F.lit("documents").alias("table_name"), F.col("lang").alias("column_name"), "value"
    )


@query()
def value_links(t: Tables) -> DataFrame:
    """Words of the documents linked to the benchmark texts. The rule has no SQL form;
    the tests compare it with every pair judged."""
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    links = valuelink.link_values(asked, document_words(t))
    return links.select("question_id", "table_name", "column_name", "value", "source", F.round("score", 6).alias("score"), "rank")


@query()
def value_links_loose(t: Tables) -> DataFrame:
    """Words of the documents linked to the benchmark texts with half the words' letters wrong at most."""
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    links = valuelink.link_values(asked, document_words(t), threshold=0.7)
    return links.select("question_id", "table_name", "column_name", "value", "source", F.round("score", 6).alias("score"), "rank")


_out = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS | KEY_TERMS))
_edge = "'" + SEPARATORS.replace("'", "''") + "'"


@query(
    rf"""WITH words AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS value FROM documents),
    usable AS (SELECT * FROM words WHERE length(value) >= 2 AND lower(value) NOT IN ({_out}) AND NOT regexp_matches(value, '{valuelink.NUMBER}')),
    asked AS (SELECT item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS q FROM benchmark),
    met AS (SELECT item_id, lang, value, q, strpos(lower(q), lower(value)) AS pos FROM asked, usable WHERE strpos(lower(q), lower(value)) > 0),
    whole AS (SELECT *, substr(q, pos, length(value)) AS source FROM met
      WHERE (pos = 1 OR strpos({_edge}, substr(q, pos - 1, 1)) > 0) AND (pos + length(value) > length(q) OR strpos({_edge}, substr(q, pos + length(value), 1)) > 0)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY CAST(1e16 AS DOUBLE) + 1e8 + length(value) DESC, value) AS rank FROM whole)
    SELECT item_id AS question_id, 'documents' AS table_name, lang AS column_name, value, source, CAST(1 AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 2"""
)
def value_links_exact(t: Tables) -> DataFrame:
    """Only words of the texts that are values as they stand."""
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    links = valuelink.link_values(asked, document_words(t), threshold=1.0)
    return links.select("question_id", "table_name", "column_name", "value", "source", F.round("score", 6).alias("score"), "rank")


@query()
def value_contents(t: Tables) -> DataFrame:
    """Names of parts linked to texts that mention them, as sorted contents per column."""
    asked = t.part.select(
        F.col("p_partkey").alias("question_id"), F.concat(F.lit("price of the "), F.col("p_name"), F.lit("s by "), F.col("p_brand"), F.lit("?")).alias("question")
    )
    values = src.column_values(t.part.withColumnRenamed("p_name", "p_label"), "part", ["p_label", "p_brand", "p_type"])
    contents = valuelink.column_contents(valuelink.link_values(asked, values))
    return contents.withColumn("contents", F.array_join("contents", ","))


MISSPELLINGS = [("c_name", "c_nmae"), ("o_totalprice", "o_totlprice"), ("customer AS", "custommer AS"), ("FROM orders", "FROM ordrs")]


def misspelt(t: Tables) -> DataFrame:
    """The log as it is written, with aliases, functions and literals, and some names misspelt."""
    text = F.col("sql")
    for right, wrong in MISSPELLINGS:
        text = F.replace(text, F.lit(right), F.lit(wrong))
    return query_log(t).select("log_id", "db_id", text.alias("sql"))


RESERVED = ", ".join(f"'{w}'" for w in repair.RESERVED)
MISSPELT = "sql"
for right, wrong in MISSPELLINGS:
    MISSPELT = f"replace({MISSPELT}, '{right}', '{wrong}')"
SQL_MISSPELT = rf"""{QUERY_LOG}, {CATALOG},
    bad AS (SELECT log_id, db_id, {MISSPELT} AS sql FROM qlog),
    names AS (SELECT DISTINCT db_id, table_name_original AS name, table_idx * 1000 AS pos FROM cat UNION ALL SELECT db_id, column_name_original, table_idx * 1000 + column_idx FROM cat),
    plain AS (SELECT log_id, db_id, regexp_replace(replace(sql, '"', ''''), '''[^'']*''', '''''', 'g') AS sql FROM bad),
    others AS (SELECT log_id, list_transform(list_concat(list_concat(regexp_extract_all(sql, '([A-Za-z_]\w*)\s*\(', 1), regexp_extract_all(sql, '(?i)\bas\s+([A-Za-z_]\w*)', 1)),
      regexp_extract_all(sql, '(?i)\b(?:from|join)\s+[A-Za-z_]\w*\s+([A-Za-z_]\w*)', 1)), lambda x: lower(x)) AS o FROM plain),
    used AS (SELECT DISTINCT log_id, db_id, unnest(regexp_extract_all(sql, '[A-Za-z_]\w*')) AS ident FROM plain),
    unknown AS (SELECT u.* FROM used u JOIN others x ON x.log_id = u.log_id WHERE lower(ident) NOT IN ({RESERVED}) AND NOT list_contains(o, lower(ident)) AND NOT EXISTS (SELECT 1 FROM names n WHERE n.db_id = u.db_id AND n.name = u.ident))"""


def catalog_names(t: Tables) -> DataFrame:
    return cat.nested_catalog(raw_catalog(t)).select("db_id", F.posexplode(cat.flat_list(F.col("db_schema"))).alias("pos", "name"))


def _sql_repair(order: str) -> str:
    return f"""WITH {SQL_MISSPELT},
    maps AS (SELECT u.log_id, u.ident, arg_max(n.name, {order}) AS name FROM unknown u JOIN names n ON n.db_id = u.db_id WHERE levenshtein(u.ident, n.name) <= 3 GROUP BY ALL),
    agg AS (SELECT log_id, list(ident) AS idents, list(name) AS targets FROM maps GROUP BY log_id)
    SELECT b.log_id, CASE WHEN idents IS NULL THEN b.sql ELSE array_to_string(list_transform(regexp_extract_all(b.sql, '''[^'']*''|"[^"]*"|\\w+|[^\\w''"]+|[''"]'), lambda w: coalesce(targets[list_position(idents, w)], w)), '') END AS repaired
    FROM bad b LEFT JOIN agg USING (log_id)"""


@query(_sql_repair("pos"))
def name_repair(t: Tables) -> DataFrame:
    return repair.repair(misspelt(t), catalog_names(t)).select("log_id", "repaired")


@query(_sql_repair("(-levenshtein(u.ident, n.name), pos)"))
def name_repair_nearest(t: Tables) -> DataFrame:
    return repair.repair(misspelt(t), catalog_names(t), nearest=True).select("log_id", "repaired")


# Masking: user turns against the items of a database and the first two words of the
# turn itself; sensitivities and tags are made from word lengths.
def mask_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    asked = t.wide("conversations").where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.concat(F.lit("db"), F.col("conv_id").cast("string")).alias("db_id"),
        F.col("text").alias("question"),
    )
    words = asked.select("question_id", "db_id", masking.question_words(F.col("question")).alias("w"))
    schema = cat.nested_catalog(raw_catalog(t)).select(
        "db_id", F.concat(F.transform("db_schema", lambda s: s["table_name"]), F.flatten(F.transform("db_schema", lambda s: s["column_names"]))).alias("items")
    )
    # Catalogs and item words are large beside their files: they are not to be broadcast by the files' size.
    items = words.join(schema.hint("merge"), "db_id").select("question_id", F.concat("items", F.array(F.array_join(F.slice("w", 1, 2), " "))).alias("items"))
    tokens = words.select("question_id", F.posexplode("w").alias("pos", "token")).withColumn(
        "tag", F.when(F.length("token") > 5, F.lit("NOUN")).otherwise(F.lit("VERB"))
    )
    vocab = cut(masking.vocabulary(items))
    sensitivity = tokens.join(vocab.hint("merge"), "question_id").select(
        "question_id", "pos", "token_idx", ((F.length("token") * 7 + F.length("word") * 3) % 11 / 10.0).cast("double").alias("value")
    )
    return asked, tokens, vocab, sensitivity


SQL_MASK = f"""{CATALOG},
    asked AS (SELECT conv_id || '-' || turn AS question_id, 'db' || conv_id AS db_id, text AS question, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM conversations WHERE role = 'user'),
    listed AS (SELECT DISTINCT db_id, table_idx * 1.0 AS o, table_name AS item FROM cat UNION ALL SELECT db_id, 100.0 + column_idx, column_name FROM cat),
    items AS (SELECT question_id, o, item FROM asked JOIN listed USING (db_id) UNION ALL SELECT question_id, 1000.0, array_to_string(w[1:2], ' ') FROM asked),
    vocab AS (SELECT question_id, o, unnest(regexp_extract_all(lower(item), '[\\pL\\pN_]+')) AS word, len(regexp_extract_all(lower(item), '[\\pL\\pN_]+')) AS n_words FROM items),
    n AS (SELECT question_id, count(*) AS n_items FROM items GROUP BY ALL),
    toks AS (SELECT question_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM asked),
    sens AS (SELECT t.question_id, pos, token, o, word, n_words, ((length(token) * 7 + length(word) * 3) % 11) / 10.0 AS value FROM toks t JOIN vocab v ON v.question_id = t.question_id),
    high AS (SELECT question_id, max(value) AS high FROM sens GROUP BY ALL),
    eff AS (SELECT s.question_id, pos, token, sum(CAST(value AS DOUBLE) / CASE WHEN high = 0 THEN 1 ELSE CAST(high AS DOUBLE) END / n_words) AS e, count(DISTINCT CASE WHEN token = word THEN o END) AS m FROM sens s JOIN high h ON h.question_id = s.question_id GROUP BY ALL),
    scores AS (SELECT question_id, pos, token, round(((e + 0.5 * m) / n_items + CASE WHEN length(token) > 5 THEN 0.9 ELSE 0 END) / 2, 12) AS score FROM eff JOIN n USING (question_id))"""


@query(f"WITH {SQL_MASK} SELECT question_id, pos, token, round(score, 9) AS score FROM scores")
def mask_scores(t: Tables) -> DataFrame:
    _, tokens, vocab, sensitivity = mask_inputs(t)
    scores = masking.token_scores(tokens, vocab, sensitivity)
    return scores.select("question_id", F.col("pos").cast("bigint").alias("pos"), "token", F.round("score", 9).alias("score"))


@query(
    f"""WITH {SQL_MASK}, chosen AS (SELECT question_id, list(DISTINCT token) AS ws FROM scores WHERE score > 0.65 AND token NOT IN ('name', 'number') GROUP BY question_id)
    SELECT question_id, CASE WHEN ws IS NULL THEN question ELSE array_to_string(list_transform(regexp_extract_all(question, '[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda p: CASE WHEN list_contains(ws, lower(p)) THEN '[Mask]' ELSE p END), '') END AS skeleton
    FROM asked LEFT JOIN chosen USING (question_id)"""
)
def question_mask(t: Tables) -> DataFrame:
    asked, tokens, vocab, sensitivity = mask_inputs(t)
    return masking.mask_questions(asked, masking.token_scores(tokens, vocab, sensitivity))


@query(
    f"""WITH {WORD_COUNTS}, d AS (SELECT b, count(*) AS df FROM counts GROUP BY b),
    x AS (SELECT doc_id, b, c * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w FROM counts JOIN d USING (b)),
    l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM x GROUP BY doc_id)
    SELECT doc_id, CAST(b AS BIGINT) AS bucket, round(w / greatest(len, 1e-12), 6) AS weight FROM x JOIN l USING (doc_id)"""
)
def tf_idf_weights(t: Tables) -> DataFrame:
    weights = embed.tf_idf(t.wide("documents", "doc_id", "text"), "doc_id", "text", DIM)
    return weights.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {WORD_COUNTS}, l AS (SELECT doc_id, sqrt(sum(c * c)) AS len FROM counts GROUP BY doc_id)
    SELECT doc_id, CAST(b AS BIGINT) AS bucket, round(c / len, 6) AS weight FROM counts JOIN l USING (doc_id)"""
)
def hash_embed(t: Tables) -> DataFrame:
    """The default encoder's vectors, entry by entry."""
    vecs = t.wide("documents", "doc_id", "text").select("doc_id", embed.hash_embed(F.col("text"), DIM).alias("vec"))
    entries = vecs.select("doc_id", F.posexplode("vec").alias("bucket", "weight")).where("weight > 0")
    return entries.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


def counted(text: Column) -> Column:
    """Word counts as an encoder: whole numbers, so equal distances are equal everywhere."""
    return embed.word_count_vector(text, DIM)


SQL_TEXT_PICK = f"""{SQL_TURNS}, texts AS (SELECT id, question AS asked, sql AS doc, length(sql) % 2 AS tag FROM turns),
    hashed AS (SELECT id, side, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS b FROM (
      SELECT id, 'q' AS side, unnest(regexp_extract_all(lower(asked), '[\\p{{L}}\\p{{N}}]+')) AS w FROM texts UNION ALL SELECT id, 'd', unnest(regexp_extract_all(lower(doc), '[\\p{{L}}\\p{{N}}]+')) FROM texts)),
    n AS (SELECT id, side, b, count(*) AS c FROM hashed GROUP BY ALL),
    vq AS (SELECT id, tag, (SELECT list(coalesce(c, 0) :: DOUBLE ORDER BY i) FROM range({DIM}) r(i) LEFT JOIN n ON n.id = t.id AND side = 'q' AND b = i) AS v FROM texts t),
    vd AS (SELECT id, tag, (SELECT list(coalesce(c, 0) :: DOUBLE ORDER BY i) FROM range({DIM}) r(i) LEFT JOIN n ON n.id = t.id AND side = 'd' AND b = i) AS v FROM texts t),
    scored AS (SELECT q.id AS query_id, d.id AS doc_id, CAST(round(list_distance(q.v, d.v) ** 2) AS DOUBLE) AS distance FROM vq q JOIN vd d ON q.tag = d.tag)"""


@query(
    f"""WITH {SQL_TEXT_PICK} SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM scored QUALIFY rank <= 4"""
)
def select_by_text(t: Tables) -> DataFrame:
    """Examples of the asker's type whose answer is nearest to a predicted answer, for
    which the question stands in."""
    rows = turn_pairs(t).withColumn("difficulty_type", F.array((F.length("sql") % 2).cast("string")))
    asked = rows.withColumn("predicted", F.col("question"))
    picked = selection.select_examples(
        asked, rows, 4, fields="SQL", statement="predicted", same_type="difficulty_type", encoder=counted
    )
    return picked.select("query_id", "doc_id", "distance", F.col("rank").cast("bigint").alias("rank"))


@query(
    f"""WITH {SQL_TEXT_PICK}, near AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) <= 10),
    asked_words AS (SELECT id AS query_id, b, count(*) AS c FROM hashed WHERE side = 'q' GROUP BY ALL), held AS (SELECT DISTINCT id AS doc_id, b FROM hashed WHERE side = 'd'),
    s AS (SELECT n.query_id, n.doc_id, CAST(coalesce(sum(CASE WHEN h.b IS NOT NULL THEN w.c END), 0) AS DOUBLE) AS score FROM near n JOIN asked_words w ON w.query_id = n.query_id LEFT JOIN held h ON h.doc_id = n.doc_id AND h.b = w.b GROUP BY ALL)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3"""
)
def rerank_by_text(t: Tables) -> DataFrame:
    """Questions against answers of their type: ten by text vectors, three by interaction."""
    rows = turn_pairs(t).withColumn("difficulty_type", F.array((F.length("sql") % 2).cast("string")))

    def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
        return embed.word_token_vectors(df, key, text, DIM)

    best = selection.rerank_by_text(rows, rows, 3, big=10, type_tags="difficulty_type", tokens=tokens, encoder=counted)
    return best.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def fresh_collection(t: Tables) -> VectorCollection:
    """The documents, in two datasets by parity of their ids; each is offered twice."""
    rows = t.wide("documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("source").alias("domain"),
        F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("nested"))).otherwise(F.array(F.lit("join"))).alias("difficulty_type"),
        (F.col("doc_id") % 2).alias("part"),
    )
    name = collection_name("default", "EUCLIDEAN", "QUESTION", ["even", "odd"])
    held = VectorCollection.create(t.spark, new_folder(t.spark, "collections"), name, fields="QUESTION")
    for i, part in enumerate(("even", "odd", "even")):
        held.insert(rows.where(F.col("part") == i % 2), f"documents/{part}", part)
    return VectorCollection.load(t.spark, held.root, name)


@query(
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, source AS domain, count(*) AS n, count(*) FILTER (n_chars % 2 = 0) AS nested,
    count(*) FILTER (n_chars % 2 = 1) AS joined, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL"""
)
def collection_ingest(t: Tables) -> DataFrame:
    return fresh_collection(t).rows().groupBy("dataset", "domain").agg(
        F.count("*").alias("n"), F.sum(F.col("tag_nested").cast("bigint")).alias("nested"),
        F.sum(F.col("tag_join").cast("bigint")).alias("joined"), F.sum(F.length("document")).cast("bigint").alias("chars"),
    )


@query(
    r"""WITH texts AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), text FROM benchmark),
    words AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM texts),
    counts AS (SELECT side, id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b, count(*) AS c FROM words GROUP BY ALL),
    lens AS (SELECT side, id, sqrt(sum(c * c)) AS len FROM counts GROUP BY ALL),
    vecs AS (SELECT t.side, t.id, text, (SELECT list(coalesce(c, 0) / greatest(coalesce(len, 0), 1e-12) ORDER BY i) FROM range(64) r(i) LEFT JOIN counts ON counts.side = t.side AND counts.id = t.id AND b = i) AS v
      FROM texts t LEFT JOIN lens ON lens.side = t.side AND lens.id = t.id),
    scored AS (SELECT CAST(q.id AS BIGINT) AS query_id, d.id AS doc_id, list_distance(q.v, d.v) ** 2 AS distance, d.text AS document FROM vecs q JOIN vecs d ON q.side = 'q' AND d.side = 'd')
    SELECT query_id, doc_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS rank, document FROM scored QUALIFY rank <= 3"""
)
def collection_query(t: Tables) -> DataFrame:
    """Benchmark texts against the stored documents tagged nested."""
    held = fresh_collection(t)
    asked = embed.embed(t.benchmark, "text").select(F.col("item_id").alias("query_id"), "vec")
    found = held.query(asked, 3, F.col("tag_nested"))
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"), "document")


@query(
    f"""WITH {sql_bands(2, 1, 20)} SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) FILTER (band = 'hard') AS difficulty_ids,
    round(sum(score) FILTER (band = 'hard'), 4) AS difficulty_score FROM banded GROUP BY query_id"""
)
def negative_map(t: Tables) -> DataFrame:
    """Bands written as sidecar files, read back, gathered per query."""
    bands = mining.mine_bands(as_queries(t), as_docs(t), 2, 1, 20)
    path = new_folder(t.spark, "negatives")
    sinks.write_negatives(bands, path)
    gathered = sinks.negative_map(sinks.read_negatives(t.spark, path))
    total = F.aggregate("difficulty_scores", F.lit(0.0), lambda a, x: a + x)
    return gathered.select(
        "query_id", F.array_join(F.col("difficulty_ids").cast("array<string>"), ",").alias("difficulty_ids"),
        F.round(total, 4).alias("difficulty_score"),
    )


@query(
    f"""WITH {sql_bands(2, 1, 20)} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score FROM banded WHERE band = 'pos'"""
)
def positive_lines(t: Tables) -> DataFrame:
    """Positives written as JSON lines and read back."""
    path = new_folder(t.spark, "positives")
    sinks.write_positives(mining.mine_bands(as_queries(t), as_docs(t), 2, 1, 20), path)
    line = F.from_json("value", "array<string>")
    pair = F.from_json(line[1], "array<string>")
    return t.spark.read.text(path).select(
        line[0].alias("query_id"), pair[0].alias("doc_id"), F.round(pair[1].cast("double"), 6).alias("score")
    )


@query(
    f"""SELECT CAST(query_id AS VARCHAR) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY band = 'neg', slot) AS place, CAST(doc_id AS VARCHAR) AS doc_id, score
    FROM ({ORACLES["mine_pos_neg"]})"""
)
def pos_neg_lines(t: Tables) -> DataFrame:
    """Lines of ids and scores, taken apart again."""
    parts = F.from_json("line", "array<string>")
    lines = sinks.pos_neg_lines(mining.mine_pos_neg(as_queries(t), as_docs(t), 5, SEED))
    rows = lines.select(parts[0].alias("query_id"), F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("place", "item"))
    pair = F.from_json("item", "array<string>")
    return rows.select(
        "query_id", (F.col("place") + 1).cast("bigint").alias("place"), pair[0].alias("doc_id"), F.round(pair[1].cast("double"), 6).alias("score")
    )


@query("SELECT doc_id, trim(coalesce(text, ''), chr(10)) AS document FROM documents")
def document_dump(t: Tables) -> DataFrame:
    """Documents dumped with five newlines between them, and read back by that gap."""
    path = new_folder(t.spark, "dump")
    rows = t.documents.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.btrim(F.coalesce("text", F.lit("")), F.lit("\n"))).alias("document")
    )
    sinks.write_dump(rows, path)
    read = t.spark.read.option("lineSep", sinks.DOCUMENT_GAP).text(path)
    return read.select(
        F.substring_index("value", "\t", 1).cast("bigint").alias("doc_id"),
        F.expr("substr(value, locate('\t', value) + 1)").alias("document"),
    )
