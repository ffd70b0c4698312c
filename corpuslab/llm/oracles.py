"""SQL forms of the queries that have one."""

from __future__ import annotations

from corpuslab.llm.licenses import NOTICES
from corpuslab.llm.linkgraph import LINK, LOWER, RULES, UPPER
from corpuslab.llm.quality import RULES as QUALITY_RULES

SPACE = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"

_failed = ", ".join(f"CAST(CAST(({rule}) AS INT) AS BIGINT) AS f_{r}" for r, rule in QUALITY_RULES.items())
_by_rule = " UNION ALL ".join(f"SELECT source, '{r}' AS rule, count(*) AS n, sum(f_{r}) AS f FROM failed WHERE source IS NOT NULL GROUP BY source" for r in QUALITY_RULES)
QUALITY = rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
    w AS (SELECT *, regexp_extract_all(x, '{WORDS}') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{WORDS}')) AS l FROM t),
    g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
    s AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n ON n.doc_id = w.doc_id),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
    failed AS (SELECT *, {_failed} FROM b),
    h AS ({_by_rule}),
    m AS (SELECT rule, avg(f / n) AS mean, avg((f / n) * (f / n)) AS square, avg(1 / n) AS noise FROM h GROUP BY rule),
    p AS (SELECT rule, mean, CASE WHEN mean IN (0, 1) THEN 2.0 ELSE 1 / least(greatest((square - mean * mean - mean * (1 - mean) * noise) / greatest(1 - noise, 1e-9) / (mean * (1 - mean)), 1e-6), 1 - 1e-6) - 1 END AS weight FROM m),
    hosts AS (SELECT source, max((f + mean * weight) / (n + weight)) AS rate FROM h JOIN p USING (rule) GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate <= 0.75, TRUE) AS kept, round(rate, 9) AS host_rate
    FROM b LEFT JOIN hosts ON hosts.source = b.source"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
    r AS (SELECT *, strlen(h) >= 1000 AND page_id <> top AS again FROM p)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r"""

_templates = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in NOTICES.items())
LICENSES = rf"""WITH lines AS (SELECT doc_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    units AS (SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line, unnest(l) AS unit FROM lines UNION ALL SELECT doc_id, 0, x FROM lines WHERE len(l) > 1),
    both_ AS (SELECT doc_id, line, NULL AS license, unit FROM units UNION ALL SELECT NULL, NULL, a, b FROM (VALUES {_templates}) v(a, b)),
    w AS (SELECT doc_id, line, license, list_filter(string_split_regex(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM both_),
    g AS (SELECT doc_id, line, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) BETWEEN 2 AND 60),
    s AS (SELECT u.doc_id, u.line, t.license, len(list_intersect(u.g, t.g)) AS shared, CAST(len(u.g) AS INT) AS unit_size, CAST(len(t.g) AS INT) AS template_size
      FROM g u, g t WHERE u.license IS NULL AND t.license IS NOT NULL AND len(u.g) <= 1.5 * len(t.g) AND 1.5 * len(u.g) >= len(t.g))
    SELECT *, 2 * shared / (unit_size + template_size) AS dice FROM s WHERE 2 * shared / (unit_size + template_size) >= 0.8"""

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other)
    SELECT r.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def _fits(domain: str, start: str) -> str:
    return f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}'))"


_longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_rule = "CASE " + " ".join(f"WHEN {_fits(d, p)} THEN '{d}{p}'" for _, d, p in _longest) + " END"
_by = "CASE " + " ".join(f"WHEN {_fits(d, p)} THEN '{v}'" for v, d, p in _longest) + " END"


def _host(url: str) -> str:
    return rf"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"


def _walk(name: str, seeds: str, source: str, target: str) -> str:
    """PageRank as the sum of what arrives over paths of 0, 1, 2, .. links, until that is next to nothing."""
    return f"""{name}_s AS (SELECT {source} AS source, {target} AS target, weight / sum(weight) OVER (PARTITION BY {source}) AS share FROM edges),
    {name}_p AS (SELECT host, 0.15 / count(*) OVER () AS score, 0 AS n FROM seeds WHERE {seeds}
      UNION ALL SELECT target, 0.85 * sum(share * score), n + 1 FROM {name}_p JOIN {name}_s ON source = host WHERE n < 300 GROUP BY target, n),
    {name} AS MATERIALIZED (SELECT host, sum(score) AS score FROM {name}_p GROUP BY host)"""


_link = LINK.replace("'", "''")
URLS = rf"""WITH RECURSIVE rows_ AS (SELECT page_id, html, {_host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, {_rule} AS rule, {_by} AS by_rule FROM rows_),
    links AS (SELECT host AS source, unnest(regexp_extract_all(html, '{_link}', 1)) AS link FROM ruled),
    ends AS (SELECT source, {_host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS target FROM links),
    edges AS MATERIALIZED (SELECT source, target, count(*) AS weight FROM ends WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
    seeds AS MATERIALIZED (SELECT host, count(*) FILTER (by_rule = 'allow') AS yes, count(*) FILTER (by_rule = 'block') AS no FROM ruled WHERE host <> '' GROUP BY host),
    {_walk('good', 'yes > no', 'source', 'target')}, {_walk('bad', 'no > yes', 'target', 'source')},
    marks AS (SELECT s.host, coalesce(g.score, 0) AS trust, coalesce(b.score, 0) AS distrust FROM seeds s LEFT JOIN good g ON g.host = s.host LEFT JOIN bad b ON b.host = s.host)
    SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' END, 'allow') AS verdict,
      round(coalesce(trust, 0), 12) AS trust, round(coalesce(distrust, 0), 12) AS distrust FROM ruled r LEFT JOIN marks m ON m.host = r.host"""


def _assign(name: str, book: str) -> str:
    """The nearest entry of every part, as squared distance * 64 + entry."""
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    return f"{name} AS MATERIALIZED (SELECT p.vec_id, p.part, CAST(min({far} * 64 + entry) AS BIGINT) AS m FROM parts p JOIN {book} b ON b.part = p.part GROUP BY ALL)"


def _average(name: str, assigned: str, book: str) -> str:
    """Entries of the next round."""
    return f"""{name}_p AS (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.part, m % 64 AS entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM {assigned} a JOIN parts p ON p.vec_id = a.vec_id AND p.part = a.part) GROUP BY ALL),
    {name}_n AS (SELECT part, entry, list(x ORDER BY i) AS x FROM {name}_p GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM {book} b LEFT JOIN {name}_n n ON n.part = b.part AND n.entry = b.entry)"""


CODES = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, CAST(k AS INT) AS part, v[k * len(v) // 16 + 1 : (k + 1) * len(v) // 16] AS x FROM v, range(16) r(k)),
    book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts QUALIFY entry < 64),
    {_assign('a1', 'book0')}, {_average('book1', 'a1', 'book0')}, {_assign('a2', 'book1')}, {_average('book2', 'a2', 'book1')}, {_assign('a3', 'book2')},
    c AS (SELECT vec_id, string_agg(lpad(to_hex(m % 64), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book2)
    SELECT c.vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN v ON v.vec_id = c.vec_id, h"""

EXACT = rf"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS norm FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""

RESAMPLED = rf"""WITH both_ AS (SELECT doc_id, 1 AS source, text FROM documents UNION ALL SELECT NULL, 0, text FROM benchmark),
    w AS (SELECT doc_id, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM both_),
    crc_table AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
    bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: 16 * (strpos('0123456789ABCDEF', hex(w)[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex(w)[2 * i + 2]) - 1) AS b FROM (SELECT DISTINCT w FROM w)),
    buckets AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x // 256, c[xor(x, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
    f AS MATERIALIZED (SELECT doc_id, source, bucket, count(*) AS n FROM w JOIN buckets USING (w) GROUP BY ALL),
    n AS (SELECT bucket, CAST(sum(n * source) AS BIGINT) AS s, CAST(sum(n * (1 - source)) AS BIGINT) AS t FROM f GROUP BY bucket),
    gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (CAST((SELECT sum(s) FROM n) AS DOUBLE) + 10000) / (CAST(s + 1 AS DOUBLE) * (CAST((SELECT sum(t) FROM n) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM n),
    d AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM f JOIN gains USING (bucket) WHERE source = 1 GROUP BY doc_id),
    s AS (SELECT o.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256('2024:' || o.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM s)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= many * 10 // 100 THEN r END AS rank FROM r"""

ORACLES = {
    "op11_vector_codes": CODES, "op12_exact_duplicates": EXACT, "op13_importance_resampling": RESAMPLED,
    "op1_quality_rules": QUALITY, "op3_warc": WARC, "op6_license_scan": LICENSES, "op7_near_duplicates": NEAR, "op10_url_filter": URLS,
}
