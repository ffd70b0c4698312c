"""Value linking: expected links worked out by hand, and properties that hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import matching
from corpuslab.operators import repair, valuelink
from corpuslab.sources.samples import column_values

LONG = " ".join(f"part{i}" for i in range(4000))

# question, column, value, expected (source, score) or None
CASES = [
    ("flights to boston", "city", "Boston", ("boston", 1.0)),  # whole word, case apart
    ("flights to bostons", "city", "Boston", ("bostons", 12 / 13)),  # the word goes on for one letter
    ("flights to bostonians", "city", "Boston", None),  # it goes on for too many
    ("in newboston", "city", "Boston", None),  # begins inside a word
    ("is abcd there", "city", "abce", None),  # 2 * 3 / 8 is under the limit
    ("the new york times", "city", "new york", ("new york", 1.0)),
    ("show me the id", "key", "id", None),  # key term
    ("what is the", "word", "the", None),  # stop word
    ("in 1984 or so", "year", "1984", None),  # number
    ("about 1,984.5 or so", "year", "1,984.5", None),
    ("is it a yes or no", "flag", "Yes", ("yes", 1.0)),  # common word, exact
    ("many yess here", "flag", "yes", None),  # common word, not exact
    ("flights to usas", "code", "USAX", None),  # capitals want an exact match
    ("flights to usa", "code", "USA", ("usa", 1.0)),
    ("people called jonsen", "last_name", "jonson", None),  # called after a name: exact only
    ("people called jonson", "last_name", "jonson", ("jonson", 1.0)),
    ("so 'blue moon', he said", "song", "Blue Moon", ("blue moon", 1.0)),
    ("in são paulo now", "city", "São Paulo", ("são paulo", 1.0)),
    ("", "city", "Boston", None),
    ("boston", "city", "b", None),  # one character
]


def links(spark, questions, values, **options):
    q = spark.createDataFrame(questions, "question_id int, question string")
    v = spark.createDataFrame(values, "table_name string, column_name string, value string")
    return [r.asDict() for r in valuelink.link_values(q, v, **options).collect()]


def test_cases(spark):
    questions = [(i, c[0]) for i, c in enumerate(CASES)]
    values = [(f"t{i}", c[1], c[2]) for i, c in enumerate(CASES)]
    found = {(r["question_id"], r["table_name"]): (r["source"], round(r["score"], 9)) for r in links(spark, questions, values)}
    for i, (_, _, _, want) in enumerate(CASES):
        assert found.get((i, f"t{i}")) == (want and (want[0], round(want[1], 9))), CASES[i]


@pytest.mark.parametrize("size", [199, 200, 201, 20_000])
def test_length_does_not_matter(spark, size):
    value = LONG[:size].rstrip()
    rows = links(spark, [(1, f"they said {value} yesterday")], [("t", "c", value)])
    assert [(r["value"], r["source"], r["score"]) for r in rows] == [(value, value, 1.0)]


def corpus(seed, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 9))) for _ in range(30)]
    bend = lambda w: w[: rng.randrange(len(w))] + rng.choice(alphabet) + w[rng.randrange(len(w)) :]
    questions = [(i, " ".join(rng.choice([bend, str])(rng.choice(words)) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    return questions, [("t", "c", w) for w in words] + [("t", "d", f"{a} {b}") for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("seed, alphabet", [(2, "abcdeE"), (4, "abcdefghij"), (5, "aéßñdk")])
def test_properties(spark, seed, alphabet):
    questions, values = corpus(seed, alphabet)
    rows = links(spark, questions, values)
    assert rows
    asked = dict(questions)
    for r in rows:
        assert r["source"] in asked[r["question_id"]] and r["score"] >= 0.85 and r["rank"] <= 2
        assert round(r["score"], 9) == round(matching.indel_ratio(r["value"].lower(), r["source"].lower()), 9)
    # Shuffled rows and cut hot keys change nothing.
    again = links(spark, questions[::-1], random.Random(1).sample(values, len(values)), hot=5)
    assert {tuple(r.items()) for r in again} == {tuple(r.items()) for r in rows}
    # A word of the question that is a value links with score 1, unless two better ones take its place.
    best = {(r["question_id"], r["column_name"]): r["score"] for r in rows if r["rank"] == 1}
    single = {v for _, c, v in values if c == "c"}
    for i, text in questions:
        hits = [w for w in text.split() if w in single and w.lower() not in matching.STOP_WORDS and not w.isupper()]
        if hits:
            assert best[i, "c"] == 1.0


def test_words():
    words = matching.Words("'ab, cd.")
    assert words.begins == [1, 5] and words.ends == [3, 7]
    assert words.span(1, 3) == (1, 3) and words.span(0, 2) == (1, 3) and words.span(2, 3) is None and words.span(3, 6) == (5, 7)


def test_ratio():
    assert matching.indel_ratio("abcd", "abce") == 0.75 and matching.indel_ratio("", "") == 1.0
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        assert abs(matching.indel_ratio(a, b) - 2 * rows[-1][-1] / (len(a) + len(b))) < 1e-12


def test_contents_and_internal_tables(spark):
    q = spark.createDataFrame([(1, "flights to boston and denver")], "question_id int, question string")
    v = spark.createDataFrame(
        [("city", "label", "Denver"), ("city", "label", "Boston"), ("sqlite_sequence", "label", "Boston")],
        "table_name string, column_name string, value string",
    )
    rows = valuelink.column_contents(valuelink.link_values(q, v)).collect()
    assert [(r.table_name, r.contents) for r in rows] == [("city", ["Boston", "Denver"])]
    with pytest.raises(ValueError):
        valuelink.link_values(q, v, threshold=0.0)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.85])
def test_candidates_lose_no_pair(spark, threshold):
    """Every pair of a question and a value judged, against the pairs that the keys find."""
    rows, values = [], []
    for seed, alphabet in ((12, "abcdeE"), (14, "abcdefghij"), (15, "aéßñdk"), (16, "abς'.")):
        questions, found = corpus(seed, alphabet)
        rows += [(len(rows) + i, text) for i, (_, text) in enumerate(questions)]
        values += [(t, f"{c}{seed}", v) for t, c, v in found] + [("t", f"e{seed}", f"{a} {b} {c}, {d}") for (_, _, a), (_, _, b), (_, _, c), (_, _, d) in zip(found, found[3:], found[6:], found[9:])]
    rows += [(len(rows), "say\nhello world"), (len(rows) + 1, LONG[:300] + " end"), (len(rows) + 2, "")]
    values += [("t", "f", "hello worlds"), ("t", "f", LONG[:280]), ("t", "f", LONG[5:60]), ("t", "f", "ab"), ("t", "f", "hel")]
    q = spark.createDataFrame(rows, "question_id int, question string")
    v = valuelink.usable_values(spark.createDataFrame(values, "table_name string, column_name string, value string"))
    every = q.select("question_id").crossJoin(v.select("value").distinct())
    want = {(r.question_id, r.value, r.source, round(r.score, 9)) for r in valuelink.judged_pairs(every, q, threshold).collect()}
    pairs = valuelink.candidate_pairs(q, v) if threshold >= valuelink.THRESHOLD else valuelink.loose_pairs(q, v, threshold)
    got = {(r.question_id, r.value, r.source, round(r.score, 9)) for r in valuelink.judged_pairs(pairs, q, threshold).collect()}
    assert want and got == want
    if threshold < valuelink.THRESHOLD:
        again = valuelink.loose_pairs(q, v, threshold, hot=7)
        assert set(map(tuple, again.collect())) == set(map(tuple, pairs.collect())) and again.count() < every.count()


def test_binary_values(spark):
    rows = spark.createDataFrame([(bytearray("né", "utf-8"),), (bytearray("né", "latin-1"),), (None,)], "b binary")
    assert [r.value for r in column_values(rows, "t", ["b"]).collect()] == ["né"]


def test_name_repair(spark):
    # A fixed example.
    names = ["poker_player", "poker_player_id", "people_id", "final_table_made", "best_finish", "money_rank", "earnings",
             "people", "people_id", "nationality", "name", "birth_date", "height"]
    n = spark.createDataFrame([("d", i, x) for i, x in enumerate(names)], "db_id string, pos int, name string")
    log = spark.createDataFrame(
        [(1, "d", "SELECT Money_Rank FROM Poker_Player ORDER BY Earnings DESC LIMIT 1"), (2, "d", "SELECT name FROM people WHERE name = 'Nane'")],
        "log_id int, db_id string, sql string",
    )
    out = {r.log_id: r.repaired for r in repair.repair(log, n).collect()}
    assert out[1] == "SELECT money_rank FROM poker_player ORDER BY earnings DESC LIMIT 1"
    assert out[2] == "SELECT name FROM people WHERE name = 'Nane'"


def test_repair_last_or_nearest(spark):
    n = spark.createDataFrame([("d", 0, "price"), ("d", 1, "prize")], "db_id string, pos int, name string")
    log = spark.createDataFrame([(1, "d", "select pricee from t")], "log_id int, db_id string, sql string")
    assert "prize" in repair.repair(log, n).first().repaired
    assert "price " in repair.repair(log, n, nearest=True).first().repaired


def test_repair_leaves_functions_aliases_and_literals(spark):
    n = spark.createDataFrame([("d", i, x) for i, x in enumerate(["people", "id", "age", "name", "pets", "pid"])], "db_id string, pos int, name string")
    texts = [
        "SELECT T1.name , abs(T1.age) AS a FROM people AS T1 JOIN pets AS p ON T1.id = p.pid",
        "SELECT T1.nmae , abs(T1.agee) FROM poeple T1 WHERE T1.nmae = 'nmae' OR T1.nmae = \"agee\"",
        "select zzzzzzz from pets",
    ]
    log = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)] + [(9, "other", "select nmae"), (10, "d", None)], "log_id int, db_id string, sql string")
    out = {r.log_id: r.repaired for r in repair.repair(log, n, nearest=True).collect()}
    assert out[0] == texts[0] and out[2] == texts[2] and out[9] == "select nmae" and out[10] is None
    assert out[1] == "SELECT T1.name , abs(T1.age) FROM people T1 WHERE T1.name = 'nmae' OR T1.name = \"agee\""


def test_each_text_is_judged_once(spark, monkeypatch):
    """However many questions share a text; a question that comes with two texts has the links of both."""
    asked, pairs = [], valuelink.candidate_pairs
    monkeypatch.setattr(valuelink, "candidate_pairs", lambda q, *a: asked.append(q.count()) or pairs(q, *a))
    rows = [(i, "where is the green bolt") for i in range(30)] + [(3, "where is the green bolt"), (4, "and the copper ring"), (None, "green bolt")]
    questions = spark.createDataFrame(rows, "question_id int, question string")
    values = spark.createDataFrame([("t", "c", "green bolt"), ("t", "c", "copper ring")], "table_name string, column_name string, value string")
    links = valuelink.link_values(questions, values).collect()
    assert asked == [3]
    assert sorted((r.question_id, r.value) for r in links) == sorted([(i, "green bolt") for i in range(30)] + [(4, "copper ring")])


def test_few_questions_meet_the_keys_where_they_are_made(spark, monkeypatch):
    """Keys of values, many times the values, are neither written nor sent between tasks for a few questions; with more
    questions than the bound the blocked join finds the same pairs. The same value in two columns is one."""
    written, joined, cut, join = [], [], valuelink.cut, valuelink.blocked_join
    monkeypatch.setattr(valuelink, "cut", lambda df: written.append(df.columns) or cut(df))
    monkeypatch.setattr(valuelink, "blocked_join", lambda *a: joined.append(1) or join(*a))
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 30))) for _ in range(200)]
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 6)) + "x") for i in range(8)], "question_id int, question string")
    v = spark.createDataFrame([("t", c, w) for w in words for c in "ab"] + [("t", "a", " ab cd"), ("t", "a", "''")], "table_name string, column_name string, value string")
    pairs = sorted(map(tuple, valuelink.loose_pairs(q, v, 0.7).collect()))
    assert pairs and not joined and not any({"value", "key"} <= set(columns) for columns in written)
    assert sorted(map(tuple, valuelink.loose_pairs(q, v, 0.7, hot=7).collect())) == pairs and joined


def test_sizes_of_keys(spark):
    """The sizes that a value's keys have, against their definition."""
    values = spark.createDataFrame([("a" + "b" * (n - 1),) for n in range(1, 60)], "value string")
    for threshold in (0.3, 0.7):
        got = {}
        for r in valuelink.loose_value_keys(values, threshold).collect():
            got.setdefault(len(r.value), set()).add(r["size"])
        for n in range(1, 60):
            sure = -int(-(n * (threshold / (2 - threshold)) - 1e-9) // 1) - 2
            most = int((2 - threshold) / threshold * n + 1e-9) - 2
            least = max(s for s in valuelink.LOOSE_SIZES if s <= max(sure, 1))
            want = {s for s in valuelink.LOOSE_SIZES if least <= s <= min(max(most, 1), n)} if sure < valuelink.LISTED_UNDER else {least}
            assert got.get(n, set()) == want
