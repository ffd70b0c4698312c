"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpuslab
from corpuslab.llm import chat, graph, licenses, linkgraph, neardup, quality, secretscan, tiling, tokencount, warc, wordbpe
from corpuslab.session import cut, new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row int, a string"
WORD_BPE, PIECE_BPE = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "piece_bpe_32k.model"))
PROSE = " ".join(f"word{i} thing{i * 7 % 31}" for i in range(60))
SECRET = "0f" * 20


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows; the columns n_words, row and a have names that operators use themselves."""
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "one", 5: PROSE, 6: PROSE, 7: PROSE + f'\ntoken = "{SECRET}"', 8: "x" * 30_000 + " é日本🙂 <|endoftext|>",
        9: "ab cd " * 20_000, None: PROSE + " other end", 10: "Licensed under CC BY-NC 4.0.",
    }
    rows = [(i, t, None, None if i == 4 else "s", None, "mine", 1, "b") for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[4], rows[4]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_quality(docs, empty):
    out = by_id(quality.judged(docs))
    assert out[1]["n_words"] == out[2]["n_words"] == out[3]["n_words"] == 0 and out[1]["base_failed"]
    assert out[4]["host_rate"] is None and not out[4]["host_rejected"]
    assert out[5]["n_words"] == 120 and out[9]["n_repeat_words"] == 40_000 and out[9]["base_failed"]
    assert quality.judged(docs).count() == 13 and quality.judged(docs).columns.count("n_words") == 1
    assert quality.judged(empty).count() == 0


def test_hosts(spark):
    """A host of many bad documents is rejected with its good ones; one bad document is no bad host."""
    good, bad = PROSE, "bad bad bad"
    rows = [(i, good if i % 20 == 0 else bad, "spam") for i in range(400)] + [(1000 + i, bad if i == 0 else good, f"h{i % 40}") for i in range(400)]
    rows += [(2000, bad, "single")]
    out = by_id(quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not out[0]["kept"] and out[0]["host_rejected"] and out[1001]["kept"]
    assert out[2000]["host_rate"] < out[0]["host_rate"] and not out[2000]["kept"]


def test_beta_prior():
    rng = np.random.default_rng(5)
    n, rates = 50, rng.beta(2, 6, 4000)
    got = rng.binomial(n, rates) / n
    a, b = quality.beta_prior(4000, 1 / n, got.mean(), (got**2).mean())
    assert abs(a - 2) < 0.3 and abs(b - 6) < 0.9
    assert quality.beta_prior(0, None, None, None) == (1.0, 1.0)


def test_secrets(docs, empty, spark):
    model = secretscan.train(secretscan.samples(docs))
    rows = secretscan.scanned(docs, model, masked="[X]")
    out = by_id(rows)
    assert rows.count() == 13
    at = len(PROSE) + 1
    assert out[7]["spans"] == f"assign:{at}:{at + 49},hex:{at + 9}:{at + 49}" and out[7]["masked_text"] == f'{PROSE}\n[X]"'
    assert out[1]["spans"] == "" and out[1]["masked_text"] is None and out[5]["masked_text"] == PROSE
    assert secretscan.scanned(empty, secretscan.train(secretscan.samples(empty))).count() == 0


def test_markov(spark):
    """Held-out strings: random ones are told from identifiers."""
    rng = random.Random(4)
    parts = "get set user name index value table column parse write batch result count token limit stage driver config reader merge".split()
    name = lambda: "_".join(rng.choice(parts) for _ in range(5))
    noise = lambda: "".join(rng.choice(secretscan.ALPHABET[:62]) for _ in range(32))
    rows = [(noise(), 0) for _ in range(600)] + [(name(), 1) for _ in range(600)]
    model = secretscan.train(secretscan.labelled_names(spark.createDataFrame(rows, "name string, label int")))
    right = sum(model.of(noise()) > 1 for _ in range(300)) + sum(model.of(name()) <= 1 for _ in range(300))
    assert right >= 594
    text = f"see {noise()} and {name()}"
    assert [s[2] for s in model.spans(text, [], 1.0)] == ["random"]


def test_warc(spark):
    long = "é" * 600
    pages = [(1, "http://a/x", long), (2, None, long), (2, None, long), (None, "http://b", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("refers_to", F.lit(2))
    place = new_folder(spark, "warc-test")
    files = warc.written(warc.captures(df), place)
    out = warc.assembled(warc.records(files, place)).collect()
    assert sum(r["copies"] for r in out) == 8
    by = {r["page"]: r for r in out}
    assert by[2]["copies"] == 2 and by[2]["response"]["type"] == "response" and bytes(by[2]["response"]["payload"]).decode() == long
    assert by[1]["refers_to_page"] == 2 and by[None]["refers_to_page"] == 2 and by[1]["response"]["payload_bytes"] == 1200
    assert by[4]["response"]["type"] == by[5]["response"]["type"] == "response" and by[6]["response"]["payload_bytes"] == 0
    assert by[7]["response"]["payload_bytes"] == 300_000 and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in out)
    none = warc.written(warc.captures(df.where("false")), new_folder(spark, "warc-none"))
    assert warc.assembled(warc.records(none, place)).count() == 0


def test_warc_reads_plain_archives(spark):
    """Files of one gzip member for all records, with records that belong to no capture."""
    import gzip
    import os

    place = new_folder(spark, "warc-plain")
    os.makedirs(place.removeprefix("file://"))
    file = place.removeprefix("file://") + "/x.warc.gz"
    with gzip.open(file, "wb") as f:
        f.write(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
        f.write(b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <gone>\r\nContent-Length: 9\r\n\r\npageId: 3\r\n\r\n")
    out = {r["capture_id"]: r for r in warc.assembled(warc.records(spark.createDataFrame([(file,)], "file string"), place)).collect()}
    assert out["<gone>"]["page"] == 3 and out["<gone>"]["response"] is None and "<i>" in out


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_BPE)
    rows = wordbpe.encode(docs, WORD_BPE)
    for r in rows.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["bpe_ids"] == ids and r["bpe_decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert rows.count() == 13 and wordbpe.encode(empty, WORD_BPE).count() == 0


ODD = ["a", "b", "th", "ing", "tion", "the", " ", "  ", "'s", "é", "é", "ß", "Σ", "İ", "1", "23", "!", "<|endoftext|>", "<|", "\n", "\x1c", "\x85", "​", "日", "한", "🙂", "́", "A", "$$", "_", "½", "\x00", "</w>", "<s>", "▁", "\t"]


def test_bpe_of_odd_texts():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(11)
    mine, lib = wordbpe.WordBPE(open(WORD_BPE, encoding="utf-8").read()), Tokenizer.from_file(WORD_BPE)
    pieces, ref = tokencount.PieceCounter(open(PIECE_BPE, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))
        got, want = mine.both(text), lib.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == got[0] and mine.decode(got[0]) == got[1] == lib.decode(want, skip_special_tokens=False), text
        assert list(np.frombuffer(got[0], "<u4")) == want, text
        assert pieces.count(text) == len(ref.encode(text)), text
    for _ in range(60):
        text = "".join(rng.choice(ODD) for _ in range(10))
        table = pieces.prefixes(text)
        assert table == [len(ref.encode(text[:i])) for i in range(len(text) + 1)], text
        assert pieces.cut(text, 5) == max(i for i, n in enumerate(table) if n <= 5)


def test_token_counts(docs, empty):
    out = by_id(tokencount.counts(docs, PIECE_BPE, 100))
    assert (out[1]["n_tokens"], out[1]["n_bytes"], out[1]["over_limit"]) == (0, 0, False) and out[8]["over_limit"]
    cut_rows = by_id(tokencount.truncated(docs, PIECE_BPE, 10))
    assert PROSE.startswith(cut_rows[5]["cut_text"]) and cut_rows[5]["cut_tokens"] <= 10 and cut_rows[1]["cut_text"] == ""
    assert len(by_id(tokencount.prefix_counts(docs, PIECE_BPE))[5]["prefix_tokens"]) == len(PROSE) + 1
    assert tokencount.counts(empty, PIECE_BPE, 1).count() == 0


SCHEMAS = {"add": {"x": {"type": "number", "required": True, "minimum": 0, "maximum": 9}, "how": {"type": "string", "enum": ["up", "down"]}}}


def test_chat(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "add", '{"x": 1, "how": "up"}', []), (1, 1, "b", "add", '{"how":"left", "x": 10}', ["a", "nowhere"]), (1, 2, "c", "add", "{", ["b", "a"]),
            (1, 3, "d", "sub", '{"x": "1", "b": {"d": 1, "c": [1, 2]}}', ["e"]), (1, 4, "e", "add", '{"x": "1", "z": null}', ["d"]), (1, 5, None, None, None, None),
            (1, 0, "a", "add", '{"x": 1, "how": "up"}', []),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("a", "two"), ("a", "one"), ("zz", "x"), (None, "y"), ("b", None)], "call_id string, text string")
    rows = chat.formatted(calls, results, SCHEMAS).collect()
    out = {r["call_id"]: r for r in rows}
    assert len(rows) == 7 and {k: r["level"] for k, r in out.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, None: None}
    assert out["a"]["result"]["text"] == "one" and out["a"]["n_results"] == 2 and out["a"]["valid"]
    assert out["b"]["errors"] == ["how not allowed", "x too large"] and out["c"]["errors"] == ["arguments are no object"]
    assert out["d"]["errors"] == ["unknown tool"] and out["e"]["errors"] == ["surplus z", "type of x"] and not out[None]["valid"]
    assert out["d"]["call_json"] == '{"arguments":{"b":{"c":[1,2],"d":1},"x":"1"},"id":"d","level":null,"name":"sub","result":null}'
    for r in rows:
        body = json.loads(r["call_json"])
        assert json.dumps(body, sort_keys=True, separators=(",", ":")) == r["call_json"]
    assert chat.formatted(calls.where("false"), results, SCHEMAS).count() == 0


def test_chat_names_that_clash(spark):
    calls = spark.createDataFrame([(1, 0, "a", "add", '{"x": 1}', ["b"])], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("a", "one")], "call_id string, text string")
    want = chat.formatted(calls, results, SCHEMAS).first().asDict()
    for name in ("level", "valid", "call_json", "result", "n_results", "errors", "arguments_json"):
        calls = calls.withColumn(name, F.lit("x"))
    assert chat.formatted(calls, results, SCHEMAS).first().asDict() == want


def test_levels(spark):
    """Chains by doubling, anything else by rounds: both against a plain walk, with cycles and ends that lead into them."""
    rng = random.Random(9)
    for most in (1, 3):
        needs = {str(i): [str(rng.choice([i - 1, i - 1, rng.randrange(300), 999]))] if most == 1 else [str(rng.choice([i - 1, i + 1] if rng.random() < 0.05 else [rng.randrange(max(i, 1)), 999])) for _ in range(rng.randint(0, 3))] for i in range(300)}
        needs |= {"0": [], "298": ["299"], "299": ["298"], "297": ["298"]}
        level = {}
        for _ in range(301):
            for k, deps in needs.items():
                known = [d for d in deps if d in needs]
                if k not in level and all(d in level for d in known):
                    level[k] = max((level[d] + 1 for d in known), default=0)
        df = spark.createDataFrame([(k, v) for k, v in needs.items()] + [(None, ["1"])], "call_id string, depends_on array<string>")
        got = {r["call_id"]: r["level"] for r in chat.levels(df).collect()}
        assert got == {k: level.get(k) for k in needs} and None in got.values()
    long = spark.range(20_000).select(F.col("id").cast("string").alias("call_id"), F.array((F.col("id") - 1).cast("string")).alias("depends_on"))
    assert chat.levels(long).where("level <> cast(call_id as int) OR level IS NULL").isEmpty()


def test_licenses(docs, empty, spark):
    templates = licenses.template_table(spark)
    found = licenses.scanned(docs, templates).collect()
    assert {(r["doc_id"], r["line"], r["license"]) for r in found} >= {(10, 1, "CC-BY-NC-4.0")}
    assert licenses.scanned(empty, templates).count() == 0
    rng, vocab = random.Random(2), "licensed under the apache license version 2 0 mit released public".split()
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for _ in range(300)] + list(licenses.NOTICES.values())
    grams = lambda t: {p for w in ["".join(c if c.isalnum() else " " for c in t.lower()).split()] for p in zip(w, w[1:])}
    want = {
        (i, n) for i, t in enumerate(texts) for n, u in licenses.NOTICES.items()
        if grams(t) and grams(u) and 2 * len(grams(t) & grams(u)) / (len(grams(t)) + len(grams(u))) >= 0.6
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["license"]) for r in licenses.scanned(df, templates, least=0.6).collect()} == want and want


def test_near_duplicates(docs, empty):
    rows = neardup.grouped(docs, size=3, percent=85).collect()
    assert len(rows) == 13
    out = {r["doc_id"]: r for r in rows}
    assert (out[1]["n_shingles"], out[1]["component_id"], out[1]["kept"]) == (0, 1, True) and out[4]["n_shingles"] == 1
    assert out[5]["kept"] and not out[6]["kept"] and out[6]["component_id"] == out[7]["component_id"] == out[None]["component_id"] == 5
    assert not out[None]["kept"] and neardup.grouped(empty).count() == 0
    left = neardup.thinned(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 5, 8, 9, 10]


def test_one_row_of_each_group_stays(spark):
    """Rows repeated under one id, groups without any id, one id with several texts, texts without words."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 40 + [(2, text)] * 3 + [(1, text + " more")] + [(None, text.upper().replace("W", "v"))] * 5 + [(None, text.replace("w", "z")), (3, text.replace("w", "z"))]
    rows += [(7, None), (7, None), (8, ""), (9, "alone " * 20), (9, "alone " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.monotonically_increasing_id()).repartition(6)
    left = [(r["doc_id"], (r["text"] or "")[:3]) for r in neardup.thinned(df).collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [(1, "w0 "), (None, "v0 "), (3, "z0 "), (7, ""), (7, ""), (8, ""), (9, "alo")]))
    assert neardup.thinned(df).columns == df.columns


@pytest.mark.parametrize("small", [256, 4])
def test_near_duplicates_brute(spark, monkeypatch, small):
    """Groups of copies around the threshold; with small nodes also by pivots, branching and blocks."""
    from test_contracts import slow_components, slow_shingles

    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", small)
    rng, texts = random.Random(8), []
    for g in range(14):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 5, 40, 80]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 9)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_components({i: slow_shingles(t, 3) for i, t in enumerate(texts)}, 85)
    got = {r["doc_id"]: r["component_id"] for r in neardup.grouped(df, 3, 85).collect()}
    assert got == want


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """400 documents share a passage, so their nodes are large; only the two of a pair are at the
    threshold. In this family no branch is left that 59 of the pairs follow together."""
    monkeypatch.setattr(neardup, "BLOCK", 150)
    passage = " ".join(f"p20x{i}" for i in range(700))
    rows = []
    for i in range(200):
        both = " ".join(f"c20x{i}x{k}" for k in range(10))
        rows += [(2 * i + e, f"{passage} {both} " + " ".join(f"u20x{i}x{e}x{k}" for k in range(60))) for e in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.grouped(df, size=1, percent=85).collect()}
    assert got == {i: i - i % 2 for i in range(400)}


def test_near_duplicates_of_near_misses(spark, monkeypatch):
    """120 variants of a text are just under the threshold of each other, and two more are over it of the first. The candidates
    of large nodes are tested in parcels, also in very small ones."""
    for name, value in {"SMALL": 8, "PAIRS": 200, "STRIP": 16, "ITEMS": 8000}.items():
        monkeypatch.setattr(neardup, name, value)
    # By value, so that the workers see these bounds.
    cloudpickle.register_pickle_by_value(corpuslab)
    parcels, piled = [], neardup.Join.confirm_parcels
    monkeypatch.setattr(neardup.Join, "confirm_parcels", lambda self, rows: parcels.append(cut(rows)) or piled(self, parcels[-1]))
    rng, rows = random.Random(3), []
    for i in range(120):
        words = [f"m21x{k}" for k in range(200)]
        for k in rng.sample(range(200), 12):
            words[k] = f"m21x{i}x{k}"
        rows.append(words)
    rows += [rows[0][:-j] + [f"m21e{j}"] for j in (1, 2)]
    df = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.grouped(df, size=1, percent=85).collect()}
    assert got == {i: i if i < 120 else 0 for i in range(122)}
    many, members, pairs = parcels[0].selectExpr("count(*)", "sum(size(members))", "sum(size(pairs)) / 2").first()
    assert many > 20 and members < pairs / 2


def test_parcels(monkeypatch):
    """Every pair is in one parcel, and parcels have few members for their pairs, within their bounds."""
    for name, value in {"PAIRS": 200, "STRIP": 16, "ITEMS": 2000}.items():
        monkeypatch.setattr(neardup, name, value)
    a, b = np.triu_indices(100, 1)
    parts = neardup.parcelled(a, b, np.full(100, 50))
    members = [len(np.union1d(a[p], b[p])) for p in parts]
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(a)))
    assert max(map(len, parts)) <= 200 and max(members) <= 40 and sum(members) < len(a) / 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(70)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    links = spark.createDataFrame([*chain, (None, 3), (4, None)], "a long, b long")
    out = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert {r["node"]: r["component"] for r in graph.components(links, few=0).collect()} == out and graph.components(links.limit(0)).isEmpty()
    assert all(out[i] == 0 for i in range(71)) and all(out[i] == 100 for i in range(100, 160)) and out[201] == 200


def slow_cover(item, doc, least):
    """Greedy string tiling by looking for the longest match again and again."""
    fi, fd, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and fi[i + k] and fd[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        for x in range(k):
            fi[i + x] = fd[j + x] = False
        covered += k


def test_tiles():
    rng = random.Random(6)
    for _ in range(300):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))] + rng.choice([item, item[10:] + item[:10], item[:9]]) + [rng.choice("abc")]
        found = tiling.tiles(tiling.hashed(item), tiling.hashed(doc), 3)
        used_i, used_d = [], []
        for i, j, k in found:
            assert item[i : i + k] == doc[j : j + k] and k >= 3
            used_i += range(i, i + k)
            used_d += range(j, j + k)
        assert len(set(used_i)) == len(used_i) and len(set(used_d)) == len(used_d)
        # Of matches of one length either may be marked first, so totals can differ by some words.
        assert abs(len(used_i) - slow_cover(item, doc, 3)) <= 6


def test_decontamination(docs, empty, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (None, "two words"), (4, "never met in any text of these")], "item_id long, text string")
    extra = spark.createDataFrame(
        [(20, "X " + " ".join(item[6:] + ["and"] + item[:6]) + " y"), (21, " ".join(item[:6])), (22, "Alpha, beta gamma delta epsilon ZETA eta theta iota kappa other mu"), (23, "here are two words")],
        "doc_id long, text string",
    )
    every = docs.unionByName(extra, allowMissingColumns=True)
    rows = tiling.leaks(every, bench).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in rows) == [(20, 1), (20, 1), (22, 1), (22, 1), (23, 0)]
    left = tiling.cleaned(every, bench)
    assert left.columns == docs.columns and left.count() == 14
    assert tiling.leaks(empty, bench).count() == 0 and tiling.cleaned(docs, bench.where("false")).count() == 13


def test_url_parts(spark):
    urls = [None, "", "no scheme", "http://A.Net", "x://net/", "http://h?x/y#z", "a://b://c/d", "HTTP://Ä.Example.COM/de/x?y", "http://example.net/en/", "http://sub.example.net/en", "http://org/fr/", "http://notorg/fr/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit(1))
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in linkgraph.judged(pages).collect()}
    assert out[0] == out[1] == out[2] == ("", "", None, "allow") and out[3][:3] == ("a.net", "", None) and out[4] == ("net", "/", "net/", "block")
    assert out[5][:2] == ("h", "") and out[6][:2] == ("b:", "//c/d") and out[7][:3] == ("Ä.example.com", "/de/x", "example.com/de/")
    assert out[8][2:] == ("example.net/en/", "allow") and out[9][2:] == ("net/", "block") and out[10][2:] == ("org/fr/", "allow") and out[11][2] is None
    assert linkgraph.judged(pages.where("false")).count() == 0


def test_page_rank(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 2), ("c", "a", 1), ("d", "c", 1)]
    got = {r["host"]: r["score"] for r in linkgraph.spread(spark.createDataFrame(edges, "source string, target string, weight long"), spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, mass double"), rounds=40).collect()}
    names, p = "abcd", np.zeros((4, 4))
    for s, t, w in edges:
        p["abcd".index(s), "abcd".index(t)] = w / sum(e[2] for e in edges if e[0] == s)
    seed = np.array([0.5, 0, 0, 0.5])
    want = np.linalg.solve(np.eye(4) - 0.85 * p.T, 0.15 * seed)
    assert all(abs(got[n] - want[i]) < 2e-3 for i, n in enumerate(names))


def test_distrust_flows_back(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a class=x href="{u}">t</a>' for u in links))
    pages = [
        page(1, "http://bad.net/x"), page(2, "http://friend.test/", "http://bad.net/x", "//bad.net/y"), page(3, "http://good.example.net/en/a", "https://liked.test/q"),
        page(4, "http://liked.test/"), page(5, "http://alone.test/", "/own"), page(6, "http://friend.test/other"),
    ]
    out = {r["page_id"]: r["verdict"] for r in linkgraph.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_verdicts_of_a_graph_copied_many_times(spark):
    """b is blocked; y and 1,999 more link to b, x and 1,999 more to y. Copies of the graph keep its verdicts."""
    def verdicts(copies):
        many = spark.range(copies).select(F.concat(F.lit("."), "id").alias("copy")).crossJoin(spark.range(2000).withColumnRenamed("id", "i"))
        fans = many.select(F.explode(F.array(*[F.struct(F.when(F.col("i") == 0, first).otherwise(F.concat(F.lit(first), F.lit("-"), "i")).alias("s"), F.lit(to).alias("t")) for first, to in (("y", "b"), ("x", "y"))])).alias("e"), "copy")
        edges = cut(fans.select(F.concat("e.s", "copy").alias("source"), F.concat("e.t", "copy").alias("target"), F.lit(1).alias("weight")))
        hosts = edges.select(F.col("source").alias("host")).unionByName(edges.select(F.col("target").alias("host"))).distinct()
        out = linkgraph.host_verdicts(hosts.withColumn("allowed", F.lit(0)).withColumn("blocked", F.col("host").startswith("b").cast("int")), edges)
        return {r["host_verdict"]: r["n"] for r in out.groupBy("host_verdict").agg(F.count("*").alias("n")).collect()}

    assert verdicts(1) == {"block": 4001}
    assert verdicts(40) == {"block": 40 * 4001}


def test_query_on_pages_that_link(spark, tmp_path):
    """The registered query and its SQL form on pages whose links cross hosts, against the linear solve."""
    import duckdb
    from corpuslab.llm.oracles import ORACLES
    from corpuslab.llm.queries import QUERIES

    names = [f"h{i}.example" for i in range(8)] + ["a.org", "b.net", "c.net", "d.org"]
    rng, rows, links = random.Random(3), [], {}
    for i in range(120):
        at = rng.choice(names)
        to = [rng.choice(names) for _ in range(rng.randint(0, 3))]
        way = "/fr/x" if at.endswith("org") else "/x"
        rows.append((i, f"http://{at}{way}", "".join(f'<a href="{rng.choice(["http:", "//"[:0], "https:"])}//{t}/p">' for t in to)))
        for t in to:
            if t != at:
                links[at, t] = links.get((at, t), 0) + 1
    rows += [(200, None, None), (201, "no scheme", "<a href='http://a.org/'>"), (202, "http://lone.example/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("score", F.lit(1)).withColumn("host", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    got = [r.asDict() for r in QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    k = len(names)

    def ranks(edges, seeds):
        p = np.zeros((k, k))
        for (s, t), w in edges.items():
            p[names.index(s), names.index(t)] = w / sum(x for (a, _), x in edges.items() if a == s)
        mass = np.array([n in seeds for n in names], float) / max(len(seeds), 1)
        return dict(zip(names, np.linalg.solve(np.eye(k) - 0.85 * p.T, 0.15 * mass)))

    present = {r[1].split("/")[2] for r in rows[:120]}
    good = ranks(links, [n for n in names if n.endswith("org") and n in present])
    bad = ranks({(t, s): w for (s, t), w in links.items()}, [n for n in names if n.endswith("net") and n in present])
    for r in got:
        if r["host"] in names:
            assert abs(r["trust"] - good[r["host"]]) < 1e-5 and abs(r["distrust"] - bad[r["host"]]) < 1e-5
            assert r["rule"] or r["verdict"] == ("block" if bad[r["host"]] > good[r["host"]] else "allow")
        elif r["host"] != "lone.example":
            assert (r["host"], r["rule"], r["verdict"]) == ("", None, "allow")
    assert {r["verdict"] for r in got if not r["rule"] and r["host"] in names} == {"allow", "block"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    res = con.sql(ORACLES["op10_url_filter"])
    want = {r["page_id"]: r for r in (dict(zip(res.columns, x)) for x in res.fetchall())}
    for r in got:
        w = want[r["page_id"]]
        assert all(r[c] == w[c] for c in ("host", "path", "rule", "verdict")) and abs(r["trust"] - w["trust"]) < 1e-5 and abs(r["distrust"] - w["distrust"]) < 1e-5


def test_ranks_settle(spark):
    """Defaults on a chain of 40 hosts towards a blocked one, and against the linear solve on a ring with chords."""
    hosts = spark.createDataFrame([(f"h{i:02}", 0, int(i == 0)) for i in range(41)], "host string, allowed long, blocked long")
    edge = "source string, target string, weight long"
    chain = spark.createDataFrame([(f"h{i + 1:02}", f"h{i:02}", 1) for i in range(40)], edge)
    out = {r["host"]: (r["host_verdict"], r["distrust"]) for r in linkgraph.host_verdicts(hosts, chain).collect()}
    assert all(out[f"h{i:02}"][0] == "block" and abs(out[f"h{i:02}"][1] / (0.15 * 0.85**i) - 1) < 1e-9 for i in range(41))
    assert linkgraph.spread(chain, spark.createDataFrame([("h40", 1.0)], "host string, mass double"), rounds=12).count() == 13
    links, p = [(i, (i + 1) % 9, 2) for i in range(9)] + [(4, 1, 1), (7, 2, 3)], np.zeros((9, 9))
    for s, t, w in links:
        p[s, t] = w / sum(e[2] for e in links if e[0] == s)
    want = np.linalg.solve(np.eye(9) - 0.85 * p.T, 0.15 * np.eye(9)[0])
    got = linkgraph.spread(spark.createDataFrame([(f"n{s}", f"n{t}", w) for s, t, w in links], edge), spark.createDataFrame([("n0", 1.0)], "host string, mass double"))
    assert all(abs(r["score"] / want[int(r["host"][1:])] - 1) < 1e-5 for r in got.collect()) and got.count() == 9
