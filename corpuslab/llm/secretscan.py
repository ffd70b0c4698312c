"""Secrets in texts: fixed shapes, and strings that look random.

Two character Markov models, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a long identifier is a secret if its mean log-likelihood ratio
per transition is over a threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.rows import batched

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
HINTS = ("passw", "secret", "token", "api")
NAME = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))
LEAST = 20  # characters of an identifier that the models judge
DIVERSE = 8  # different characters that it must have: rules and padding are not random
TAUGHT = 8  # characters of an ordinary identifier that they learn from


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes, by start, then by kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest(text) >= 24:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def longest(text: str) -> int:
    """Length of the longest word; nothing looked for here has white space in it."""
    return max(map(len, text.split()), default=0)


def transitions(name: str) -> np.ndarray:
    codes = CODE[np.frombuffer(name.encode(), np.uint8)]
    return codes[:-1] * len(ALPHABET) + codes[1:]


class Ratio:
    """Log-likelihood ratio per transition, from counts (random, ordinary) by transition.

    A transition is estimated from its row of counts and `weight` times the share of its second
    character, of which `uniform` is dealt out evenly, so that what was never met is rare."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, weight: float = 10.0, uniform: float = 0.02):
        n = len(ALPHABET)

        def logs(counts):
            rows = counts.reshape(n, n)
            share = (1 - uniform) * rows.sum(0) / max(rows.sum(), 1) + uniform / n if rows.any() else np.full(n, 1 / n)
            return np.log((rows + weight * share) / (rows.sum(1, keepdims=True) + weight)).ravel()

        self.score = logs(random) - logs(ordinary)

    def of(self, name: str) -> float:
        return float(self.score[transitions(name)].mean()) if len(name) > 1 else 0.0

    def spans(self, text: str, base: list[tuple[int, int, str]], over: float) -> list[tuple[int, int, str]]:
        """Identifiers of `LEAST` characters and more that look random and meet no base span."""
        if longest(text) < LEAST:
            return []
        found = []
        for m in NAME.finditer(text):
            a, b = m.span()
            if b - a >= LEAST and len(set(m[0])) >= DIVERSE and not any(s < b and a < e for s, e, _ in base) and self.of(m[0]) > over:
                found.append((a, b, "random"))
        return found


def samples(docs: DataFrame, column: str = "text", key: str = "doc_id", most_docs: int = 20_000) -> DataFrame:
    """Labelled transitions (label, transition, n) from at most `most_docs` documents, those of
    the smallest hash of `key`: values of the fixed shapes are random strings, other
    identifiers of `TAUGHT` characters and more ordinary ones. Counted in the batches, then
    summed: at most two rows per pair of characters."""
    few = docs.select(F.xxhash64(key).alias("h")).distinct().orderBy("h").limit(most_docs)
    picked = docs.select(F.col(column).alias("text"), F.xxhash64(key).alias("h")).join(F.broadcast(few), "h", "left_semi").select("text")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            both = (Counter(), Counter())
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                for a, b, kind in base:
                    value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                    both[0].update(transitions(value.replace(".", "-")).tolist())
                for m in NAME.finditer(text or ""):
                    a, b = m.span()
                    if b - a >= TAUGHT and not any(s < b and a < e for s, e, _ in base):
                        both[1].update(transitions(m[0]).tolist())
            for label, counts in enumerate(both):
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(counts), pa.int32()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["label", "transition", "n"])

    return picked.mapInArrow(count, "label int, transition long, n long").groupBy("label", "transition").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Ratio:
    """The two models from (label: 0 random, 1 ordinary; transition; n). Bounded by the
    alphabet: 67 characters, so at most 8,978 rows reach the driver."""
    counts = np.zeros((2, len(ALPHABET) ** 2))
    for r in labelled.collect():
        counts[r["label"], r["transition"]] += r["n"]
    return Ratio(*counts)


def labelled_names(rows: DataFrame, column: str = "name", label: str = "label") -> DataFrame:
    """Samples given by hand (label: 0 random, 1 ordinary) as labelled transitions."""
    chars = f"array_join(regexp_extract_all({column}, '[A-Za-z0-9+/_=-]', 0), '')"
    pairs = rows.select(F.col(label).cast("int").alias("label"), F.expr(chars).alias("s")).where(F.length("s") > 1)
    pairs = pairs.select("label", F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> struct(instr(abc, substr(s, i, 1)) - 1 as a, instr(abc, substr(s, i + 1, 1)) - 1 as b))".replace("abc", f"'{ALPHABET}'"))).alias("p"))
    return pairs.groupBy("label", (F.col("p.a") * len(ALPHABET) + F.col("p.b")).cast("long").alias("transition")).agg(F.count("*").alias("n"))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scanned(docs: DataFrame, model: Ratio, column: str = "text", keep: list[str] | None = None, over: float = 1.0, masked: str | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end in code
    points by start, then kind) to the columns `keep` (default: all), and, if `masked` is
    given, masked_text, where each stretch of overlapping spans is replaced by that string.

    A null text is an empty one: no spans, and masked_text stays null. Row by row; a column
    of the name of a result gives way to it."""
    added = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", masked_text string" * (masked is not None)
    rank = {k: i for i, k in enumerate(KINDS)}

    def find(texts):
        out = []
        for text in texts:
            base = base_spans(text or "")
            spans = sorted(base + model.spans(text or "", base, over), key=lambda s: (s[0], rank[s[2]]))
            kinds = Counter(s[2] for s in spans)
            row = [*[kinds[k] for k in KINDS], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)]
            out.append(row if masked is None else [*row, mask(text, spans, masked)])
        return list(zip(*out)) or [[]] * (6 + (masked is not None))

    return batched(docs, {"text": column}, keep, added, find)


def mask(text: str | None, spans: list[tuple[int, int, str]], by: str) -> str | None:
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i][:2]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        parts += [text[at:start], by]
        at = end
    return "".join(parts) + text[at:]
