"""Quality rules of documents and of the hosts that they come from.

Rules count failures by document; failures are aggregated by host; a host's failure rates are
shrunk towards the rate of all hosts by an empirical beta prior, so that a host of few
documents is judged by them only as far as they say anything; verdicts of hosts are joined
back to their documents.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.rows import batched
from corpuslab.session import cut

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Rules whose failures count against a host; of columns of `STATS`.
RULES = {
    "base": "base_failed",
    "symbols": "n_symbols > 0.3 * word_chars",
    "lines": "n_dup_lines > 0.5 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}


def text_stats(text: str | None) -> tuple[int, ...]:
    """Values of `STATS` for one whole text; null counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    n, seen = len(words), set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > 3:
        ids: dict[str, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        pairs = a[:-1] * len(ids) + a[1:]
        if len(ids) > 1 << 20:  # so that three words fit in 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + a[2:]
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if twice.any():
            marked = np.zeros(n, bool)
            for at in range(3):
                marked[at : n - 2 + at] |= twice
            repeated = int(marked.sum())
    return n, sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), lines, dup, repeated


def with_stats(docs: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `STATS` and base_failed (under 50 words, or more than half of the words repeat in
    windows of three) to the columns `keep` (default: all). A column of such a name gives way."""
    out = batched(docs, {"text": column}, keep, STATS, lambda texts: list(zip(*map(text_stats, texts))) or [[]] * 6)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(stats: DataFrame, host: str, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per host (null is none): n_docs, and for each rule its failures and the shrunk
    rate (failures + a) / (n_docs + a + b).

    a and b are fitted by moments to the rates of all hosts: their mean, and their variance
    beyond what binomial noise gives. Without such excess hosts do not differ, and all get
    the mean. Counting is pre-aggregated in the tasks, so a hot host costs one row a task; one
    row of sums goes to the driver."""
    hosts = stats.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(F.expr(f"int({rule})")).alias(f"fail_{r}") for r, rule in rules.items()]
    )
    hosts = cut(hosts)
    rate = {r: F.col(f"fail_{r}") / F.col("n_docs") for r in rules}
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.avg(1 / F.col("n_docs")).alias("noise"),
        *[F.avg(x).alias(f"mean_{r}") for r, x in rate.items()], *[F.avg(x * x).alias(f"square_{r}") for r, x in rate.items()],
    ).first()
    for r in rules:
        a, b = beta_prior(sums["hosts"], sums["noise"], sums[f"mean_{r}"], sums[f"square_{r}"])
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b)))
    return hosts


def beta_prior(hosts: int, noise: float | None, mean: float | None, square: float | None) -> tuple[float, float]:
    """a and b from the number of hosts, the mean of 1 / documents, of rates and of their squares."""
    if not hosts or mean in (0.0, 1.0):
        mean, weight = (0.5 if not hosts else mean), 2.0
    else:
        # A rate's variance is between * (1 - noise) + mean (1 - mean) noise.
        spread = mean * (1 - mean)
        between = (square - mean * mean - spread * noise) / max(1 - noise, 1e-9)
        share = min(max(between / spread, 1e-6), 1 - 1e-6)
        weight = 1 / share - 1
    return mean * weight, (1 - mean) * weight


def judged(docs: DataFrame, host: str = "source", column: str = "text", keep: list[str] | None = None, most: float = 0.75, rules: dict[str, str] = RULES) -> DataFrame:
    """Documents with `STATS`, base_failed, host_rate (the worst shrunk rate of its host),
    host_rejected (that is over `most`) and kept: neither base_failed nor host_rejected.

    Null and empty texts have no words and fail. A document without a host is judged by its
    own text alone. Repeated rows each count and each come back. Empty tables give empty
    ones. Statistics are written once and read for both uses, so texts are scanned once; where the texts themselves are
    kept, they are scanned twice instead, as what is written would be as large as the documents."""
    keep = docs.columns if keep is None else keep
    stats = with_stats(docs, column, keep if host in keep else [*keep, host])
    if column in keep:
        counted = with_stats(docs, column, [host])
    else:
        counted = stats = cut(stats)
    hosts = host_rates(counted, host, rules).select(F.col("host").alias("host__"), F.greatest(*[F.col(f"rate_{r}") for r in rules], F.lit(0.0)).alias("host_rate"))
    stats = stats.drop("host_rate", "host_rejected", "kept")
    out = stats.join(hosts, stats[host] == hosts["host__"], "left").drop("host__")
    out = out.withColumn("host_rejected", F.coalesce(F.col("host_rate") > most, F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return out if host in keep else out.drop(host)
