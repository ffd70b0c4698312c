"""Verdicts on URLs: rules for hosts and paths, and trust that spreads over the link graph.

Personalised PageRank runs twice over edges between hosts: trust goes from trusted hosts
along links, distrust from blocked hosts against them (who links to bad hosts is bad). Both
are joins and sums in Spark; each host is judged by thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import cut

#: (verdict, host, path): the path begins with a slash.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Targets of links that name a host, with or without a scheme.
LINK = r"""(?i)\shref\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""


def host(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def ruled(at: Column, way: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host and a path; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((at == domain) | at.endswith("." + domain)) & way.startswith(start)
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target, weight (links) between different hosts; counted in the tasks first."""
    links = pages.select(host(F.col(url)).alias("source"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("link"))
    target = host(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    edges = links.select("source", target.alias("target")).where("source <> '' AND target <> '' AND source <> target")
    return edges.groupBy("source", "target").agg(F.count("*").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, stay: float = 0.85, each: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank of hosts: (host, score), sums to at most 1.

    edges: source, target, weight; seeds: host, mass (sums to 1). Rank follows an edge by its share of the
    source's weight; a source without edges gives its rank up. Scores only grow from round to round. Rounds go on until
    in `each` of them no host is reached for the first time and no score grows by more than `tolerance` of itself, so the
    smallest scores are as settled as the largest. That ends: hosts are finite, and growth fades by `stay` a round. `rounds`: exactly so many instead.
    Edges are one row per pair of hosts, so a popular host costs as many rows as hosts that link to it, which
    are summed in the tasks. The ranks are written every `each` rounds."""
    total = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = cut(edges.join(total, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    begin = seeds.select("host", ((1 - stay) * F.col("mass")).alias("score"))
    if shares.isEmpty():
        return begin
    begin = ranks = cut(begin)
    done = 0
    while rounds is None or done < rounds:
        before = ranks
        for _ in range(each if rounds is None else min(each, rounds - done)):
            moved = shares.join(ranks, shares["source"] == ranks["host"]).select(F.col("target").alias("host"), (stay * F.col("share") * F.col("score")).alias("score"))
            ranks = begin.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
            done += 1
        ranks = cut(ranks)
        grown = F.col("score") - F.coalesce("was", F.lit(0.0)) > tolerance * F.col("score")
        if rounds is None and ranks.join(before.withColumnRenamed("score", "was"), "host", "left").where(grown).isEmpty():
            return ranks
    return ranks


def host_verdicts(hosts: DataFrame, edges: DataFrame, least: float = 0.5, **walk) -> DataFrame:
    """host, trust, distrust, verdict of every host of `hosts` (host, allowed, blocked: pages that a
    rule allows or blocks).

    A host is a trusted seed if more of its pages are allowed than blocked, a blocked one in the
    other case. Block if distrust makes up more than `least` of the host's trust and distrust, however small both
    are: scores shrink with the number of seeds; else allow. Hosts that no seed reaches are allowed."""
    hosts = cut(hosts)
    lean = F.col("allowed") - F.col("blocked")

    def seeds(side: Column) -> DataFrame:
        picked = hosts.where(side)
        n = picked.count()
        return picked.select("host", F.lit(1.0 / max(n, 1)).alias("mass"))

    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    trust = spread(edges, seeds(lean > 0), **walk).withColumnRenamed("score", "trust")
    distrust = spread(back, seeds(lean < 0), **walk).withColumnRenamed("score", "distrust")
    out = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > least * (F.col("trust") + F.col("distrust"))
    return out.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of `pages`.

    A rule's verdict stands; else that of the host. Rows without :// (null ones too) have an empty host and
    path, no rule, and are allowed; a null html has no links. An empty table gives an empty result, and other columns take no part, whatever their names. Repeated rows give repeated results. Hosts are counted in
    the tasks first; the table of hosts is joined back by host, where Spark splits a hot one."""
    at = host(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), at.alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    hosts = rows.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
    edges = cut(host_edges(pages, url, html))
    names = edges.select(F.col("target").alias("host")).distinct().join(hosts, "host", "left_anti")
    every = hosts.unionByName(names.withColumn("allowed", F.lit(0)).withColumn("blocked", F.lit(0)))
    verdicts = cut(host_verdicts(every, edges, **limits))
    out = rows.join(verdicts, "host", "left").na.fill(0.0, ["trust", "distrust"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
