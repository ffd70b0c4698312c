"""Connected components of a graph that is a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import cut


def contracted(links: DataFrame) -> DataFrame:
    """Links of the same components, where each task has put its own links together: every
    node of its links is linked to the smallest it reaches by them. A task holds the links of its split."""
    def run(batches):
        top = {}

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(top.setdefault(a, a)), find(top.setdefault(b, b))
                if x != y:
                    top[max(x, y)] = min(x, y)
        if schema is not None:
            nodes = list(top)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.types[0]), pa.array([find(x) for x in nodes], schema.types[1])], names=["a", "b"])

    kinds = [f"{c} {links.schema[c].dataType.simpleString()}" for c in ("a", "b")]
    return links.select("a", "b").mapInArrow(run, ", ".join(kinds))


#: Links that one task puts together, some 20 MB; more of them take rounds of joins.
FEW = 100_000


def components(links: DataFrame, most: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) of every node of `links` (a, b); a component is named by its smallest node. Links with
    a null end are none, and no links give no rows.

    Tasks first put their own links together, which leaves short paths. If no more than `few` are left, one task does the rest.
    Otherwise each round takes the smallest label of a node's neighbours and then the label of that
    label, so that distances halve about every round; every round is written. Sums over a hub's links
    are pre-aggregated in the tasks. No link or label reaches the driver."""
    links = cut(contracted(links.where("a IS NOT NULL AND b IS NOT NULL")))
    if links.count() <= few:
        return cut(contracted(links.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component")))
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("low"))
        step = labels.join(near, labels["node"] == near["n"]).select("node", F.col("component").alias("was"), F.least("component", "low").alias("now"))
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("beyond"))
        step = cut(step.join(jump, step["now"] == jump["j"], "left").select("node", "was", F.least("now", F.coalesce("beyond", "now")).alias("component")))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
    raise ValueError(f"components did not settle in {most} rounds")
