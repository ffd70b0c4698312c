"""Licence texts found by the Dice coefficient over word bigrams.

All DataFrame functions. Units are the whole normalised text and each of its lines; a unit
and a template can only be as similar as their sizes allow, which prunes pairs before any
bigram is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices of public licences.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "BSD": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits; everything else parts them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(ws: Column) -> Column:
    """Distinct pairs of neighbouring words of a column of words; none for fewer than two words."""
    return F.array_distinct(F.array_compact(F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row. As output of a generator, its expression is not
    copied into the filters and functions that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_table(spark, notices: dict[str, str] = NOTICES) -> DataFrame:
    """license, grams, size of each template."""
    rows = spark.createDataFrame(list(notices.items()), "license string, template string")
    rows = computed(computed(rows, "ws", words(F.col("template"))), "grams", bigrams(F.col("ws")))
    return rows.withColumn("size", F.size("grams")).where("size > 0").drop("template", "ws")


def scanned(docs: DataFrame, templates: DataFrame, least: float = 0.8, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per unit and template of Dice `least` or more: doc_id, line (0: the whole text),
    license, shared, unit_size, template_size, dice.

    `templates` is a bounded setting: sizes and bigrams of all are read once (10,000 at most).
    A unit can pass only if its size lies between least / (2 - least) and (2 - least) / least
    times that of some template, and if it has a bigram of one. Null, empty and one-word units
    have no bigrams and match nothing; repeated rows give repeated matches; of equal lines
    each is a match."""
    known = templates.select("size", "grams").limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("more than 10,000 templates")
    low, high = least / (2 - least), (2 - least) / least
    fewest, most = min((r["size"] for r in known), default=0) * low, max((r["size"] for r in known), default=0) * high
    grams = F.array(*[F.lit(g) for g in sorted({g for r in known for g in r["grams"]})]).cast("array<string>")
    lines = F.split(F.coalesce(F.col(column), F.lit("")), "\n")
    whole = F.when(F.size(lines) > 1, F.struct(F.lit(0).alias("line"), F.col(column).alias("unit")))
    each = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("unit")))
    units = docs.select(F.col(key).alias("doc_id"), F.explode(F.array_compact(F.concat(F.array(whole), each))).alias("u")).select("doc_id", "u.line", "u.unit")
    # n distinct bigrams take n + 1 words, and those 2 n + 1 characters.
    units = computed(units.where(F.length("unit") >= 2 * fewest + 1), "ws", words(F.col("unit"))).drop("unit").where(F.size("ws") > fewest)
    units = computed(units, "grams", bigrams(F.col("ws"))).drop("ws").withColumn("unit_size", F.size("grams"))
    units = units.where(F.col("unit_size").between(fewest, most)).where(F.arrays_overlap("grams", grams))
    units = units.withColumn("unit_id", F.monotonically_increasing_id())
    parts = units.select("unit_id", "doc_id", "line", "unit_size", F.explode(F.array_intersect("grams", grams)).alias("gram"))
    terms = templates.select("license", F.col("size").alias("template_size"), F.explode("grams").alias("gram"))
    pairs = parts.join(terms, (parts["gram"] == terms["gram"]) & (F.col("unit_size") >= low * F.col("template_size")) & (F.col("unit_size") <= high * F.col("template_size")))
    pairs = pairs.groupBy("unit_id", "doc_id", "line", "license", "unit_size", "template_size").agg(F.count("*").alias("shared"))
    dice = 2 * F.col("shared") / (F.col("unit_size") + F.col("template_size"))
    return pairs.withColumn("dice", dice).where(F.col("dice") >= least).drop("unit_id")
