"""Linking question spans to column values by fuzzy match.

The rule compares every question with every value. Here candidate pairs come from an
equi-join that loses no match, and only they are judged. With L the length of the value
and S that of the question's span, a ratio of at least 0.85 means S >= 17/23 L.

Values of six characters and more: the span begins at a word start and, but for at most
two characters at its end, is a part of the value. So its first g = ceil(17/23 L) - 2
characters stand in the value, no later than at place L - ceil(17/23 L) + 2, and they
begin with the value's own first letter (or with white space that is no separator). The
join key is a hash of g characters, g rounded down to one of a few sizes. Small keys
meet often by chance; there the question's key carries its whole span, and the pair goes
on only if the edit distance, never above the insertions and deletions, allows the ratio.

Shorter values: at most one character is inserted or deleted. The keys are the text
itself and the text without one character, of the value as of every short span between
word boundaries.

Lower thresholds t: S >= t / (2 - t) L, and the span but for its last two characters is a part of the value still. Values
whose least span is long are found as above. For the others every span of whole words that such a value allows is
listed; its key is its beginning, of the largest size that the common part is sure to have, and a value has keys of all
sizes that its spans may have.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.matching import COMMON_WORDS, KEY_TERMS, LOOK_AHEAD, SEPARATORS, STOP_WORDS, Words, compared, fold_case
from corpuslab.functions.sqltext import strip
from corpuslab.operators.skew import HOT_ROWS, blocked_join
from corpuslab.session import cut

# Fixed values.
THRESHOLD, TOP_K = 0.85, 2
INTERNAL_TABLES = ["sqlite_sequence"]
# 3, 4, 6, 8, 12, 16, .. : key sizes.
KEY_SIZES = sorted({2**k for k in range(2, 21)} | {3 * 2**k for k in range(0, 20)})

SHORT, SHORT_SPAN = 5, 6
# Keys up to this size carry their span; values under them have at most 17 characters
# and their spans at most 23.
SPAN_KEYS, LONGEST_SPAN = 8, 23
# Key sizes for any threshold; values are sought by listed spans if a common part may be shorter than this.
LOOSE_SIZES = sorted({1, 2, *KEY_SIZES})
LISTED_UNDER = 12
#: Keys of questions, with their spans, that are sent to all tasks: some 30 MB at most.
FEW_ASKED = 300_000
# White space as Unicode has it.
WHITE = [chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def _fold(text: Column) -> Column:
    """Lower case for keys. Both sides are folded alike, so equal stays equal."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ς", "σ")


def _needed(length: Column) -> Column:
    return F.ceil(length * 17 / 23).cast("int")


def _key_size(length: Column) -> Column:
    """0 stands for the short rule."""
    sizes = F.array(*[F.lit(s) for s in KEY_SIZES])
    fitting = F.array_max(F.filter(sizes, lambda s: s <= _needed(length) - 2))
    return F.when(length <= SHORT, F.lit(0)).otherwise(fitting)


def _one_less(text: Column) -> Column:
    """The text, and the text without each one of its characters."""
    cuts = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)),
    )
    return F.concat(F.array(text), cuts)


def usable_values(values: DataFrame) -> DataFrame:
    """Values that can match at all: two characters or more, no stop word or key term,
    not from an internal table."""
    low = F.lower("value")
    return (
        values.where(~F.col("table_name").isin(INTERNAL_TABLES))
        .withColumn("value", strip(F.col("value")))
        .where((F.length("value") >= 2) & ~low.isin(*sorted(STOP_WORDS | KEY_TERMS)))
        .distinct()
    )


def value_keys(values: DataFrame) -> DataFrame:
    """(value, size, key): the keys under which a value may be found."""
    v = F.col("_v")
    sized = (
        values.select("value").distinct().withColumn("_v", _fold(F.col("value")))
        .withColumn("size", _key_size(F.length("_v")))
        .withColumn("_first", F.regexp_extract("_v", f"([^{SEPARATORS}])", 1))
        .where("_first <> ''")
    )
    last = F.least(F.length(v) - F.col("size"), F.length(v) - _needed(F.length(v)) + 2)
    parts = F.transform(F.sequence(F.lit(0), last), lambda o: F.substr(v, o + 1, F.col("size")))
    begun = F.filter(parts, lambda p: p.startswith(F.col("_first")) | p.rlike(r"(?U)^\s"))
    keys = F.when(F.col("size") == 0, _one_less(v)).otherwise(begun)
    return sized.select("value", "size", F.explode(F.array_distinct(keys)).alias("_part")).select(
        "value", "size", F.xxhash64("_part").alias("key")
    )


def _sizes_for_span(span: int) -> list[int]:
    """Key sizes of the values a span of this length can match under the span rule."""
    lengths = [n for n in range(SHORT + 1, 2 * span + 2) if 17 * n <= 23 * span and 17 * span <= 23 * n]
    reach = {max(s for s in KEY_SIZES if s <= -(-17 * n // 23) - 2) for n in lengths}
    return sorted(s for s in reach if s <= SPAN_KEYS)


def question_keys(questions: DataFrame, sizes: list[int]) -> DataFrame:
    """(question_id, size, key, span) for all word starts of each question; the span is
    there for small keys only."""
    text = _fold(F.col("question"))
    edge, inner = rf"[{SEPARATORS}\s]", rf"[^{SEPARATORS}\s]"

    def found(pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def spans(n: int) -> Column:
        """Texts of n characters from a word start to a word end."""
        return found(rf"(?sU)(?:^|(?<={edge}))(?=({inner}.{{{n - 2}}}{inner})(?:\z|{edge}))")

    def keyed(size: int, parts: Column, part_of=lambda p: p, span_of=lambda p: F.lit(None).cast("string")) -> Column:
        return F.transform(
            parts,
            lambda p: F.struct(F.lit(size).alias("size"), F.xxhash64(part_of(p)).alias("key"), span_of(p).alias("span")),
        )

    lists = []
    if 0 in sizes:
        short = F.concat(*[spans(n) for n in range(2, SHORT_SPAN + 1)])
        lists.append(keyed(0, F.array_distinct(F.flatten(F.transform(short, _one_less)))))
    small = [s for s in sizes if 0 < s <= SPAN_KEYS]
    for n in range(SHORT, LONGEST_SPAN + 1):
        for size in set(_sizes_for_span(n)) & set(small):
            lists.append(keyed(size, spans(n), lambda p, s=size: F.left(p, F.lit(s)), lambda p: p))
    for size in (s for s in sizes if s > SPAN_KEYS):
        starts = found(rf"(?s)(?:^|(?<=[{SEPARATORS}]))(?=([^{SEPARATORS}].{{{size - 1}}}))")
        lists.append(keyed(size, starts))
    return questions.select("question_id", F.explode(F.concat(*lists)).alias("k")).select("question_id", "k.*")


def _least_span(length: Column, threshold: float) -> Column:
    """Characters that a span has at least for a ratio of `threshold` to a value of this length."""
    return F.ceil(length * F.lit(threshold / (2 - threshold)) - 1e-9).cast("int")


def _largest_span(length, threshold: float):
    return (2 - threshold) / threshold * length + 1e-9


def _reached(bound: Column) -> Column:
    """How many of `LOOSE_SIZES` are no larger than `bound`, by plain comparisons: functions of array elements are not compiled."""
    count = F.when(bound < LOOSE_SIZES[1], 1)
    for many, size in enumerate(LOOSE_SIZES[2:], 2):
        count = count.when(bound < size, many)
    return count.otherwise(len(LOOSE_SIZES))


def loose_values(values: DataFrame, threshold: float) -> DataFrame:
    """(value, folded, first, sure, listed): what the keys of values are made of, for any threshold. `sure`: characters
    that a common part has at least; `listed`: sought by spans of whole words."""
    return (
        values.select("value", _fold(F.col("value")).alias("folded"))
        .withColumn("first", F.regexp_extract("folded", f"([^{SEPARATORS}])", 1))
        .where("first <> ''")
        .withColumn("sure", _least_span(F.length("folded"), threshold) - 2)
        .withColumn("listed", F.col("sure") < LISTED_UNDER)
    )


def loose_value_keys(values: DataFrame, threshold: float) -> DataFrame:
    """(value, folded, size, key, listed): as `value_keys`, for any threshold."""
    sizes = F.array(*[F.lit(s) for s in LOOSE_SIZES])
    length = F.length("folded")
    most = F.floor(_largest_span(length, threshold)).cast("int") - 2
    # A listed span of S characters has the size for S - 2; the others have that for the least span.
    least, many = _reached(F.greatest("sure", F.lit(1))), _reached(F.least(F.greatest(most, F.lit(1)), length))
    last = F.when(F.col("listed"), many).otherwise(least)
    # Places of the first letter, or of white space that is no separator, are few, so they come before the sizes.
    letter = F.substr(F.col("folded"), F.col("place") + 1, F.lit(1))
    # Dealt out first, as keys are many times their values and these end in a few tasks.
    spark = values.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = values.select("value").repartition(tasks, "value").distinct()
    sized = loose_values(dealt, threshold).withColumn("place", F.explode(F.sequence(F.lit(0), length - 1)))
    begun = sized.where((letter == F.col("first")) | letter.isin(*WHITE))
    begun = begun.withColumn("nth", F.explode(F.sequence(least, last))).withColumn("size", F.element_at(sizes, F.col("nth")))
    part = F.substr(F.col("folded"), F.col("place") + 1, F.col("size"))
    return begun.where(F.col("place") + F.col("size") <= length).select("value", "folded", "size", F.xxhash64(part).alias("key"), "listed")


def loose_question_keys(questions: DataFrame, sizes: list[int], longest: int) -> DataFrame:
    """(question_id, size, key, span): spans of whole words of up to `longest` characters under the beginning that
    a common part surely covers; and, for the `sizes` of values sought without spans, the beginnings at all word starts."""

    @F.pandas_udf("array<struct<size:int, part:string, span:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words, found = Words(text), set()
            for i, begin in enumerate(words.begins):
                for end in words.ends[i:]:
                    size = len(text[begin:end].strip())
                    if size > longest:
                        break
                    sure = max(s for s in LOOSE_SIZES if s <= max(1, size - LOOK_AHEAD))
                    found.add((sure, text[begin : begin + sure], text[begin:end].strip()))
                found.update((s, text[begin : begin + s], None) for s in sizes if begin + s <= len(text))
            out.append([{"size": a, "part": b, "span": c} for a, b, c in found])
        return pd.Series(out)

    found = questions.select("question_id", F.explode(spans.asNondeterministic()(_fold(F.col("question")))).alias("k"))
    return found.select("question_id", "k.size", F.xxhash64("k.part").alias("key"), "k.span")


def loose_pairs(questions: DataFrame, values: DataFrame, threshold: float, hot: int = HOT_ROWS) -> DataFrame:
    """Distinct (question_id, value) pairs that may match, for any threshold above 0."""
    # At most one row per key size, some forty in all.
    held = loose_values(values, threshold)
    size = F.element_at(F.array(*[F.lit(s) for s in LOOSE_SIZES]), _reached(F.greatest("sure", F.lit(1))))
    needs = held.groupBy("listed", F.when(~F.col("listed"), size).alias("size")).agg(F.max(F.length("folded")).alias("longest")).collect()
    sizes = sorted(r["size"] for r in needs if not r["listed"])
    longest = max((r["longest"] for r in needs if r["listed"]), default=0)
    if not longest and not sizes:
        return questions.select("question_id").limit(0).withColumn("value", F.lit(""))
    asked = cut(loose_question_keys(questions, sizes, int(_largest_span(longest, threshold))))
    # Listed values meet spans, the others meet word starts.
    keys = loose_value_keys(values, threshold).withColumn("kind", F.col("listed").cast("int")).drop("listed")
    asked = asked.withColumn("kind", F.col("span").isNotNull().cast("int"))
    if asked.count() <= min(hot, FEW_ASKED):
        # Keys of the values, which are many more, meet these where they are made.
        met = keys.join(F.broadcast(asked), ["kind", "size", "key"])
    else:
        met = blocked_join(asked, cut(keys.distinct()), ["kind", "size", "key"], "question_id", "value", hot)
    total = F.length("folded") + F.length("span")
    allowed = (1 - threshold) * total + 1e-6
    # No edit distance is below the difference of the lengths.
    close = (F.abs(F.length("folded") - F.length("span")) <= allowed) & (F.levenshtein("span", "folded") <= allowed)
    near = met.where(F.col("span").isNull() | close)
    return near.select("question_id", "value").distinct()


def candidate_pairs(questions: DataFrame, values: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Distinct (question_id, value) pairs that may match."""
    keys = cut(value_keys(values))
    # At most one row per key size, some forty in all.
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())
    if not sizes:
        return questions.select("question_id").limit(0).withColumn("value", F.lit(""))
    asked = cut(question_keys(questions, sizes))
    met = blocked_join(asked, keys, ["size", "key"], "question_id", "value", hot)
    low = _fold(F.col("value"))
    allowed = 0.15 * (F.length(low) + F.length("span")) + 1e-6
    near = met.where(F.col("span").isNull() | (F.levenshtein("span", low) <= allowed)).select("question_id", "value")
    return near.distinct()


# Numbers once commas are taken out.
DIGITS = r"\p{Nd}+(_\p{Nd}+)*"
NUMBER = rf"(?i)^\s*[+-]?(nan|inf|infinity|({DIGITS}\.?({DIGITS})?|\.{DIGITS})(e[+-]?{DIGITS})?)\s*$"
CAPITALS = r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$"


def first_letter(text: Column) -> Column:
    """The first character that separates nothing, else the last one."""
    found = F.regexp_extract(text, f"(?s)([^{SEPARATORS}])", 1)
    return F.when(found != "", found).otherwise(F.right(text, F.lit(1)))


def judged_pairs(pairs: DataFrame, questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Accepted pairs with match, source, score and match_size.

    The function finds the common part, its words in the question and their ratio to the
    value; every rule on these is a column: no numbers, key terms or stop words, the same
    first letter, and an exact match for common words and for values in capitals."""

    @F.pandas_udf("struct<match_text:string, source:string, score:double, match_size:int>")
    def found(question: pd.Series, value: pd.Series) -> pd.DataFrame:
        folded = {q: (f, Words(f)) for q in question.unique() for f in [fold_case(q)]}
        none = (None, None, None, None)
        rows = [m if (m := compared(q, *folded[q], v)) and m[2] >= threshold else none for q, v in zip(question, value)]
        out = pd.DataFrame(rows, columns=["match_text", "source", "score", "match_size"])
        return out.astype({"match_size": "Int32", "score": "float64"})

    joined = pairs.join(questions.select("question_id", "question"), "question_id")
    met = joined.select("question_id", "value", found.asNondeterministic()("question", "value").alias("m"))
    met = met.where("m.match_text IS NOT NULL").select("question_id", "value", "m.*")
    part, source, value = (strip(F.lower(c)) for c in ("match_text", "source", "value"))

    def any_of(words: frozenset) -> Column:
        return part.isin(*sorted(words)) | source.isin(*sorted(words)) | value.isin(*sorted(words))

    score = F.when(first_letter(value) == first_letter(source), F.col("score")).otherwise(0.0)
    strict = any_of(COMMON_WORDS) | F.col("value").rlike(CAPITALS)
    ruled_out = (part == "") | F.replace(part, F.lit(",")).rlike(NUMBER) | part.isin(*KEY_TERMS) | any_of(STOP_WORDS)
    met = met.where(~ruled_out).withColumn("score", score)
    return met.where((F.col("score") >= threshold) & (~strict | (F.col("score") >= 1)))


def link_values(
    questions: DataFrame, values: DataFrame, threshold: float = THRESHOLD, top_k: int = TOP_K, hot: int = HOT_ROWS
) -> DataFrame:
    """Best values per question and column.

    questions: question_id, question;  values: table_name, column_name, value (text)
    returns    question_id, table_name, column_name, value, source, score, rank

    Per matched text the last value in text order counts, and the first one fixes the
    order among equals. Columns called after a name need an exact match.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    asked = questions.select("question_id", strip(F.col("question")).alias("question"))
    held = cut(usable_values(values))
    # A link depends on the text alone, so each text is judged once, and questions with the same texts share their
    # links; dealing out the texts also spreads the row work, which files would leave to as many tasks as they have splits.
    texts = cut(asked.select("question").distinct().withColumn("question_id", F.monotonically_increasing_id()))
    known = asked.where("question_id IS NOT NULL").join(texts.withColumnRenamed("question_id", "_text"), "question")
    # One text each, but for questions that come with several.
    sets = cut(known.groupBy("question_id").agg(F.array_sort(F.collect_set("_text")).alias("_texts")))
    groups = cut(sets.select("_texts").distinct().withColumn("_group", F.monotonically_increasing_id()))
    pairs = candidate_pairs(texts, held, hot) if threshold >= THRESHOLD else loose_pairs(texts, held, threshold, hot)
    members = groups.select("_group", F.explode("_texts").alias("question_id"))
    found = judged_pairs(pairs, texts, threshold).join(members, "question_id").drop("question_id")
    placed = found.join(held, "value")
    per_match = placed.groupBy("_group", "table_name", "column_name", "match_text").agg(
        F.max_by(F.struct("value", "source", "score", "match_size"), "value").alias("m"), F.min("value").alias("_first")
    )
    weight = F.lit(1e16) * F.col("m.score") + F.lit(1e8) * F.col("m.score") + F.col("m.match_size")
    needs_exact = F.col("column_name").contains("name")
    w = Window.partitionBy("_group", "table_name", "column_name").orderBy(weight.desc(), "_first")
    best = (
        per_match.where(~needs_exact | (F.col("m.score") * F.col("m.score") >= 1))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top_k)
    )
    return best.join(groups, "_group").join(sets, "_texts").select(
        "question_id", "table_name", "column_name", "m.value", "m.source", "m.score", "rank"
    )


def column_contents(links: DataFrame) -> DataFrame:
    """Per question and column the linked values, sorted."""
    return links.groupBy("question_id", "table_name", "column_name").agg(
        F.sort_array(F.collect_list("value")).alias("contents")
    )

