"""Tool calls of conversations: linked to their results, ordered, validated, serialised.

All of it is DataFrame functions: a hash join by identifier, rounds of joins for the order,
variants for the types of arguments and for canonical JSON (their objects keep keys sorted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import cut


def linked(calls: DataFrame, results: DataFrame, on: str = "call_id") -> DataFrame:
    """`calls` (call_id, ..) with result (struct of all other columns of `results`, the smallest
    of several) and n_results. A call without a result has null and 0; results without a call,
    and null identifiers, link with nothing. Results are pre-aggregated by identifier, so
    repeated ones never multiply calls; repeated calls each keep their row."""
    value = F.struct(*[F.col(c) for c in results.columns if c != on])
    one = results.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("call__")).agg(F.min(value).alias("result"), F.count("*").alias("n_results"))
    calls = calls.drop("result", "n_results")
    out = calls.join(one.hint("shuffle_hash"), calls[on] == one["call__"], "left").drop("call__")
    return out.withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def levels(calls: DataFrame, on: str = "call_id", needs: str = "depends_on") -> DataFrame:
    """call_id and its level in the order of dependence: 0 without a dependency among the calls,
    else one more than the highest level it depends on. Calls in or behind a cycle have null.

    A dependency that names no call is ignored; null identifiers have no row; repeated calls count once, with all
    their dependencies. Where no call has more than one, levels come by pointer doubling, in as many rounds of joins as the
    longest chain has binary digits; else each round settles the calls all of whose dependencies are settled. Every round is written."""
    ids = calls.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("id")).agg(F.flatten(F.collect_set(needs)).alias("needs"))
    ids = cut(ids.select("id", F.array_distinct(F.coalesce("needs", F.array().cast("array<string>"))).alias("needs")))
    edges = ids.select("id", F.explode("needs").alias("need")).join(ids.select(F.col("id").alias("need")), "need", "left_semi")
    edges = cut(edges.select("id", "need"))
    several = not edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    out = by_rounds(ids.select("id"), edges) if several else by_doubling(ids.select("id"), edges)
    return out.withColumnRenamed("id", on)


def by_doubling(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of `ids` where `edges` (id, need) has one row an id at most: each call knows the
    call some steps before it, and these steps double with every round."""
    at = cut(ids.join(edges, "id", "left").select("id", F.col("need").alias("before"), F.col("need").isNotNull().cast("int").alias("steps")))
    # No chain is longer than the calls; what still goes on after that runs in a circle.
    for _ in range(max(1, ids.count()).bit_length() + 1):
        if at.where("before IS NOT NULL").isEmpty():
            break
        there = at.select(F.col("id").alias("there"), F.col("before").alias("beyond"), F.col("steps").alias("more"))
        at = cut(at.join(there, at["before"] == there["there"], "left").select("id", F.col("beyond").alias("before"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return at.select("id", F.when(F.col("before").isNull(), F.col("steps")).alias("level"))


def by_rounds(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of `ids` by `edges` (id, need): every round settles a call at least, or is the last."""
    left, level = ids, 0
    done: list[DataFrame] = []
    while True:
        blocked = edges.join(left.select(F.col("id").alias("need")), "need", "left_semi").select("id").distinct()
        free = left.join(blocked, "id", "left_anti")
        free = cut(free.withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done.append(free)
        left = cut(left.join(free, "id", "left_anti"))
        if left.isEmpty():
            break
        level += 1
    out = left.withColumn("level", F.lit(None).cast("int"))
    for part in done:
        out = part.unionByName(out)
    return out


def kind_of(value: Column) -> Column:
    """JSON type of a variant: string, integer, number, boolean, null, array, object, or null
    where there is none."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(shape == "STRING", "string").when(shape == "BIGINT", "integer")
        .when(shape.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number").when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null").when(shape.startswith("ARRAY"), "array").otherwise("object")
    )


def checked(calls: DataFrame, schemas: dict[str, dict[str, dict]], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """Adds errors (sorted array of texts; empty: valid) and arguments_json (canonical: sorted keys,
    no white space; null where the text is no JSON).

    schemas: tool -> field -> {"type", "required", "minimum", "maximum", "enum"}; a bounded
    setting. Unknown tools, texts that are no JSON object, missing, surplus and mistyped fields
    and values out of range are errors. An integer is a number too."""
    value = F.try_parse_json(F.col(arguments))
    is_object = F.coalesce(kind_of(value) == "object", F.lit(False))
    found = F.expr(f"coalesce(json_object_keys({arguments}), array())")
    tests: list[Column] = [F.when(F.col(name).isNull() | ~F.col(name).isin(*schemas), F.lit("unknown tool")), F.when(~is_object, F.lit("arguments are no object"))]
    for tool, fields in schemas.items():
        here = is_object & (F.col(name) == tool)
        surplus = F.array_sort(F.array_except(found, F.array(*[F.lit(f) for f in fields]).cast("array<string>")))
        tests.append(F.when(here & (F.size(surplus) > 0), F.concat(F.lit("surplus "), F.array_join(surplus, " "))))
        for field, rule in fields.items():
            at = F.try_variant_get(value, f"$.{field}", "variant")
            kind, want = kind_of(at), rule.get("type")
            if rule.get("required"):
                tests.append(F.when(here & at.isNull(), F.lit(f"missing {field}")))
            fits = kind.isin("integer", "number") if want == "number" else kind == want
            if want:
                tests.append(F.when(here & at.isNotNull() & ~fits, F.lit(f"type of {field}")))
            number = F.try_variant_get(value, f"$.{field}", "double")
            if "minimum" in rule:
                tests.append(F.when(here & fits & (number < rule["minimum"]), F.lit(f"{field} too small")))
            if "maximum" in rule:
                tests.append(F.when(here & fits & (number > rule["maximum"]), F.lit(f"{field} too large")))
            if "enum" in rule:
                tests.append(F.when(here & fits & ~F.try_variant_get(value, f"$.{field}", "string").isin(*rule["enum"]), F.lit(f"{field} not allowed")))
    out = calls.drop("errors", "arguments_json")
    return out.withColumn("errors", F.array_sort(F.array_compact(F.array(*tests)))).withColumn("arguments_json", canonical(arguments))


def canonical(column: str) -> Column:
    """Canonical JSON of a text: keys sorted at every depth, no white space; null if it is none."""
    return F.to_json(F.try_parse_json(F.col(column)))


def formatted(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]], conversation: str = "conv_id") -> DataFrame:
    """One row per call: its columns, result, n_results, level, errors, arguments_json, valid and
    call_json, the canonical JSON of {arguments, id, level, name, result}; in a conversation calls
    are ordered by (level, turn, call_id). A result is its text. Rows are not gathered by
    conversation, so a long one is as many rows.

    Null names and arguments are errors of their call, null identifiers have no level and no result; texts of any length
    stay whole; repeated calls each keep their row, and an empty table gives an empty one. Columns of `calls` of the name of a result give way."""
    order = levels(calls)
    calls = calls.drop("level", "valid", "call_json")
    out = checked(linked(calls, results), schemas)
    order = order.withColumnRenamed("call_id", "id__")
    out = out.join(order.hint("shuffle_hash"), out["call_id"] == order["id__"], "left").drop("id__")
    out = out.withColumn("valid", F.size("errors") == 0)
    # Field names in sorted order; arguments are canonical already.
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments_json", F.lit("null")), F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"level":'),
        F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), json_text(F.col("name")), F.lit(',"result":'), json_text(F.col("result.text")), F.lit("}"),
    )
    return out.withColumn("call_json", text)


def messages(turns: DataFrame, calls: DataFrame, results: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Turns that are neither a call nor the result of one: conv_id, turn, role and message_json, the canonical JSON of
    {content, role}.

    turns: conv_id, turn, role, text; calls and results have the turns' place in columns conv_id and turn, results also
    call_id. A null text or role is a JSON null; repeated turns each keep their row."""
    linked_turns = results.join(calls.select("call_id").distinct(), "call_id", "left_semi").select(conversation, "turn")
    taken = linked_turns.unionByName(calls.select(conversation, "turn")).distinct()
    taken = taken.select(F.col(conversation).alias("conv__"), F.col("turn").alias("turn__"))
    left = turns.join(taken, turns[conversation].eqNullSafe(taken["conv__"]) & turns["turn"].eqNullSafe(taken["turn__"]), "left_anti")
    text = F.concat(F.lit('{"content":'), json_text(F.col("text")), F.lit(',"role":'), json_text(F.col("role")), F.lit("}"))
    return left.select(conversation, "turn", "role", text.alias("message_json"))


def json_text(value: Column) -> Column:
    """A string as JSON."""
    return F.coalesce(F.to_json(F.when(value.isNotNull(), F.parse_json(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)))), F.lit("null"))
