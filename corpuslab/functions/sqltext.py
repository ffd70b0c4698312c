"""Column functions over SQL text held in a log column. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CURLY_QUOTES = "‘’“”"
STRAIGHT_QUOTES = "''''"
COMPARISON_OPERATORS = ["=", "!=", ">", ">=", "<", "<="]
ALIAS_NUMBERS = "10|[1-9]"
MASK = "_"

# A token is a quoted literal, a quoted identifier, a (signed) number, a possibly
# dotted name, the special token @.@, a two-character operator or one symbol.
TOKEN = (
    r"'(?:''|\\'|[^'])*'"
    r"|`[^`]*`(?:\.`[^`]*`)*|\[[^\]]*\]"
    r"|(?<![\w)\]])-?\d+(?:\.\d+)?(?![\w])"
    r"|@\.@"
    r"|\w+(?:\.(?:\w+|\*))*"
    r"|<>|<=|>=|!=|\|\||::"
    r"|\S"
)
_SORT_KEY = r"(?:\w+ \( \S+ \)|\w+(?:\.\w+)?)"
_SORT_CLAUSE = rf"order by {_SORT_KEY}(?: (?:[-+]|[<>]=?) {_SORT_KEY})*"
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"

# Parentheses inside literals are set aside under these two private characters.
_PAREN, _ASIDE = "()", "\ue000\ue001"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def straighten_quotes(text: Column) -> Column:
    """Curly quotes become a plain single quote; outer blanks go."""
    return strip(F.translate(text, CURLY_QUOTES, STRAIGHT_QUOTES))


def _once(value: Column, use) -> Column:
    """`use(value)` with the value computed a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def drop_semicolon(sql: Column) -> Column:
    return F.regexp_replace(sql, r";\z", "")


def single_quotes(sql: Column) -> Column:
    return F.translate(sql, '"', "'")


def tokenize(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))


def respace(sql: Column) -> Column:
    """Exactly one blank between tokens."""
    return F.array_join(tokenize(sql), " ")


def _by_quote_side(sql: Column, outside=None, inside=None) -> Column:
    """Apply one function to the text outside quotes and another to the text inside."""
    def side(part: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, outside(part) if outside else part
        ).otherwise(inside(part) if inside else part)

    return F.array_join(F.transform(F.split(sql, "'", -1), side), "'")


def lower_outside_quotes(sql: Column) -> Column:
    return _by_quote_side(sql, outside=F.lower)


def add_ascending(sql: Column) -> Column:
    """Spell out `asc` after sort keys where the text states no direction at all."""
    def spelled(text: Column) -> Column:
        implicit = text.contains("order by") & ~text.rlike(r"\b(asc|desc)\b")
        return F.when(implicit, F.regexp_replace(text, f"({_SORT_CLAUSE})", "$1 asc")).otherwise(text)

    return _once(sql, spelled)


def inline_aliases(sql: Column) -> Column:
    """Replace the numbered aliases t1..t10 by the tables they stand for.

    Names are matched as whole words. If an alias is declared twice, the last
    declaration counts, hence the reversed fold.
    """
    declared = rf"\b(?:from|join|,) ([\w.]+ as t(?:{ALIAS_NUMBERS}))\b"

    def fold(text: Column, pair: Column) -> Column:
        table = F.substring_index(pair, " as ", 1)
        alias = F.substring_index(pair, " as ", -1)
        undeclared = F.regexp_replace(text, F.concat(F.lit(r"\bas "), alias, F.lit(" ")), F.lit(""))
        return F.regexp_replace(undeclared, F.concat(F.lit(r"\b"), alias, F.lit(r"\b")), table)

    def replaced(text: Column) -> Column:
        pairs = F.reverse(F.regexp_extract_all(text, F.lit(declared), F.lit(1)))
        return F.when(text.rlike(declared), F.aggregate(pairs, text, fold)).otherwise(text)

    return _once(sql, replaced)


def normalize(sql: Column) -> Column:
    """The whole chain from raw log text to the normalised form."""
    steps = [
        strip, drop_semicolon, single_quotes, respace, lower_outside_quotes,
        add_ascending, inline_aliases, strip,
    ]
    return reduce(lambda text, step: step(text), steps, sql)


def is_number_token(token: Column) -> Column:
    return token.rlike(_NUMBER)


def mask_tokens(sql: Column, names: Column) -> Column:
    """Tokens naming a schema item, `*`, literals and numbers become the mask.

    `names` holds tables, columns and dotted columns of the statement's database.
    """
    def one(token: Column) -> Column:
        hidden = (
            F.array_contains(names, token)
            | (token == "*")
            | token.rlike(r"^'.*'$")
            | is_number_token(token)
        )
        return F.when(hidden, F.lit(MASK)).otherwise(token)

    return F.array_join(F.transform(tokenize(sql), one), " ")


def collapse_skeleton(masked: Column) -> Column:
    """Fold joins, lists, comparisons and conjunctions of a masked statement."""
    text = masked
    for connector in ("and", "or"):
        text = F.replace(text, F.lit(f"on _ = _ {connector} _ = _"), F.lit("on _ = _"))
    text = F.replace(text, F.lit(" on _ = _"), F.lit(""))
    text = F.regexp_replace(text, r"_ (?:join _ ?)+", "_ ")
    text = F.regexp_replace(text, r"_(?: , _)+", "_")
    for operator in COMPARISON_OPERATORS:
        text = F.replace(text, F.lit(f"_ {operator} _"), F.lit("_"))
    text = F.regexp_replace(text, r"where _(?: (?:and|or) _)+", "where _")
    return strip(F.regexp_replace(text, " {2,}", " "))


def skeleton(norm_sql: Column, names: Column) -> Column:
    return collapse_skeleton(mask_tokens(norm_sql, names))


def blank_tokens(norm_sql: Column) -> Column:
    """Tokens of a normalised statement as split by white space."""
    return F.filter(F.split(norm_sql, r"\s+"), lambda t: t != "")


def split_dotted(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.split(t, r"\.", -1)))


def dotted_columns(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.contains(".") & (t != "@.@"))


def without_literals(sql: Column) -> Column:
    return F.regexp_replace(sql, r"'(?:''|[^'])*'", "''")


def has_join(sql: Column, strict: bool = False) -> Column:
    """Substring test by default; `strict` wants the key word outside literals."""
    if strict:
        return without_literals(F.lower(sql)).rlike(r"\bjoin\b")
    return F.lower(sql).contains("join")


def has_set_operation(sql: Column) -> Column:
    return without_literals(F.lower(sql)).rlike(r"\b(union|intersect|except)\b")


def has_subquery(sql: Column) -> Column:
    return without_literals(F.lower(sql)).rlike(r"\(\s*select\b")


def is_nested(sql: Column) -> Column:
    return has_set_operation(sql) | has_subquery(sql)


def tag_list(sql: Column, strict: bool = False) -> Column:
    """`[]`, `[join]`, `[nested]` or both."""
    return F.array_compact(
        F.array(
            F.when(has_join(sql, strict), F.lit("join")),
            F.when(is_nested(sql), F.lit("nested")),
        )
    )


def type_class(sql: Column, strict: bool = False) -> Column:
    return (
        F.when(has_join(sql, strict), F.lit("non-nested"))
        .when(is_nested(sql), F.lit("nested"))
        .otherwise(F.lit("easy"))
    )


def tag_flags(tags: Column) -> dict[str, Column]:
    """Tags as boolean metadata columns; an absent tag is false."""
    return {tag: F.coalesce(F.array_contains(tags, tag), F.lit(False)) for tag in ("join", "nested")}


def hardness(comp1: Column, comp2: Column, others: Column) -> Column:
    """Four-level hardness from the three component counts of a statement."""
    flat = comp2 == 0
    return (
        F.when(flat & (comp1 <= 1) & (others == 0), F.lit("easy"))
        .when(flat & (((others <= 2) & (comp1 <= 1)) | ((comp1 <= 2) & (others < 2))), F.lit("medium"))
        .when(
            (flat & (others > 2) & (comp1 <= 2))
            | (flat & (comp1 > 2) & (comp1 <= 3) & (others <= 2))
            | ((comp1 <= 1) & (others == 0) & (comp2 <= 1)),
            F.lit("hard"),
        )
        .otherwise(F.lit("extra"))
    )


def subqueries(sql: Column) -> Column:
    """Texts of the outermost parenthesised selects, in document order.

    The statement is cut in front of every parenthesis and the pieces are folded
    once with a running depth; nothing leaves the row.
    """
    shielded = _by_quote_side(sql, inside=lambda part: F.translate(part, _PAREN, _ASIDE))
    pieces = F.split(shielded, r"(?=[()])", -1)
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(-1).alias("opened"),
        F.lit("").alias("text"),
        F.array().cast("array<string>").alias("found"),
    )

    def fold(state: Column, piece: Column) -> Column:
        opening, closing = piece.startswith("("), piece.startswith(")")
        inside = state["opened"] >= 0
        begins = ~inside & piece.rlike(r"(?i)^\(\s*select\b")
        depth = state["depth"] + opening.cast("int") - closing.cast("int")
        ends = inside & closing & (depth == state["opened"])
        return F.struct(
            depth.alias("depth"),
            F.when(begins, state["depth"]).when(ends, F.lit(-1)).otherwise(state["opened"]).alias("opened"),
            F.when(begins, F.substr(piece, F.lit(2)))
            .when(inside & ~ends, F.concat(state["text"], piece))
            .otherwise(F.lit(""))
            .alias("text"),
            F.when(
                ends,
                F.concat(state["found"], F.array(F.translate(state["text"], _ASIDE, _PAREN))),
            )
            .otherwise(state["found"])
            .alias("found"),
        )

    found = F.aggregate(pieces, start, fold, lambda state: state["found"])
    return F.transform(found, strip)
