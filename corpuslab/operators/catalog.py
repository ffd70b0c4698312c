"""Catalog reshaping.

A raw catalog has one row per database with parallel arrays, as read from its JSON
file. Everything below works inside that row, so no catalog operator shuffles.

Raw columns: db_id, table_names_original, table_names (array<string>),
column_names_original, column_names (array<array<string>> of [table index, name]),
column_types (array<string>), primary_keys (array<array<int>>),
foreign_keys (array<array<int>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _owner(entry: Column) -> Column:
    return entry[0].cast("int")


def _column(raw_index: Column) -> Column:
    return F.col("column_names_original")[raw_index]


def _table_of(raw_index: Column) -> Column:
    return F.lower(F.col("table_names_original")[_owner(_column(raw_index))])


def _name_of(raw_index: Column) -> Column:
    return F.lower(_column(raw_index)[1])


def wrap_primary_keys(keys: Column) -> Column:
    """Keys read as JSON text, each an index or a list of them, as lists of indexes."""
    return F.transform(
        keys, lambda k: F.from_json(F.concat(F.lit("["), F.translate(k, "[]", ""), F.lit("]")), "array<int>")
    )


def _zipped() -> Column:
    return F.arrays_zip("column_names_original", "column_names", "column_types")


def catalog_columns(raw: DataFrame) -> DataFrame:
    """One row per column. Entries owned by no table, such as the wildcard, drop out."""
    return (
        raw.select("db_id", "table_names_original", "table_names", F.posexplode(_zipped()).alias("column_idx", "c"))
        .withColumn("table_idx", _owner(F.col("c.column_names_original")))
        .where((F.col("table_idx") >= 0) & (F.col("table_idx") < F.size("table_names_original")))
        .select(
            "db_id",
            "table_idx",
            "column_idx",
            F.lower(F.col("table_names_original")[F.col("table_idx")]).alias("table_name_original"),
            F.lower(F.col("table_names")[F.col("table_idx")]).alias("table_name"),
            F.lower(F.col("c.column_names_original")[1]).alias("column_name_original"),
            F.lower(F.col("c.column_names")[1]).alias("column_name"),
            F.col("c.column_types").alias("column_type"),
        )
    )


def primary_keys() -> Column:
    """Array of (table, columns); the columns are always a list."""
    return F.transform(
        "primary_keys",
        lambda key: F.struct(
            _table_of(key[0]).alias("table_name_original"),
            F.transform(key, _name_of).alias("column_name_original"),
        ),
    )


def foreign_keys() -> Column:
    return F.transform(
        "foreign_keys",
        lambda key: F.struct(
            _table_of(key[0]).alias("source_table_name_original"),
            _name_of(key[0]).alias("source_column_name_original"),
            _table_of(key[1]).alias("target_table_name_original"),
            _name_of(key[1]).alias("target_column_name_original"),
        ),
    )


def catalog_primary_keys(raw: DataFrame) -> DataFrame:
    return raw.select("db_id", F.posexplode(primary_keys()).alias("key_idx", "k")).select("db_id", "key_idx", "k.*")


def catalog_foreign_keys(raw: DataFrame) -> DataFrame:
    return raw.select("db_id", F.posexplode(foreign_keys()).alias("key_idx", "k")).select("db_id", "key_idx", "k.*")


def nested_schema() -> Column:
    """Tables in catalog order, each with its column arrays."""
    def table(name: Column, idx: Column) -> Column:
        own = F.filter(_zipped(), lambda z: _owner(z["column_names_original"]) == idx)
        return F.struct(
            F.lower(name).alias("table_name_original"),
            F.lower(F.col("table_names")[idx]).alias("table_name"),
            F.transform(own, lambda z: F.lower(z["column_names"][1])).alias("column_names"),
            F.transform(own, lambda z: F.lower(z["column_names_original"][1])).alias("column_names_original"),
            F.transform(own, lambda z: z["column_types"]).alias("column_types"),
            F.array().cast("array<array<string>>").alias("db_contents"),
        )

    return F.transform("table_names_original", table)


def nested_catalog(raw: DataFrame) -> DataFrame:
    """One row per database: db_schema, pk and fk in nested form."""
    return raw.select(
        "db_id", nested_schema().alias("db_schema"), primary_keys().alias("pk"), foreign_keys().alias("fk")
    )


def table_list(schema: Column) -> Column:
    return F.transform(schema, lambda t: t["table_name_original"])


def column_list(schema: Column) -> Column:
    return F.flatten(F.transform(schema, lambda t: t["column_names_original"]))


def flat_list(schema: Column) -> Column:
    """Each table followed by its columns."""
    return F.flatten(
        F.transform(schema, lambda t: F.concat(F.array(t["table_name_original"]), t["column_names_original"]))
    )


def maskable_names(schema: Column) -> Column:
    """All names a statement may use for an item: table, column, table.column, table.*"""
    def names(t: Column) -> Column:
        table, columns = t["table_name_original"], t["column_names_original"]
        dotted = F.transform(
            F.concat(F.array(F.lit("*")), columns), lambda c: F.concat_ws(".", table, c)
        )
        return F.concat(F.array(table), columns, dotted)

    return F.array_distinct(F.flatten(F.transform(schema, names)))


def table_columns(schema: Column) -> Column:
    """Ordered map table -> columns, as an array of structs since maps keep no order."""
    return F.transform(
        schema,
        lambda t: F.struct(t["table_name_original"].alias("table"), t["column_names_original"].alias("columns")),
    )


def schema_text(tables: Column) -> Column:
    """`Table t, columns = [a,b]`, one line per table."""
    return F.array_join(
        F.transform(
            tables,
            lambda t: F.concat(
                F.lit("Table "), t["table"], F.lit(", columns = ["), F.array_join(t["columns"], ","), F.lit("]")
            ),
        ),
        "\n",
    )


def dotted_text(tables: Column) -> Column:
    """`t.a,t.b` over all tables."""
    return F.array_join(
        F.flatten(F.transform(tables, lambda t: F.transform(t["columns"], lambda c: F.concat_ws(".", t["table"], c)))),
        ",",
    )


def foreign_key_ends(fk: Column) -> Column:
    """Distinct dotted names that are an end of some foreign key."""
    def ends(k: Column) -> Column:
        return F.array(
            F.concat_ws(".", k["source_table_name_original"], k["source_column_name_original"]),
            F.concat_ws(".", k["target_table_name_original"], k["target_column_name_original"]),
        )

    return F.array_distinct(F.flatten(F.transform(fk, ends)))


def column_descriptions(schema: Column, fk: Column, mark_keys: bool = True) -> Column:
    """Per table the columns as `name ( v1 , v2 , [FK] ) `, or the bare name."""
    def describe(t: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            values = F.coalesce(F.get(t["db_contents"], i), F.array().cast("array<string>"))
            dotted = F.concat_ws(".", t["table_name_original"], F.get(t["column_names_original"], i))
            marks = F.when(
                F.lit(mark_keys) & F.array_contains(foreign_key_ends(fk), dotted), F.array(F.lit("[FK]"))
            ).otherwise(F.array().cast("array<string>"))
            notes = F.concat(values, marks)
            return F.when(
                F.size(notes) > 0, F.concat(name, F.lit(" ( "), F.array_join(notes, " , "), F.lit(" ) "))
            ).otherwise(name)

        return F.transform(t["column_names"], one)

    return F.transform(schema, describe)


def with_contents(samples: DataFrame, contents: DataFrame, key: str = "id") -> DataFrame:
    """`samples` whose db_schema has the values found for their columns as db_contents, by position.

    contents: <key>, table_name, column_name, contents (list of texts), as `valuelink.column_contents` gives them;
    names in any case, a column once per sample. A column without an entry has an empty list, and entries for columns that
    the schema lacks are left out. One map per sample is joined to it, and the nested schema is never taken apart."""
    name = F.lower(F.concat_ws(".", "table_name", "column_name"))
    entry = F.struct(name, F.coalesce("contents", F.array().cast("array<string>")))
    maps = contents.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    joined = samples.join(maps, samples[key] == maps["_key"], "left")
    none = F.array().cast("array<string>")

    def filled(t: Column) -> Column:
        values = F.transform(t["column_names_original"], lambda c: F.coalesce(F.try_element_at("_held", F.lower(F.concat_ws(".", t["table_name_original"], c))), none))
        return t.withField("db_contents", values)

    return joined.withColumn("db_schema", F.transform("db_schema", filled)).drop("_key", "_held")


def classifier_samples(prepared: DataFrame) -> DataFrame:
    """Question, tables with labels, column descriptions per table, flat column labels."""
    return prepared.select(
        *[c for c in ("id", "db_id") if c in prepared.columns],
        "question",
        F.transform("db_schema", lambda t: t["table_name"]).alias("table_names"),
        "table_labels",
        column_descriptions(F.col("db_schema"), F.col("fk")).alias("column_infos"),
        F.flatten("column_labels").alias("column_labels"),
    )
