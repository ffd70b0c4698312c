"""Reading sample sets, catalogs and prediction files; pairing rows by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import sqltext
from corpuslab.operators.catalog import wrap_primary_keys
from corpuslab.operators.linking import statement_field
from corpuslab.operators.ordering import file_ordinal
from corpuslab.sources import jsonarray

SAMPLE_SCHEMA = "question string, db_id string, query string, SQL string, evidence string, question_id long"
CATALOG_SCHEMA = (
    "db_id string, table_names_original array<string>, table_names array<string>, "
    "column_names_original array<array<string>>, column_names array<array<string>>, column_types array<string>, "
    "primary_keys array<string>, foreign_keys array<array<int>>"
)
TABLE_DDL = (
    "struct<table_name_original:string, table_name:string, column_names:array<string>, "
    "column_names_original:array<string>, column_types:array<string>, db_contents:array<array<string>>>"
)
PK_DDL = "struct<table_name_original:string, column_name_original:array<string>>"
FK_DDL = (
    "struct<source_table_name_original:string, source_column_name_original:string, "
    "target_table_name_original:string, target_column_name_original:string>"
)
PREPARED_SCHEMA = f"""id string, question string, evidence string, db_id string, sql string, norm_sql string,
sql_skeleton string, natsql string, norm_natsql string, natsql_skeleton string, schema_links array<string>,
domain string, difficulty_type array<string>, spider_difficulty string, sub_queries array<string>,
predicted_sql_list array<struct<sql:string, difficulty_type:string, spider_difficulty:string>>,
db_schema array<{TABLE_DDL}>, pk array<{PK_DDL}>, fk array<{FK_DDL}>, table_labels array<int>,
column_labels array<array<int>>, column_pred_probs array<array<double>>, table_pred_probs array<double>,
ranked_schema_links array<string>"""
RETRIEVAL_SCHEMA = f"""id string, question string, evidence string, sql string, sql_skeleton string,
db_schema_sequence string, golden_schema_link_sequence string, db_schema array<{TABLE_DDL}>, pk array<{PK_DDL}>,
fk array<{FK_DDL}>, table_labels array<int>, column_labels array<array<int>>, db_id string, domain string,
difficulty_type array<string>"""


def _read_json(spark: SparkSession, path, schema: str, lines: bool) -> DataFrame:
    """Records of JSON arrays, or with `lines` one per line; both are read in parts.

    Two statement fields differ only by what they are called, so names keep their case.
    """
    if not lines:
        return jsonarray.read_array(spark, path, schema)
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return file_ordinal(raw.select("*", "_metadata")).drop("_metadata")


def read_samples(spark: SparkSession, path, dataset: str, lines: bool = False) -> DataFrame:
    """(ordinal, question, db_id, evidence, question_id, sql): the statement comes from
    the field the dataset uses."""
    field = statement_field(dataset)
    names = [f"{n}" for n in ("question string", "db_id string", "evidence string", "question_id long")]
    raw = _read_json(spark, path, ", ".join([*names, f"{field} string"]), lines)
    return raw.withColumnRenamed(field, "sql")


def read_catalogs(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Raw catalog rows; each primary key becomes a list of column indexes."""
    raw = _read_json(spark, path, CATALOG_SCHEMA, lines).drop("ordinal")
    return raw.withColumn("primary_keys", wrap_primary_keys(F.col("primary_keys")))


def read_prepared(spark: SparkSession, path, lines: bool = True, retrieval: bool = False) -> DataFrame:
    """Typed read of prepared samples, or of retrieval samples."""
    return _read_json(spark, path, RETRIEVAL_SCHEMA if retrieval else PREPARED_SCHEMA, lines).drop("ordinal")


def pair_by_position(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of equal place side by side. Unequal numbers of rows are an error."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"cannot pair {n_left} rows with {n_right}")
    return left.join(right, ordinal)


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """(ordinal, prediction): one statement per line."""
    lines = spark.read.text(path).select(F.col("value").alias("prediction"), "_metadata")
    return file_ordinal(lines).drop("_metadata")


def attach_predictions(samples: DataFrame, paths: list, ordinal: str = "ordinal") -> DataFrame:
    """Add `predicted_sql_list`, one entry per file in the order given."""
    spark = samples.sparkSession
    out = samples
    for i, path in enumerate(paths):
        lines = read_predictions(spark, path).withColumnRenamed("ordinal", ordinal)
        out = pair_by_position(out, lines.withColumnRenamed("prediction", f"_p{i}"), ordinal)

    def entry(name: str):
        return F.struct(
            F.col(name).alias("sql"),
            sqltext.type_class(F.col(name)).alias("difficulty_type"),
            F.lit(None).cast("string").alias("spider_difficulty"),
        )

    names = [f"_p{i}" for i in range(len(paths))]
    return out.withColumn("predicted_sql_list", F.array(*[entry(n) for n in names])).drop(*names)


def latest_by_id(files: list[DataFrame], key: str = "id", order: str = "place") -> DataFrame:
    """Union of several files where the later file, then the later row, wins per id.

    `order` names the column with the place in the file (`ordering.file_ordinal` makes one):
    the number of a task would be no such place. The winner is found by an
    aggregate that combines on the map side, so an id repeated often does no harm.
    """
    place = [F.lit(i).alias("_file") for i in range(len(files))]
    tagged = [
        df.select("*", p, F.col(order).alias("_row"))
        for df, p in zip(files, place)
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    columns = [c for c in files[0].columns if c != key]
    winner = F.max_by(F.struct(*columns), F.struct("_file", "_row"))
    return rows.groupBy(key).agg(winner.alias("_w")).select(key, "_w.*")


def lookup(store: DataFrame, ids: DataFrame, key: str = "id", check: bool = True) -> DataFrame:
    """Rows of `store` for the given ids; an id that is not there is an error."""
    if check:
        missing = ids.select(key).join(store.select(key), key, "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"not in the store: {[r[0] for r in missing]}")
    return ids.join(store, key)


def column_values(df: DataFrame, table_name: str, columns: list[str]) -> DataFrame:
    """Distinct (table_name, column_name, value) of text columns. Binary columns are read
    as UTF-8, or as Latin-1 where that fails."""
    kinds = dict(df.dtypes)

    def text(name: str):
        if kinds[name] != "binary":
            return F.col(name)
        return F.when(F.is_valid_utf8(F.col(name).cast("string")), F.col(name).cast("string")).otherwise(
            F.decode(name, "ISO-8859-1")
        )

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in columns])
    return (
        df.select(F.explode(cells).alias("c"))
        .select(F.lit(table_name).alias("table_name"), "c.column_name", "c.value")
        .where("value IS NOT NULL")
        .distinct()
    )
