"""Row-local work in Arrow batches, with the columns of the input carried along."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as parse

ROWS_A_BATCH = 2_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, columns: list[str] | None = None):
    """All columns (or some) as one struct, so that names of results can't clash with them."""
    columns = df.columns if columns is None else columns
    return F.struct(*[df[quoted(c)] for c in columns]) if columns else F.struct(F.lit(1).alias("none"))


def unpacked(df: DataFrame, results: list[str], row: str = "row") -> DataFrame:
    """The packed columns side by side with `results`. A packed column of the name of a result
    gives way to it, as with withColumn."""
    taken = {r.lower() for r in results}
    inner = [f.name for f in df.schema[row].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col(row)[c].alias(c) for c in inner], *results)


def slices(batches, column: int = 0, most: int = 1 << 20, rows: int = ROWS_A_BATCH):
    """Parts of record batches with about `most` bytes of text in a column, or one text, and its values as
    bytes (null: empty)."""
    for whole in batches:
        texts = [x or b"" for x in whole.column(column).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < min(len(texts), at + rows) and size + len(texts[end]) <= most:
                size += len(texts[end])
                end += 1
            yield whole.slice(at, end - at), texts[at:end]
            at = end


def batched(df: DataFrame, inputs: dict[str, str], keep: list[str] | None, added: str, fn) -> DataFrame:
    """`fn(lists of the input columns) -> lists of the added columns`, batch by batch.

    inputs: name in `fn` -> column; keep: columns that come back (default all); added: DDL of
    the results. `fn` gets Python lists. Batches are bounded in rows, so that memory is
    bounded by so many times the longest texts."""
    kinds = parse(added)
    names = [f.name for f in kinds.fields]
    rows = df.select(packed(df, keep).alias("row"), *[df[quoted(c)].alias(f"in_{n}") for n, c in inputs.items()])
    out = f"row {rows.schema['row'].dataType.simpleString()}, " + added
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kinds.fields]
    many = len(inputs)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                got = fn(*[batch.column(1 + i).to_pylist() for i in range(many)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(got, types)]], names=["row", *names])

    return unpacked(rows.mapInArrow(run, out), names)
