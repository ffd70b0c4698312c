"""JSON arrays read in parts, and written as one file.

A file is cut at every closing brace, which Spark's text reader does split by split, so that one large array is read by many
tasks from any store that Spark reads. Whether a cut lies inside a string, and how deep, is known from what is before
it: each split is first summed up (quotes, and brackets for either state of its start), sums over the splits
before give every split its own start, and then each task picks the records of its splits. Records that go on over a
border are put together from their pieces.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.session import cut, new_folder

CLOSE = "}"
ESCAPED = re.compile(rb"\\.", re.S)
STRING = re.compile(rb'"[^"]*"')
BETWEEN = re.compile(rb"[\s,\[\]]*")


def scan(text: bytes, inside: bool) -> tuple[bool, int]:
    """Whether the text ends inside a string, and how many brackets more it opens than it closes.

    Escapes go first, wherever they are: outside strings there are none. So every quote left changes the state, whatever it was."""
    text = ESCAPED.sub(b"", text)
    if inside:
        end = text.find(b'"')
        if end < 0:
            return True, 0
        text = text[end + 1 :]
    bare = STRING.sub(b"", text)
    start = bare.find(b'"')
    if start >= 0:
        bare = bare[:start]
    return start >= 0, bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def _splits(batches, fresh, step, done):
    """Calls fresh(file, block, row) at the first row of each split, step(state, text) for its rows, done(key, state) after."""
    key = state = None
    for batch in batches:
        files, blocks, texts = (batch.column(i).to_pylist() for i in range(3))
        for i, (file, block, text) in enumerate(zip(files, blocks, texts)):
            if (file, block) != key:
                if key is not None:
                    yield from done(key, state)
                key, state = (file, block), fresh(batch, i, text)
            yield from step(key, state, text.encode() if isinstance(text, str) else text)
    if key is not None:
        yield from done(key, state)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _starts(fragments: DataFrame) -> DataFrame:
    """One row per split: file, block, inside and depth at its start, and the depth of records in its file."""
    names = ["file", "block", "array", "odd", "from_outside", "from_inside"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        def fresh(batch, i, text):
            return {"array": text.lstrip()[:1] == "[", "inside": [False, True], "depth": [0, 0]}

        def step(key, state, text):
            for s in (0, 1):
                state["inside"][s], more = scan(text, state["inside"][s])
                state["depth"][s] += more - (not state["inside"][s])
            return ()

        def done(key, state):
            yield (*key, state["array"], int(state["inside"][0]), *state["depth"])

        rows = list(_splits(batches, fresh, step, done))
        if rows:
            yield _table(rows, names, types)

    sums = cut(fragments.mapInArrow(run, "file string, block long, array boolean, odd int, from_outside long, from_inside long"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file").orderBy("block")
    rows = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("own", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    return cut(rows.select(
        "file", "block", "inside", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("depth"), F.first("array").over(within).cast("int").alias("base"),
    ))


def _picked(fragments: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, kind, place, text): records that begin in a split by their place in it (kind 1: whole, 2: it
    goes on in the next split), and what a split has of a record begun before (kind 3: its end, 4: it goes on)."""
    names, types = ["file", "block", "kind", "place", "text"], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    known = F.broadcast(starts.withColumnRenamed("file", "f").withColumnRenamed("block", "b"))
    rows = fragments.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", "block", "text", "inside", "depth", "base")

    def run(batches):
        def fresh(batch, i, text):
            inside, depth, base = (batch.column(c)[i].as_py() for c in (3, 4, 5))
            return {"inside": inside, "depth": depth, "base": base, "held": [], "begun": inside or depth > base, "came": inside or depth > base, "place": 0}

        def step(key, state, text):
            if not state["begun"]:
                lead = BETWEEN.match(text).end()
                if text[lead : lead + 1] != b"{":
                    # Behind the last record there is no brace; the reader ends the file with a cut all the same.
                    if text[lead:]:
                        raise ValueError(f"{key[0]}: not an array of objects, near {text[lead:lead + 40]!r}")
                    return
                text, state["begun"], state["depth"] = text[lead:], True, state["base"]
            state["inside"], more = scan(text, state["inside"])
            state["depth"] += more - (not state["inside"])
            state["held"] += [text, b"}"]
            if state["depth"] <= state["base"] and not state["inside"]:
                yield (*key, 3 if state["came"] else 1, state["place"], b"".join(state["held"]))
                state["place"] += not state["came"]
                state["held"], state["begun"], state["came"] = [], False, False

        def done(key, state):
            if state["held"]:
                yield (*key, 4 if state["came"] else 2, state["place"], b"".join(state["held"]))

        rows, size = [], 0
        for row in _splits(batches, fresh, step, done):
            rows.append(row)
            size += len(row[4])
            if size > 4 << 20:
                yield _table(rows, names, types)
                rows, size = [], 0
        if rows:
            yield _table(rows, names, types)

    return rows.mapInArrow(run, "file string, block long, kind int, place long, text binary")


def records(spark: SparkSession, path) -> DataFrame:
    """(ordinal, text): the objects of the arrays in the files at `path`, by path, then place.

    A file may also be one object, or objects one after the other. Anything else than objects in an array raises, and so does a file
    that ends inside a record. An empty array gives no row. Splits follow spark.sql.files.maxPartitionBytes."""
    raw = spark.read.option("lineSep", CLOSE).text(path)
    fragments = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    picked = cut(_picked(fragments, _starts(fragments)))
    # At most two rows a split are pieces; those of a record follow the split that it begins in.
    pieces = picked.where("kind > 1")
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == 2, 1).otherwise(0))
    chained = pieces.withColumn("head", F.last(F.when(F.col("kind") == 2, F.struct("block", "place")), ignorenulls=True).over(order))
    whole = chained.groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"), F.max(F.when(F.col("kind") == 3, 1).otherwise(0)).alias("ended")
    )
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.text))")
    text = F.when(F.col("ended") == 1, joined).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": ends inside a record"))).cast("binary"))
    every = picked.where("kind = 1").select("file", "block", "place", "text").unionByName(whole.select("file", "head.block", "head.place", text.alias("text")))
    counts = picked.where("kind < 3").groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    below = F.broadcast(counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below")))
    return every.join(below, ["file", "block"]).select((F.col("below") + F.col("place")).alias("ordinal"), F.col("text").cast("string").alias("text"))


def read_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """`schema` and ordinal: the records of `path`, parsed; one that does not parse raises."""
    parsed = records(spark, path).select("ordinal", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("ordinal", "r.*")


def write_array(df: DataFrame, path: str, order: list | None = None) -> None:
    """One JSON array at `path`, a record per row, in the order of the columns `order`.

    All tasks write their records to a folder of its own, which a failed task or job leaves unpublished; the parts are
    then put behind one another in a file beside `path`, which replaces it in one step. So a reader finds the old
    array or the new one. The driver hands the parts on through one small buffer, whatever their size; an array in one file
    is for what others load whole, and `write_records` has no such step."""
    spark = df.sparkSession
    rows = df.orderBy(*order) if order else df
    folder = new_folder(spark, "array")
    # Null fields are written, so that records have all their keys.
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows.select(F.concat(F.lit(","), record).alias("value")).write.text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    source = hadoop.Path(folder).getFileSystem(conf)
    target = hadoop.Path(path)
    store, scratch = target.getFileSystem(conf), hadoop.Path(f"{path}.{folder.rsplit('-', 1)[-1]}.tmp")
    parts = [f.getPath() for f in source.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("part-") and f.getLen()]
    try:
        out = store.create(scratch, True)
        out.writeBytes("[")
        for i, part in enumerate(sorted(parts, key=lambda p: int(p.getName().split("-")[1]))):
            stream = source.open(part)
            if not i:
                stream.read()  # no separator before the first record
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.writeBytes("]\n")
        out.close()
        overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(scratch), store.makeQualified(target), overwrite)
    finally:
        store.delete(scratch, False)
        source.delete(hadoop.Path(folder), True)
