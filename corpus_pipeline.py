"""Training-data pipeline: stages over `documents`, each written and read again for the next.

An empty table goes through all stages as one; other columns than those of `documents` are carried along.
The stages set the session's `spark.sql.execution.arrow.maxBytesPerBatch` to `BATCH_BYTES`."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import corpuslab
from corpuslab.llm import neardup, quality, secretscan, tiling, wordbpe
from corpuslab.session import new_folder

# Functions go to the workers by value, so these need not have the package on their path.
cloudpickle.register_pickle_by_value(corpuslab)


#: Bytes of a batch that a task sends to its Python worker, or one row: both hold a batch whole, in several forms.
BATCH_BYTES = 4 << 20


def light(stage):
    """The stage, run with batches of `BATCH_BYTES`. Which rows share a batch changes no result."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@light
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does. Null and empty texts fail; a null source is judged by the text
    alone; repeated rows are judged alike."""
    return quality.judged(docs, host="source").where("kept").select(docs.columns)


@light
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (null ids last); of rows alike in id and text any
    one. Texts without words are in no group and stay."""
    return neardup.thinned(docs, size=5, percent=80)


@light
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none, and null or empty items are in none."""
    return tiling.cleaned(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


@light
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts. Null texts stay null, repeated rows stay repeated."""
    model = secretscan.train(secretscan.samples(docs))
    # The masked text comes back in place of the text, which goes to the tasks once.
    out = secretscan.scanned(docs, model, keep=[c for c in docs.columns if c != "text"], masked="[SECRET]")
    return out.select([out["masked_text"].alias(c) if c == "text" else out[c] for c in docs.columns])


@light
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the texts that they decode to, in place of the text. A null text has no ids."""
    return wordbpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=[c for c in docs.columns if c != "text"], forget=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", bpe),
]

#: Markov models, sketches, tilings and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
