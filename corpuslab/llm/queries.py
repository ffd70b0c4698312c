"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import chat, exactdup, licenses, linkgraph, neardup, quality, resample, secretscan, tiling, tokencount, vectorcodes, warc, wordbpe
from corpuslab.llm.oracles import ORACLES  # noqa: F401  registered beside QUERIES
from corpuslab.session import new_folder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = quality.judged(docs, host="source", keep=["doc_id", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = secretscan.train(secretscan.samples(docs))
    return secretscan.scanned(docs, model, keep=["doc_id"])


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_folder(spark, "warc")
    files = warc.written(warc.captures(table(spark, folder, "pages")), archives)
    whole = warc.assembled(warc.records(files, archives, payload=False))
    rows = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        F.col("page").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"),
    )


def op4_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    out = wordbpe.encode(table(spark, folder, "documents"), WORD_BPE, keep=["doc_id"], texts=False)
    return out.select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))


#: Argument schemas of the tools that conversations are read as using.
TOOLS = {
    "ask": {"query": {"type": "string", "required": True}, "words": {"type": "integer", "required": True, "minimum": 1, "maximum": 80}, "turn": {"type": "integer"}},
    "tell": {"query": {"type": "string", "required": True}, "words": {"type": "integer", "required": True}, "turn": {"type": "integer", "maximum": 3}},
}


def conversation_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as calls, and the user turns after them as their results. A call depends on
    the assistant turn before it, two turns back, if there is one."""
    name = F.when(F.col("turn") % 2 == 1, "ask").otherwise("tell")
    call_id = F.concat_ws(":", "conv_id", "turn")
    words = F.size(F.filter(F.split("text", "[\x20\x09-\x0d]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text").alias("query"), F.when(F.length("text") > 0, words).alias("words")))
    calls = rows.where("role = 'assistant'").select(
        "conv_id", "turn", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.array(F.concat_ws(":", F.col("conv_id"), F.col("turn") - 2)).alias("depends_on"),
    )
    results = rows.where("role = 'user'").select(F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), "conv_id", "turn", "text")
    return calls, results


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with their results, and the other turns as messages."""
    turns = table(spark, folder, "conversations")
    calls, results = conversation_calls(turns)
    out = chat.formatted(calls, results.select("call_id", "text"), TOOLS).select(
        "conv_id", "turn", F.lit("assistant").alias("role"), "call_id", "name", "level", "n_results", "valid", F.array_join("errors", "; ").alias("errors"), F.col("call_json").alias("json")
    )
    rest = chat.messages(turns, calls, results).withColumnRenamed("message_json", "json")
    return out.unionByName(rest, allowMissingColumns=True)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"), licenses.template_table(spark))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.grouped(table(spark, folder, "documents"), size=3, percent=85).drop("text_key")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.counts(table(spark, folder, "documents"), PIECE_BPE, TOKEN_LIMIT, keep=["doc_id"])


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    out = linkgraph.judged(table(spark, folder, "pages"))
    return out.withColumn("trust", F.round("trust", 12)).withColumn("distrust", F.round("distrust", 12))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, folder, "embeddings")).drop("label")


def op12_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.grouped(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scans, op3_warc, op4_bpe_codec, op5_chat_format, op6_license_scan,
        op7_near_duplicates, op8_token_counts, op9_decontamination, op10_url_filter, op11_vector_codes,
        op12_exact_duplicates, op13_importance_resampling, pipeline,
    )
}
