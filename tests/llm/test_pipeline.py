"""The stages one after the other on a small folder, against what each must do."""

import random

import pytest

import corpus_pipeline
from corpuslab.session import new_folder

SECRET = "3f" * 20


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    item, base = prose(30), prose(120)
    words = item.split()
    texts = {
        1: base, 2: base, 3: base + " end", 4: prose(20), 5: prose(100) + " " + item + " " + prose(100), 6: prose(90) + " " + " ".join(words[15:] + words[:15]),
        7: prose(100) + f' token = "{SECRET}"', 8: prose(200), 9: "spam spam spam spam " * 40, 10: None,
    }
    place = new_folder(spark, "pipeline")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_run(spark, small):
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(out) == {1, 7, 8}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert out[1]["bpe_ids"] == lib.encode(docs[1], add_special_tokens=False).ids
    masked = docs[7].split("token = ")[0] + "[SECRET]\""
    assert out[7]["bpe_ids"] == lib.encode(masked, add_special_tokens=False).ids


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"] for r in out.collect()}
        assert stage(spark, docs.where("false"), small).count() == 0
    assert kept == {"quality_rules": {1, 2, 3, 5, 6, 7, 8}, "near_duplicates": {1, 4, 5, 6, 7, 8, 9, 10}, "decontamination": {1, 2, 3, 4, 7, 8, 9, 10}, "secrets": set(range(1, 11))}


def test_memory_of_a_task(spark, small, monkeypatch):
    """Texts go to the tasks once, in batches bounded in bytes."""
    kept, scanned = [], corpus_pipeline.secretscan.scanned
    monkeypatch.setattr(corpus_pipeline.secretscan, "scanned", lambda *a, **k: kept.append(k["keep"]) or scanned(*a, **k))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.secrets(spark, docs, small)
    assert "text" not in kept[0] and out.columns == docs.columns
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == corpus_pipeline.BATCH_BYTES
