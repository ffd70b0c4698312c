"""Incremental form of the collection ingest: each micro-batch of arriving samples is a
dataset of its own, so a batch that is replayed after a failure is added once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpuslab.sources.collection import VectorCollection


def ingest_stream(
    samples: DataFrame, collection: VectorCollection, dataset: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    def add(batch: DataFrame, batch_id: int) -> None:
        collection.insert(batch.dropDuplicates(["id"]), f"{dataset}#{batch_id}", dataset)

    writer = samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
