"""Streaming ingestion: files of mutations are appended to a store's log; the batch fold stays the truth."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from kvloom.sources.store import LOG, Store


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends what arrives in a folder of Parquet mutations, each file once."""

    def append(batch, _: int) -> None:
        store.append(batch)

    stream = spark.readStream.schema(LOG).parquet(folder)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
