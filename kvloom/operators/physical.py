"""Physical layout: sparse index, filter placement, log segments and flush boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions import hashing
from kvloom.operators.lineage import settled

SEGMENT_BYTES = 5 * 1024 * 1024
MEMTABLE_ROWS = 100_000
EVERY = 100


def sparse_index(keys: DataFrame, every: int = EVERY, bucket_rows: int = 1 << 16) -> DataFrame:
    """(key, position) of every so many-th key in order: positions from counts of ranges, so that no task sees all keys. The ranges are settled, as two steps read them."""
    ranged = keys.select("key").repartitionByRange("key").select("key", F.spark_partition_id().alias("_part"))
    ranged = settled(ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("key")) - 1))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(before.select("_part", "_before")), "_part")  # a row for each task
    return placed.withColumn("position", F.col("_own") + F.col("_before")).where(F.col("position") % every == 0).select("key", "position")


def filter_placement(keys: DataFrame) -> DataFrame:
    """(key, h, fp, bucket, other) of the membership filter."""
    hashed = keys.select("key").withColumn("h", hashing.fnv1a(F.col("key")))
    hashed = hashed.withColumn("fp", hashing.fingerprint(F.col("h"))).withColumn("bucket", hashing.bucket(F.col("h")))
    return hashed.withColumn("other", hashing.other_bucket(F.col("bucket"), F.col("fp")))


def segments(entries: DataFrame, cap: int = SEGMENT_BYTES) -> DataFrame:
    """(seq, bytes, segment): greedy rotation, a new segment before an entry that would go over the cap.

    The rule is sequential by nature; only (seq, bytes) go to the one task that walks the log in order.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, number = 0, 0
        for batch in batches:
            out = []
            for n in batch["bytes"].tolist():
                if used and used + n > cap:
                    used, number = 0, number + 1
                used += n
                out.append(number)
            yield batch.assign(segment=out)

    return entries.select("seq", "bytes").repartition(1).sortWithinPartitions("seq").mapInPandas(walk, "seq long, bytes long, segment long")


def pointers(entries: DataFrame, cap: int = SEGMENT_BYTES) -> DataFrame:
    """(seq, segment, offset, bytes): where each entry of the log lies; a segment is a window."""
    before = Window.partitionBy("segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = settled(segments(entries, cap))
    return placed.select("seq", "segment", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long").alias("offset"), "bytes")


def point_read(asked: DataFrame, log: DataFrame) -> DataFrame:
    """asked(segment, offset, ...) with the value and found, of log(segment, offset, value); a place without an entry reads as a tombstone."""
    entries = log.select("segment", "offset", "value", F.lit(True).alias("found"))
    return asked.join(entries, ["segment", "offset"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def flushes(mutations: DataFrame, limit: int = MEMTABLE_ROWS) -> DataFrame:
    """(seq, run): the sorted run that each new key's first write since the last flush goes to, for a log of distinct keys.

    A write flushes first if the table is full, so run = (keys before it) / limit.
    """
    ranked = mutations.select("seq").repartitionByRange("seq").select("seq", F.spark_partition_id().alias("_part"))
    ranked = settled(ranked.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("seq")) - 1))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(F.broadcast(before.select("_part", "_before")), "_part")
    return placed.select("seq", F.floor((F.col("_own") + F.col("_before")) / limit).alias("run"))


def corrupted(entries: DataFrame) -> DataFrame:
    """Entries (key, value, type, crc) whose checksum is not that of their content."""
    return entries.where(F.col("crc") != hashing.entry_crc(F.col("key"), F.col("value"), F.col("type")))
