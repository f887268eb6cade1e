"""Snapshots, restore, compaction and recovery over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions import paths


def in_subtree(ns: Column, target: str) -> Column:
    """The namespace itself and what is below it; a sibling whose name only starts alike is outside."""
    return (ns == target) | ns.startswith(target + "/")


def as_of(entries: DataFrame, seq_hi: int, target: str | None = None) -> DataFrame:
    """The log as if the target (or everything) had been put back to seq_hi; the rest is untouched."""
    keep = F.col("seq") <= seq_hi
    return entries.where(keep if target is None else keep | ~in_subtree(F.col("ns"), target))


def destroyed(entries: DataFrame, target: str, seq_hi: int) -> int:
    """The last deletion, up to seq_hi, of the target or of a namespace that it lies in; -1 if there is none."""
    names = target.split("/")
    above = [(F.col("ns") == "/".join(names[:i])) & (paths.key(paths.parts(F.col("path"))) == names[i]) for i in range(1, len(names))]
    hit = F.lit(False)
    for one in above:
        hit = hit | one
    found = entries.where((F.col("op") == "DEL") & (F.col("seq") <= seq_hi) & hit).agg(F.max("seq")).first()[0]
    return -1 if found is None else found


def restored(entries: DataFrame, target: str, seq_hi: int, load_seq: int) -> DataFrame:
    """The log (seq, op, path, ns, ...) after a load at load_seq.

    What the target's subtree got between the snapshot and the load is gone. What the snapshot has of it is written again at the
    load, in its order, so that a deletion of the target since then does not mask it; later entries move on by seq_hi.
    """
    inside, seq = in_subtree(F.col("ns"), target), F.col("seq")
    kept = entries.where((seq > load_seq) | ~inside)
    again = entries.where(inside & (seq <= seq_hi) & (seq > destroyed(entries, target, seq_hi)))
    moved = F.when(seq > load_seq, seq + seq_hi).otherwise(seq)
    return kept.withColumn("seq", moved).union(again.withColumn("seq", seq + load_seq))


def snapshot(spark, state_name: str, target_ns: str, seq_hi: int, created_at: str, is_auto: bool = False) -> DataFrame:
    """A row of the snapshot table."""
    schema = "state_name string, target_ns string, seq_hi long, created_at string, is_auto boolean"
    return spark.createDataFrame([(state_name, target_ns, seq_hi, created_at, is_auto)], schema).withColumn("created_at", F.to_timestamp("created_at"))


def load_last(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot that is no autosave."""
    return snapshots.where(~F.col("is_auto")).orderBy(F.desc("created_at"), "state_name").limit(1)


def compact(state: DataFrame) -> DataFrame:
    """The entries of a compacted log: one for each key alive, ranges of (ns, key) in order."""
    return state.repartitionByRange("ns", "key").sortWithinPartitions("ns", "key")


def below(state: DataFrame, target: str) -> DataFrame:
    """(ns) of the target and of every living namespace below it: what a recursive compaction takes."""
    subs = state.where("type = 'SUB'").select(F.col("value").alias("ns")).where(in_subtree(F.col("ns"), target))
    return subs.union(state.sparkSession.createDataFrame([(target,)], "ns string")).distinct()
