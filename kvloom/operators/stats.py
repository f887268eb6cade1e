"""Statistics of a plain log (ns, key, ...) and its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(entries: DataFrame, state: DataFrame) -> DataFrame:
    """(ns, live_keys, total_entries, waste_ratio): keys alive by entries written."""
    total = entries.groupBy("ns").agg(F.count("*").alias("total_entries"))
    live = state.groupBy("ns").agg(F.count("*").alias("live_keys"))
    both = total.join(live, "ns", "full").select("ns", F.coalesce("live_keys", F.lit(0)).alias("live_keys"), F.coalesce("total_entries", F.lit(0)).alias("total_entries"))
    ratio = F.when(F.col("total_entries") > 0, 1 - F.col("live_keys").cast("double") / F.col("total_entries")).otherwise(F.lit(0.0))
    return both.withColumn("waste_ratio", ratio)
