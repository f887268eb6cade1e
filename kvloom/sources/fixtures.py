"""Mutation logs made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(col: str, n: int):
    return F.lpad(F.col(col).cast("string"), n, "0")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key a user; an error deletes it, anything else puts its props."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op"),
        F.concat(F.lit("user_"), padded("user_id", 5)).alias("path"), F.col("props").alias("value"),
    )


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace for each event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("PUT").alias("op"),
        F.concat(F.col("event_type"), F.lit("/user_"), padded("user_id", 5)).alias("path"), F.col("props").alias("value"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lit("PUT").alias("op"), F.concat(F.lit("ord_"), padded("o_orderkey", 9)).alias("path"), F.col("o_orderpriority").alias("value")
    )


def orders_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys are unique, so the log is its own state."""
    return orders(spark, sf_dir).select(F.lit("root").alias("ns"), F.col("path").alias("key"), F.lit("STRING").alias("type"), "value", "seq")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/nation/customer paths."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("seq"), F.lit("PUT").alias("op"), F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.col("c_mktsegment").alias("value"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("PUT").alias("op"),
        F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("/turn_"), F.col("turn")).alias("path"), F.col("text").alias("value"),
    )


def script(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A log of (op, path, value) in order."""
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "seq long, op string, path string, value string")
