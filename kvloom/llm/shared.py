"""What several operators need: the shared checkpoint folder, and row helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order value of a row without an id: after every real id.
LAST_ID = (1 << 63) - 1
#: A key is hot if it has more than one row in so many, and more rows than one task does well.
HOT_SHARE, HOT_ROWS = 1000, 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may do without, with a folder of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kvloom-shared-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fitted(df: DataFrame, rows: int = 1 << 15) -> DataFrame:
    """A checkpointed table of short rows, in as few partitions as its rows need: many near-empty ones cost driver and disks more than their rows."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage now: Spark keeps the shuffles, broadcasts and checkpoints that nothing refers to until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder below the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, at_least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def order_id(name: str = "doc_id") -> Column:
    """The id as an order value; null ids come last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def joined_by(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key, and `rows`: how many of left's `total` rows have the key.

    Keys of more than one row in HOT_SHARE are fewer than HOT_SHARE, so they may be sent to every task; the rest is joined by the
    shuffle, where no key is a hot one. Keys without a row in right are left out; null keys too. right is read twice, and should be
    checkpointed.
    """
    least = max(total // HOT_SHARE, HOT_ROWS)
    if right.where(F.col(rows) > least).isEmpty():
        return left.join(right.drop(rows), key)
    hot = F.broadcast(right.where(F.col(rows) > least).drop(rows))  # fewer than HOT_SHARE rows
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) <= least).drop(rows), key)
    return left.join(hot, key).unionByName(cold)
