"""A store on Parquet: an append-only log, sorted runs of what was flushed or compacted, and a manifest that names them.

A read is the fold of the current base run, of the runs flushed since, and of the log's tail behind them. Runs hold (ns, key, ...)
in order, so that a read of one key, or of a range, reaches their scans as a filter on row groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import paths
from kvloom.functions.infer import SUB
from kvloom.operators import fold, reads

LOG = "seq long, op string, path string, value string"
RUN = "ns string, key string, seq long, op string, path string, value string"
MANIFEST = "version long, kind string, folder string, after long, upto long"


class Store:
    """log/ takes batches of mutations; runs/<name>/ are sorted by (ns, key, seq); versions/ is the manifest.

    A run covers the log up to a seq: a base run all of it, folded; a delta run what came after another seq. Folders have names of
    their own, so that two writers never meet in one. The base that covers the most of the log counts, and behind it those delta
    runs that each begin where the one before ends; whatever they don't cover is read from the log.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, mutations: DataFrame) -> None:
        """Adds a batch to the log."""
        mutations.select("seq", "op", "path", "value").write.mode("append").parquet(f"{self.folder}/log")

    def log(self) -> DataFrame:
        """The whole log; segment is the file that a row is in."""
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log").withColumn("segment", F.col("_metadata.file_name"))

    def manifest(self) -> list[tuple[int, str, str, int, int]]:
        """(version, kind, folder, after, upto) of every run, oldest first; one row a flush or compaction."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/versions").collect()
        except Exception as e:  # there is no such folder before the first run
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(map(tuple, rows))

    def current(self) -> tuple[str | None, list[str], int]:
        """The base run's folder, those of the delta runs behind it, and the seq that they cover the log up to."""
        rows = self.manifest()
        upto, base = max(((last, folder) for _, kind, folder, _, last in rows if kind == "base"), default=(-1, None))
        deltas = []
        while following := [(last, folder) for _, kind, folder, after, last in rows if kind == "delta" and after == upto]:
            upto, folder = max(following)
            deltas.append(folder)
        return base, deltas, upto

    def current_version(self) -> int | None:
        """The newest version; None before the first run."""
        return max((r[0] for r in self.manifest()), default=None)

    def _write_run(self, rows: DataFrame, kind: str, after: int, upto: int) -> int:
        version, folder = (self.current_version() or 0) + 1, f"{kind}-{uuid.uuid4().hex}"
        (
            rows.repartitionByRange("ns", "key").sortWithinPartitions("ns", "key", "seq")
            .write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.folder}/runs/{folder}")
        )
        named = self.spark.createDataFrame([(version, kind, folder, after, upto)], MANIFEST)
        named.coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return version

    def _scan(self, folder: str, where: Column | None) -> DataFrame:
        run = self.spark.read.schema(RUN).parquet(f"{self.folder}/runs/{folder}")
        return run if where is None else run.where(where)

    def _tail(self, after: int, upto: int | None = None) -> DataFrame:
        """The log behind a seq, placed; the bounds reach the scan."""
        log = self.spark.read.schema(LOG).parquet(f"{self.folder}/log").where(F.col("seq") > after)
        log = log if upto is None else log.where(F.col("seq") <= upto)
        p = paths.parts(F.col("path"))
        return log.select(paths.namespace(p).alias("ns"), paths.key(p).alias("key"), "seq", "op", "path", "value")

    def mutations(self, where: Column | None = None) -> DataFrame:
        """The log that the current runs and the tail stand for; where: on ns and key, what of it is wanted.

        Whether a CONVERT holds may follow from other keys of its namespace: if one is among the wanted rows, all rows are read.
        """
        base, deltas, upto = self.current()
        out = self._tail(upto) if where is None else self._tail(upto).where(where)
        for folder in deltas:
            out = out.unionByName(self._scan(folder, where))
        if where is not None and not out.where("op = 'CONVERT'").isEmpty():
            return self.mutations()
        return (out.unionByName(self._scan(base, where)) if base else out).select("seq", "op", "path", "value")

    def invalidate(self) -> None:
        """Forgets what Spark keeps of the store's files, after others wrote or removed some."""
        self.spark.catalog.refreshByPath(self.folder)

    def state(self) -> DataFrame:
        """Everything alive."""
        return fold.state(self.mutations())

    def get(self, path: str) -> DataFrame:
        """(path, value) of one path: only rows of the key, of the namespaces that it lies in and of what lies below it are read."""
        return reads.get(fold.state(self.mutations(touching(path))), path)

    def range_scan(self, start: str, end: str, ns: str = paths.ROOT) -> DataFrame:
        """(key, value) of one namespace by key, both ends included."""
        wanted = ((F.col("ns") == ns) & reads.in_range(start, end)) | above(ns)
        inside = F.col("ns").startswith(ns + "/") & (F.col("ns") >= f"{ns}/{start}")  # what lies below a key makes it a namespace
        return reads.range_scan(fold.state(self.mutations(wanted | inside)), start, end, ns)

    def flush(self) -> int | None:
        """Writes the tail alone as a delta run; None if there is none. Nothing that was flushed before is read."""
        _, _, after = self.current()
        upto = self.spark.read.schema(LOG).parquet(f"{self.folder}/log").where(F.col("seq") > after).agg(F.max("seq")).first()[0]
        return None if upto is None else self._write_run(self._tail(after, upto), "delta", after, upto)

    def write_run(self, state: DataFrame, upto: int) -> int:
        """A base run of a state: a key is a PUT of its value, a namespace a SPAWN."""
        name = F.concat(F.substr("ns", F.lit(len(paths.ROOT) + 2)), F.when(F.col("ns") == paths.ROOT, F.lit("")).otherwise(F.lit("/")), "key")
        op = F.when(F.col("type") == SUB, F.lit("SPAWN")).otherwise(F.lit("PUT"))
        rows = state.select("ns", "key", "seq", op.alias("op"), name.alias("path"), F.when(F.col("type") != SUB, F.col("value")).otherwise("").alias("value"))
        return self._write_run(rows, "base", -1, upto)

    def compact(self) -> int:
        """Folds runs and tail into a new base run; readers of the old ones are not disturbed."""
        _, _, after = self.current()
        found = self.spark.read.schema(LOG).parquet(f"{self.folder}/log").agg(F.max("seq")).first()[0]
        upto = after if found is None else max(after, found)
        return self.write_run(fold.state(self.mutations().where(F.col("seq") <= upto)), upto)


def above(ns: str) -> Column:
    """The entries of a namespace and of those that it lies in."""
    names = ns.split("/")
    out = F.lit(False)
    for i in range(1, len(names)):
        out = out | ((F.col("ns") == "/".join(names[:i])) & (F.col("key") == names[i]))
    return out


def touching(path: str) -> Column:
    """The entries that a path's state may follow from: its own, those of namespaces above it, and all below it."""
    ns, key = reads.place(path)
    own = f"{ns}/{key}"
    return above(ns) | ((F.col("ns") == ns) & (F.col("key") == key)) | (F.col("ns") == own) | F.col("ns").startswith(own + "/")
