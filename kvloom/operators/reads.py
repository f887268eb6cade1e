"""Reads over a state table (ns, key, type, value, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions import paths, render
from kvloom.functions.infer import TOMBSTONE

MISS = "ERROR: Key not found."


def located(requests: DataFrame, path_col: str = "path") -> DataFrame:
    """Requests with the ns and key that their paths address."""
    p = paths.parts(F.col(path_col))
    return requests.withColumn("ns", paths.namespace(p)).withColumn("key", paths.key(p))


def get(state: DataFrame, path: str) -> DataFrame:
    """(path, value) of one path; the miss text if there is none. Namespace and key are constants, so their filter reaches the scan."""
    ns, key = place(path)
    found = state.where((F.col("ns") == ns) & (F.col("key") == key)).agg(F.max("value").alias("value"), F.count("*").alias("n"))
    value = F.when(F.col("n") > 0, F.coalesce("value", F.lit(""))).otherwise(MISS)
    return found.select(F.lit(path).alias("path"), value.alias("value"))


def place(path: str) -> tuple[str, str]:
    """The namespace and key that a path addresses."""
    *folders, key = path.split("/")
    return "/".join([paths.ROOT, *[s for s in folders if s]]), key


def multi_get(state: DataFrame, requests: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, value) for every requested path."""
    asked = located(requests, path_col)
    return asked.join(state.select("ns", "key", "value"), ["ns", "key"], "left").select(path_col, F.coalesce("value", F.lit(MISS)).alias("value"))


def get_types(state: DataFrame, requests: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, type) for every requested path; TOMBSTONE if there is nothing."""
    asked = located(requests, path_col)
    return asked.join(state.select("ns", "key", "type"), ["ns", "key"], "left").select(path_col, F.coalesce("type", F.lit(TOMBSTONE)).alias("type"))


def in_range(start: str, end: str, key: str = "key") -> Column:
    """Both ends count; an empty end is no bound."""
    low = F.col(key) >= start
    return low & (F.col(key) <= end) if end else low


def range_scan(state: DataFrame, start: str, end: str, ns: str = paths.ROOT) -> DataFrame:
    """(key, value) of one namespace by key."""
    return state.where(F.col("ns") == ns).where(in_range(start, end)).select("key", "value").orderBy("key")


def successor(prefix: str) -> str:
    """The prefix with its last byte, as Latin-1, one higher; what the inclusive bound of the compatible scan uses."""
    return prefix[:-1] + chr((ord(prefix[-1]) + 1) % 256) if prefix else ""


def prefix_scan(state: DataFrame, prefix: str, compat: bool = False) -> DataFrame:
    """(key, value) below the directory of a prefix, keys with that directory in front. compat: the bound counts too."""
    folder, _, rest = prefix.rpartition("/")
    segments = [s for s in folder.split("/") if s]
    ns = "/".join([paths.ROOT, *(segments[1:] if segments[:1] == [paths.ROOT] else segments)])
    if not rest:
        match = F.lit(True)
    else:
        match = F.col("key").between(rest, successor(rest)) if compat else F.col("key").startswith(rest)
    shown = F.concat(F.lit(folder + "/"), "key") if folder else F.col("key")
    return state.where(F.col("ns") == ns).where(match).select(shown.alias("key"), "value").orderBy("key")


def list_keys(state: DataFrame, ns: str = paths.ROOT) -> DataFrame:
    """The keys of a namespace in order; values are not read."""
    return state.where(F.col("ns") == ns).select("key").orderBy("key")


def ls(state: DataFrame, ns: str = paths.ROOT) -> DataFrame:
    """A directory listing, one line a key."""
    return state.where(F.col("ns") == ns).orderBy("key").select(render.listing(F.col("key"), F.col("type")).alias("line"))


def merge_runs(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key out of runs of equal schema, the newest run first: that of the first run that has it."""
    rows = None
    for priority, run in enumerate(runs):
        run = run.withColumn("_priority", F.lit(priority))
        rows = run if rows is None else rows.unionByName(run)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_priority"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_priority")


def resolve(namespaces: DataFrame, requests: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, ns) of directory paths; null if there is no such namespace. namespaces: (ns)."""
    full = F.array_join(F.concat(F.array(F.lit(paths.ROOT)), paths.resolve(F.col(path_col))), "/")
    asked = requests.withColumn("_ns", full)
    return asked.join(namespaces.select("ns").distinct(), F.col("_ns") == F.col("ns"), "left").select(path_col, "ns")


def members(rows: DataFrame, keys: DataFrame, on: list[str], inside: bool = True) -> DataFrame:
    """Exact membership: the rows whose key is (or is not) among the keys."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi" if inside else "left_anti")
