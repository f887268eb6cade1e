"""The fold: from a totally ordered mutation log to the state of every key in every namespace.

mutations(seq, op, path, value); op is PUT, DEL, SPAWN or CONVERT. A deletion kills everything below its path,
whatever it was. Within the time since its last kill a path is a namespace from the first structural event on:
a SPAWN, a PUT or SPAWN below it, or a CONVERT whose parent was a namespace then. So the state needs no
row-at-a-time replay: kills by an as-of window, births and last values by aggregation with map-side combine.

Three more operations come from stores, not from users: DROP is a deletion that no namespace counts as an entry;
COMPACT and RESET name a namespace, whose entries are counted anew from its live keys, or from none.

Paths are texts that begin with a slash; the root is the empty text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions import paths
from kvloom.functions.infer import SUB, TOMBSTONE, infer_type
from kvloom.operators.lineage import settled

KILLS = ("DEL", "DROP")
#: Their paths name a namespace, and not a key.
FOLDERS = ("COMPACT", "RESET")
#: The log's time is cut into buckets of about so many rows, so that events below a hot path are dealt to many tasks; so many at most.
BUCKET_ROWS, BUCKETS = 1 << 16, 1024
FIRST = -(1 << 62)


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by the order columns; ties go to the greatest of the other columns."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("last")).select(*keys, *[F.col("last")[c].alias(c) for c in [*order, *columns]])


def simple_state(mutations: DataFrame) -> DataFrame:
    """(ns, key, seq, type, value) of a log of PUT and DEL alone; the tombstones go last."""
    p = paths.parts(F.col("path"))
    rows = mutations.select(
        paths.namespace(p).alias("ns"), paths.key(p).alias("key"), "seq",
        F.when(F.col("op") == "DEL", F.lit(TOMBSTONE)).otherwise(infer_type(F.coalesce("value", F.lit("")))).alias("type"),
        F.when(F.col("op") != "DEL", F.coalesce("value", F.lit(""))).alias("value"),
    )
    return latest(rows, ["ns", "key"], ["seq"], ["type", "value"]).where(F.col("type") != TOMBSTONE)


def text_of(segments: Column) -> Column:
    """The path text of segments."""
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise("")


def depth(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def head(p: Column, n: Column) -> Column:
    """The ancestor of a path at a depth."""
    return F.call_function("substring_index", p, F.lit("/"), n + 1)


def parent(p: Column) -> Column:
    return F.left(p, F.length(p) - F.length(key(p)) - 1)


def key(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def paths_name(p: Column) -> Column:
    """The full path of a namespace."""
    return F.concat(F.lit(paths.ROOT), p)


def normalised(mutations: DataFrame) -> DataFrame:
    """The log (seq, op, value, p) with its paths in one form, in the shared folder, since several steps read it."""
    p = F.when(F.col("op").isin(*FOLDERS), text_of(paths.resolve(F.col("path")))).otherwise(text_of(paths.parts(F.col("path"))))
    return settled(mutations.select(F.col("seq").cast("long").alias("seq"), "op", F.coalesce("value", F.lit("")).alias("value"), p.alias("p")))


@dataclass(frozen=True)
class Shape:
    """What a log has: steps that it can do without are left out."""

    rows: int
    last: int
    deepest: int
    structural: bool
    converted: int
    killed: tuple[int, ...]
    restarted: bool


def shape(log: DataFrame) -> Shape:
    """The shape of a normalised log: a few numbers, and the depths of deleted paths."""
    op, d = F.col("op"), depth(F.col("p"))
    r = log.agg(
        F.count("*"), F.max("seq"), F.max(F.when(op.isin("PUT", "SPAWN"), d)), F.count_if(op.isin("SPAWN", "CONVERT")), F.max(F.when(op == "CONVERT", d)),
        F.sort_array(F.collect_set(F.when(op.isin(*KILLS), d))), F.count_if(op.isin(*FOLDERS)),
    ).first()
    return Shape(r[0], r[1] or 0, r[2] or 0, r[3] > 0, r[4] or 0, tuple(r[5]), r[6] > 0)


def _kills(log: DataFrame) -> DataFrame:
    return log.where(F.col("op").isin(*KILLS)).select(F.col("p").alias("d"), "seq")


def _tries(points: DataFrame, killed: tuple[int, ...]) -> DataFrame:
    """Points with d: the path itself and its ancestors, at the depths of deleted paths alone."""
    at = F.explode(F.filter(F.array(*map(F.lit, killed)), lambda n: n <= depth(F.col("p"))))
    return points.withColumn("_n", at).withColumn("d", head(F.col("p"), F.col("_n"))).drop("_n")


def kills_as_of(points: DataFrame, log: DataFrame, s: Shape) -> DataFrame:
    """points(p, t, ...) with k: the last deletion of p or of an ancestor before t, else -1.

    The points below a deleted path and its deletions are put in order together, so that each is one row, however often the path
    was deleted. A bucket of time is a window; it begins with the last deletion of the buckets before.
    """
    if not s.killed:
        return points.withColumn("k", F.lit(-1).cast("long"))
    kills, none, buckets = _kills(log), F.lit(None), min(BUCKETS, 1 + s.rows // BUCKET_ROWS)
    bucket = lambda t: F.floor(F.col(t) / max(1, -(-(s.last + 1) // buckets)))
    tries = _tries(points.select("p", "t").distinct(), s.killed)
    if buckets > 1:
        tries = tries.join(kills.select("d").distinct(), "d", "left_semi")
    asked = tries.select("d", bucket("t").alias("b"), "t", F.lit(0).alias("kind"), "p", none.cast("long").alias("seq"))
    own = kills.select("d", bucket("seq").alias("b"), F.col("seq").alias("t"), F.lit(1).alias("kind"), none.cast("string").alias("p"), "seq")
    rows = asked.union(own)
    if buckets > 1:
        each = asked.select("d", "b", "seq").distinct().union(own.groupBy("d", "b").agg(F.max("seq"))).groupBy("d", "b").agg(F.max("seq").alias("seq"))
        before = F.max("seq").over(Window.partitionBy("d").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        carried = each.withColumn("seq", before).where("seq IS NOT NULL")
        rows = rows.union(carried.select("d", "b", F.lit(FIRST).alias("t"), F.lit(1).alias("kind"), none.cast("string").alias("p"), "seq"))
    upto = Window.partitionBy("d", "b").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ruled = rows.withColumn("k", F.max("seq").over(upto)).where("p IS NOT NULL AND k IS NOT NULL")
    return points.join(ruled.groupBy("p", "t").agg(F.max("k").alias("k")), ["p", "t"], "left").withColumn("k", F.coalesce("k", F.lit(-1)))


def kills_now(points: DataFrame, log: DataFrame, s: Shape) -> DataFrame:
    """points(p, ...) with k: the last deletion of p or of an ancestor, else -1. A deleted path is one row here."""
    if not s.killed:
        return points.withColumn("k", F.lit(-1).cast("long"))
    last = _kills(log).groupBy("d").agg(F.max("seq").alias("k"))
    ruled = _tries(points.select("p").distinct(), s.killed).join(last, "d").groupBy("p").agg(F.max("k").alias("k"))
    return points.join(ruled, "p", "left").withColumn("k", F.coalesce("k", F.lit(-1)))


def _births(structural: DataFrame) -> DataFrame:
    """(p, k, born) from structural events (p, t, k)."""
    return structural.groupBy("p", "k").agg(F.min("t").alias("born"))


def is_namespace(points: DataFrame, births: DataFrame) -> DataFrame:
    """points(p, t, k, ...) with sub: whether p is a namespace just before t; the root always is."""
    joined = points.join(births, ["p", "k"], "left")
    return joined.withColumn("sub", (F.col("p") == "") | F.coalesce(F.col("born") < F.col("t"), F.lit(False))).drop("born")


def _above(log: DataFrame) -> DataFrame:
    """(p, t) of every namespace that a PUT or SPAWN lies in, but the root."""
    n = depth(F.col("p"))
    rows = log.where(F.col("op").isin("PUT", "SPAWN")).where(n > 1)
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), n - 1))).select(head(F.col("p"), F.col("_n")).alias("p"), F.col("seq").alias("t"))


def births(log: DataFrame, s: Shape) -> DataFrame:
    """(p, k, born) of a normalised log, CONVERTs included, level by level over the lengths of their paths."""
    spawned = log.where("op = 'SPAWN'").select("p", F.col("seq").alias("t"))
    born = settled(_births(kills_as_of(spawned.union(_above(log)), log, s)))
    converts = log.where("op = 'CONVERT'").select(F.col("p").alias("c"), F.col("seq").alias("t"))
    for level in range(1, s.converted + 1):
        own = converts.where(depth(F.col("c")) == level)
        asked = is_namespace(kills_as_of(own.select(parent(F.col("c")).alias("p"), "t", "c"), log, s), born)
        valid = kills_as_of(asked.where("sub").select(F.col("c").alias("p"), "t"), log, s)
        born = settled(_births(born.select("p", "k", F.col("born").alias("t")).unionByName(valid.select("p", "k", "t"))))
    return born


def state(mutations: DataFrame) -> DataFrame:
    """(ns, key, type, value, seq) of everything alive: scalars, and namespaces with the type SUB and their path as value.

    A log without namespaces needs one aggregation only.
    """
    return _state(*_read(mutations))


def _read(mutations: DataFrame) -> tuple[DataFrame, Shape, DataFrame | None]:
    """The normalised log, its shape, and its births; None for a log without namespaces."""
    log = normalised(mutations)
    s = shape(log)
    return log, s, births(log, s) if s.deepest > 1 or s.structural else None


def _state(log: DataFrame, s: Shape, born: DataFrame | None) -> DataFrame:
    name = [paths_name(parent(F.col("p"))).alias("ns"), key(F.col("p")).alias("key")]
    if born is None:
        last = latest(log.where(F.col("op").isin("PUT", *KILLS)), ["p"], ["seq"], ["op", "value"]).where("op = 'PUT'")
        return last.select(*name, infer_type(F.col("value")).alias("type"), "value", "seq")
    puts = log.where("op = 'PUT'").select("p", "seq", "value")
    now = kills_now(puts.select("p").union(born.select("p")).distinct(), log, s)
    subs = now.join(born, ["p", "k"]).select("p", F.lit(SUB).alias("type"), paths_name(F.col("p")).alias("value"), F.col("born").alias("seq"))
    alive = puts.join(now, "p").where("seq > k")
    scalars = latest(alive, ["p"], ["seq"], ["value"]).join(subs.select("p"), "p", "left_anti")
    scalars = scalars.select("p", infer_type(F.col("value")).alias("type"), "value", "seq")
    return scalars.union(subs).select(*name, "type", "value", "seq")


def _live_then(log: DataFrame, s: Shape, born: DataFrame, compacted: DataFrame) -> DataFrame:
    """(p, live): the keys that the namespaces compacted(p, since) held at that time."""
    puts = log.where("op = 'PUT'").select("p", "seq")
    keys = puts.select("p").union(born.select("p")).distinct().select(F.col("p").alias("q"), parent(F.col("p")).alias("p"))
    asked = keys.join(compacted, "p").select(F.col("q").alias("p"), F.col("since").alias("t"), F.col("p").alias("in"))
    asked = settled(is_namespace(kills_as_of(asked, log, s), born))
    live = asked.where("sub").select("p", "in").union(asked.join(puts, "p").where("seq > k AND seq < t").select("p", "in")).distinct()
    return live.groupBy(F.col("in").alias("p")).agg(F.count("*").alias("live"))


def entry_counts(mutations: DataFrame) -> DataFrame:
    """(ns, total_entries): the log entries of each living namespace since it was last destroyed, reset or compacted."""
    return _entry_counts(*_read(mutations))


def _entry_counts(log: DataFrame, s: Shape, born: DataFrame | None) -> DataFrame:
    if born is None:
        born = log.sparkSession.createDataFrame([], "p string, k long, born long")
    own = log.where(~F.col("op").isin(*FOLDERS)).select("p", F.col("seq").alias("t"), "op")
    events = is_namespace(kills_as_of(own.union(_above(log).withColumn("op", F.lit("IMPLIED"))), log, s), born)
    events = settled(events.withColumnRenamed("sub", "own_sub").drop("k").withColumnRenamed("p", "c"))
    events = is_namespace(kills_as_of(events.withColumn("p", parent(F.col("c"))), log, s), born).withColumnRenamed("k", "k_then")
    n = (
        F.when((F.col("op") == "PUT") & ~F.col("own_sub"), 1)
        .when(F.col("op") == "SPAWN", 1)
        .when((F.col("op") == "DEL") & F.col("sub"), 1)
        .when((F.col("op") == "CONVERT") & F.col("sub") & ~F.col("own_sub"), 2)
        .when((F.col("op") == "IMPLIED") & ~F.col("own_sub"), 1)
        .otherwise(0)
    )
    root = log.sparkSession.createDataFrame([("",)], "p string")
    alive = kills_now(born.select("p").union(root).distinct(), log, s).withColumn("t", F.lit((1 << 63) - 1))
    alive = settled(is_namespace(alive, born).where("sub").select("p", "k"))
    live = None
    if s.restarted:
        again = log.where(F.col("op").isin(*FOLDERS)).groupBy("p").agg(F.max(F.struct("seq", "op")).alias("r")).select("p", F.col("r.seq").alias("since"), F.col("r.op").alias("how"))
        events = events.join(again.select("p", "since"), "p", "left").where("since IS NULL OR t > since")
        live = _live_then(log, s, born, again.where("how = 'COMPACT'").join(alive, "p").where("since > k").select("p", "since"))
    counted = events.groupBy("p", "k_then").agg(F.sum(n).alias("n"))
    since = counted.join(alive, "p").where("k_then >= k").groupBy("p").agg(F.sum("n").alias("n"))
    total = alive.join(since, "p", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if live is not None:
        total = total.join(live, "p", "left").withColumn("n", F.col("n") + F.coalesce("live", F.lit(0)))
    return total.select(paths_name(F.col("p")).alias("ns"), F.col("n").cast("long").alias("total_entries"))


def store_stats(mutations: DataFrame) -> DataFrame:
    """(ns, live_keys, total_entries, waste_ratio) of every living namespace."""
    known = _read(mutations)
    live = _state(*known).groupBy("ns").agg(F.count("*").alias("live_keys"))
    joined = _entry_counts(*known).join(live, "ns", "left").withColumn("live_keys", F.coalesce("live_keys", F.lit(0)))
    ratio = F.when(F.col("total_entries") > 0, 1 - F.col("live_keys") / F.col("total_entries")).otherwise(F.lit(0.0))
    return joined.select("ns", "live_keys", "total_entries", ratio.alias("waste_ratio"))
