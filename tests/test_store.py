"""Stores: runs, flushes and the tail against the fold of the whole log; what reads push down."""

import random

from kvloom.operators import fold, reads
from kvloom.sources.store import LOG, Store

NAMES = ["a", "b", "c"]


def shown(df):
    return sorted(map(tuple, df.select("ns", "key", "type", "value").collect()))


def test_reads_equal_the_fold_of_the_log(spark, tmp_path):
    rng = random.Random(2)
    store, rows = Store(spark, str(tmp_path)), []
    for step in (store.flush, store.flush, store.compact, store.flush, lambda: None):
        batch = []
        for _ in range(12):
            path = "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 3)))
            rows.append((len(rows) + 1, rng.choice(["PUT", "PUT", "PUT", "DEL", "SPAWN", "CONVERT"]), path, str(rng.randint(0, 99))))
            batch.append(rows[-1])
        store.append(spark.createDataFrame(batch, LOG))
        step()
    assert [r[1] for r in store.manifest()] == ["delta", "delta", "base", "delta"]
    want = fold.state(spark.createDataFrame(rows, LOG)).cache()
    assert shown(store.state()) == shown(want)
    for path in ("a", "b/a", "c/b/a", "nope"):
        assert store.get(path).first() == reads.get(want, path).first(), path
    for start, end, ns in (("a", "b", "root"), ("b", "", "root/c")):
        assert list(map(tuple, store.range_scan(start, end, ns).collect())) == list(map(tuple, reads.range_scan(want, start, end, ns).collect()))


def test_a_flush_reads_the_tail_alone_and_filters_reach_the_scans(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.current_version() is None and store.manifest() == []
    store.append(spark.createDataFrame([(i, "PUT", f"k{i:04d}", str(i)) for i in range(1, 501)], LOG))
    assert store.compact() == 1 and store.flush() is None
    store.append(spark.createDataFrame([(501, "PUT", "k0007", "new"), (502, "DEL", "k0009", "")], LOG))
    assert store.flush() == 2
    base, deltas, upto = store.current()
    assert spark.read.parquet(f"{tmp_path}/runs/{deltas[0]}").count() == 2 and upto == 502
    plan = store.mutations(reads.F.col("key") == "k0007")._jdf.queryExecution().toString()
    assert "EqualTo(key,k0007)" in plan and "GreaterThan(seq,502)" in plan
    assert store.get("k0007").first()["value"] == "new" and store.get("k0009").first()["value"] == reads.MISS
    assert [r.key for r in store.range_scan("k0008", "k0011").collect()] == ["k0008", "k0010", "k0011"]


def test_two_compactions_at_once(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.append(spark.createDataFrame([(1, "PUT", "a", "1")], LOG))
    store.flush()
    store.append(spark.createDataFrame([(2, "PUT", "a", "2")], LOG))
    seen = store.current()
    other.current = lambda: seen  # the other began before the first was done
    store.compact()
    other.flush()
    other.compact()
    assert shown(store.state()) == [("root", "a", "INT", "2")]
