"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs REPEATS times into a sink that keeps nothing; the fastest and the spread are given, and rows a
second for the operations that the baseline names: fold, multi-get, range scan, compaction. The store_ entries
write a log of the events with a flush, a compaction and a flush in between, and read the store that this leaves.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from kvloom.plans import catalog
from kvloom.session import local_session
from kvloom.sources import fixtures

SF_DIR, CPUS, REPEATS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), 3
#: Query: the table whose rows count.
HEADLINES = {
    "q02_latest_state": "events", "q03_tombstones": "events", "q05_multi_get": "customer", "q06_range_inclusive": "orders", "q08_prefix": "events",
    "q11_list_keys": "orders", "q14_stats": "events", "q15_compact": "lineitem", "q20_destroy_cascade": "customer", "q26_recover": "events",
    "q27_merge_runs": "orders", "q29_filter_placement": "customer", "q30_sparse_index": "orders", "q31_log_bytes": "documents",
}


def sunk(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in sorted(set(HEADLINES.values()))}
    best, spread, rate = {}, {}, {}

    def timed(name: str, n: int, run: Callable[[], object]) -> object:
        took, out = [], None
        for _ in range(REPEATS):
            began = time.perf_counter()
            out = run()
            took.append(time.perf_counter() - began)
        best[name], spread[name], rate[name] = round(min(took), 3), [round(min(took), 3), round(max(took), 3)], round(n / min(took))
        return out

    for name, table in HEADLINES.items():
        timed(name, rows[table], lambda name=name: sunk(catalog.QUERIES[name](spark, SF_DIR)))
    n, log = rows["events"], fixtures.events(spark, SF_DIR)
    last = log.agg(F.max("seq")).first()[0]
    store = timed("store_write", n, lambda: catalog.stored(spark, log, last))
    timed("store_state", n, lambda: sunk(store.state()))
    timed("store_range", n, lambda: sunk(store.range_scan("user_00010", "user_00040")))
    timed("store_get", 1, lambda: store.get("user_00007").collect())
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "repeats": REPEATS, "spread": spread, "rows_per_sec": rate, "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
