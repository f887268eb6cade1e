"""Scalar functions against plain Python."""

import zlib

import pytest
from pyspark.sql import functions as F

from kvloom.functions import hashing, render
from kvloom.operators import physical
from kvloom.plans.commands import Command, parse_server, parse_shell
from kvloom.sources.store import Store
from kvloom.streaming.ingest import ingest


def test_entry_checksum_and_corruption(spark):
    rows = [("k", "v", "STRING"), ("schlüssel", "", "STRING"), ("n", "12", "INT"), ("", "{}", "JSON")]
    df = spark.createDataFrame(rows, "key string, value string, type string").withColumn("crc", hashing.entry_crc(F.col("key"), F.col("value"), F.col("type")))
    for r in df.collect():
        k, v = r.key.encode(), r.value.encode()
        raw = len(k).to_bytes(4, "little") + k + len(v).to_bytes(4, "little") + bytes([hashing.TAGS[r.type]]) + v
        assert r.crc == zlib.crc32(raw)
    assert physical.corrupted(df).count() == 0
    assert physical.corrupted(df.withColumn("value", F.concat("value", F.lit("x")))).count() == 4


def test_filter_placement(spark):
    def fnv(b):
        h = 2166136261
        for x in b:
            h = ((h ^ x) * 16777619) & 0xFFFFFFFF
        return h

    def mix(x):
        for _ in range(2):
            x = ((x >> 16 ^ x) * 0x45D9F3B) & 0xFFFFFFFF
        return x >> 16 ^ x

    keys = ["", "a", "ключ", "user_00001"]
    for r in physical.filter_placement(spark.createDataFrame([(k,) for k in keys], "key string")).collect():
        h = fnv(r.key.encode())
        assert (r.h, r.fp, r.bucket, r.other) == (h, h % 255 + 1, h % 10000, (h % 10000 ^ mix(h % 255 + 1)) % 10000)


def test_text_rules(spark):
    row = spark.range(1).select(
        render.strip_quotes(F.lit('""')).alias("a"), render.strip_quotes(F.lit('"x"y"')).alias("b"), render.server_line(F.lit("  SET a\r\n")).alias("c"),
        render.shell_value(F.lit("  v")).alias("d"), render.percent(F.lit(0.125)).alias("e"), render.server_stats(F.lit(1), F.lit(2)).alias("f"), render.pair(F.lit("k"), F.lit("v")).alias("g"),
    ).first()
    assert tuple(row) == ("", 'x"y', "SET a", " v", "12.50%", "LIVE:1 TOTAL:2", "[k] => v")


@pytest.mark.parametrize(
    "line, command",
    [
        ("SET k", Command("SET", "k", "")), ("set k a b ", Command("SET", "k", "a b ")), ("GET a*", Command("PREFIX", "a")), ('GET range "a" "b"', Command("RANGE", "a", "b")),
        ("SAVE s", Command("SAVE", "s")), ("SAVE p s", Command("SAVE", "s", "p")), ("", Command("", error="ERROR: Missing Action")), ("LOAD", Command("LOAD", error="ERROR: Missing State Name")),
        ("GET RANGE a", Command("RANGE", error="ERROR: Missing Range Bounds")), ("SAVE", Command("SAVE", error="ERROR: Missing Argument")), ("CONVERT", Command("CONVERT", error="ERROR: Missing Key")),
    ],
)
def test_server_lines(line, command):
    assert parse_server(line) == command


def test_shell_lines():
    assert parse_shell("put k") == Command("")
    assert parse_shell("put k  v w") == Command("SET", "k", " v w")
    assert parse_shell("save p s") == Command("SAVE", "s", "p")
    assert parse_shell('convert "a b" ') == Command("CONVERT", 'a b" ')
    assert parse_shell('convert "a b"') == Command("CONVERT", "a b")
    assert parse_shell("compact_all") == Command("COMPACT_ALL") and parse_shell("cd") == Command("")
    assert parse_shell("nonsense").error


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    log = spark.createDataFrame([(1, "PUT", "a/b", "1"), (2, "PUT", "c", "x")], "seq long, op string, path string, value string")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp").awaitTermination()
    assert store.log().count() == 2 and store.current_version() is None
    assert store.compact() == 1
    store.append(spark.createDataFrame([(3, "DEL", "c", "")], "seq long, op string, path string, value string"))
    assert store.compact() == 2
    assert {(r.ns, r.key) for r in store.state().collect()} == {("root", "a"), ("root/a", "b")}
