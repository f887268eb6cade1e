"""The registered queries of the key-value engine, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import hashing, paths
from kvloom.functions.infer import infer_type
from kvloom.operators import fold, physical, reads, stats, versions
from kvloom.operators.lineage import settled, shared_dir
from kvloom.plans.commands import Session, parse_shell
from kvloom.sources import fixtures as fx
from kvloom.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL VALUES list."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


INFER = (
    "CASE WHEN v IN ('true', 'false') THEN 'BOOL' WHEN regexp_full_match(v, '(?s)\\{.*\\}') THEN 'JSON' "
    "WHEN regexp_full_match(v, '-?[0-9]+') THEN 'INT' WHEN regexp_full_match(v, '-?[0-9]+\\.[0-9]*|-?\\.[0-9]+|\\.') THEN 'DOUBLE' ELSE 'STRING' END"
)
EVENT_LOG = "SELECT event_id AS seq, 'user_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS key, event_type, props FROM events"
LAST_EVENT = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM ({EVENT_LOG})) WHERE k = 1"
ORDERS = "SELECT 'ord_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key, o_orderpriority AS value FROM orders"
LITERALS = ["true", "True", "false", "{}", "{a}", "{\n}", "{", "}", "[1]", "{a}x", "007", "-5", "5.", ".5", "-.5", "-5.", ".", "-", "-.", "--5", "1-2", "1e5", "+5", " 5", "1.2.3", "", "1\n", "1234567890" * 4]


@query(f"""SELECT source, type, count(*) AS n FROM (
  SELECT 'literal' AS source, {INFER} AS type FROM {values([(x,) for x in LITERALS], "v")}
  UNION ALL SELECT 'props', {INFER} FROM (SELECT props AS v FROM events)
  UNION ALL SELECT 'key', {INFER} FROM (SELECT CAST(o_orderkey AS VARCHAR) AS v FROM orders)
  UNION ALL SELECT 'text', {INFER} FROM (SELECT text AS v FROM documents)
  UNION ALL SELECT 'name', {INFER} FROM (SELECT c_name AS v FROM customer)) GROUP BY ALL""")
def q01_infer_type(spark, d):
    parts = [("props", fx.table(spark, d, "events"), "props"), ("key", fx.table(spark, d, "orders"), "o_orderkey"), ("text", fx.table(spark, d, "documents"), "text"), ("name", fx.table(spark, d, "customer"), "c_name")]
    rows = spark.createDataFrame([("literal", x) for x in LITERALS], "source string, v string")
    for name, t, c in parts:
        rows = rows.union(t.select(F.lit(name), F.col(c).cast("string")))
    return rows.select("source", infer_type(F.col("v")).alias("type")).groupBy("source", "type").agg(F.count("*").alias("n"))


@query(f"SELECT key, seq, props AS value FROM ({LAST_EVENT})")
def q02_latest_state(spark, d):
    log = fx.events(spark, d).select(F.col("path").alias("key"), "seq", "value")
    return fold.latest(log, ["key"], ["seq"], ["value"])


@query(f"SELECT 'root' AS ns, key, seq, 'JSON' AS type, props AS value FROM ({LAST_EVENT}) WHERE event_type <> 'error'")
def q03_tombstones(spark, d):
    return fold.simple_state(fx.events(spark, d))


@query("SELECT 'ord_000000042' AS path, coalesce((SELECT o_orderpriority FROM orders WHERE o_orderkey = 42), 'ERROR: Key not found.') AS value")
def q04_point_get(spark, d):
    return reads.get(fx.orders_state(spark, d), "ord_000000042")


@query("""SELECT r.path, coalesce(o.o_orderpriority, 'ERROR: Key not found.') AS value
FROM (SELECT 'ord_' || lpad(CAST(c_custkey * 7 AS VARCHAR), 9, '0') AS path, c_custkey * 7 AS k FROM customer) r LEFT JOIN orders o ON o.o_orderkey = r.k""")
def q05_multi_get(spark, d):
    asked = fx.table(spark, d, "customer").select(F.concat(F.lit("ord_"), F.lpad((F.col("c_custkey") * 7).cast("string"), 9, "0")).alias("path"))
    return reads.multi_get(fx.orders_state(spark, d), asked)


@query(f"SELECT * FROM ({ORDERS}) WHERE key BETWEEN 'ord_000000100' AND 'ord_000000900'")
def q06_range_inclusive(spark, d):
    return reads.range_scan(fx.orders_state(spark, d), "ord_000000100", "ord_000000900")


@query(f"""SELECT 'open end' AS kind, key, value FROM ({ORDERS}) WHERE key >= 'ord_000001400'
UNION ALL SELECT 'open start', key, value FROM ({ORDERS}) WHERE key <= 'ord_000000050'""")
def q07_range_open(spark, d):
    s = fx.orders_state(spark, d)
    tries = [("open end", "ord_000001400", ""), ("open start", "", "ord_000000050"), ("reversed", "ord_000000900", "ord_000000100"), ("beyond", "zzz", "")]
    out = None
    for kind, a, b in tries:
        one = reads.range_scan(s, a, b).select(F.lit(kind).alias("kind"), "key", "value")
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT key, props AS value FROM ({LAST_EVENT}) WHERE event_type <> 'error' AND starts_with(key, 'user_0001')")
def q08_prefix(spark, d):
    return reads.prefix_scan(fold.simple_state(fx.events(spark, d)), "user_0001")


BOUND = [("user_1", "a"), ("user_z", "b"), ("user`", "c"), ("uses", "d"), ("usez", "e")]


@query(f"SELECT false AS compat, k AS key, v AS value FROM {values(BOUND, 'k, v')} WHERE starts_with(k, 'user_') UNION ALL SELECT true, k, v FROM {values(BOUND, 'k, v')} WHERE k BETWEEN 'user_' AND 'user`'")
def q09_prefix_compat(spark, d):
    s = fold.simple_state(fx.script(spark, [("PUT", k, v) for k, v in BOUND]))
    both = [reads.prefix_scan(s, "user_", compat).select(F.lit(compat).alias("compat"), "key", "value") for compat in (False, True)]
    return both[0].union(both[1])


@query("SELECT 'conv_1/turn_' || turn AS key, text AS value FROM conversations WHERE conv_id = 1")
def q10_prefix_with_dir(spark, d):
    return reads.prefix_scan(fold.simple_state(fx.conversations(spark, d)), "conv_1/turn_")


@query(f"SELECT key FROM ({ORDERS})")
def q11_list_keys(spark, d):
    return reads.list_keys(fx.orders_state(spark, d))


@query("""SELECT 'root' AS ns, '[DIR]   ' || r_name AS line FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)
UNION ALL SELECT 'root/' || r_name || '/' || n_name, '[FILE] ' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3""")
def q12_ls(spark, d):
    log = fx.geo(spark, d)
    s = fold.state(log)
    place = fx.table(spark, d, "nation").where("n_nationkey = 3").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").first()
    ns = f"root/{place.r_name}/{place.n_name}"
    return reads.ls(s).select(F.lit("root").alias("ns"), "line").union(reads.ls(s, ns).select(F.lit(ns), "line"))


TYPED = [("PUT", "a", "1"), ("PUT", "b", "true"), ("PUT", "c/d", "x"), ("PUT", "e", "{}"), ("DEL", "b", "")]


@query(f"SELECT * FROM {values([('a', 'INT'), ('b', 'TOMBSTONE'), ('c', 'SUB'), ('c/d', 'STRING'), ('e', 'JSON'), ('nope', 'TOMBSTONE'), ('/a', 'INT'), ('c//d', 'STRING')], 'path, type')}")
def q13_get_type(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("a", "b", "c", "c/d", "e", "nope", "/a", "c//d")], "path string")
    return reads.get_types(fold.state(fx.script(spark, TYPED)), asked)


@query("""SELECT 'root/' || event_type AS ns, count(DISTINCT user_id) AS live_keys, count(*) AS total_entries,
CAST(1 AS DOUBLE) - CAST(count(DISTINCT user_id) AS DOUBLE) / count(*) AS waste_ratio FROM events GROUP BY event_type""")
def q14_stats(spark, d):
    log = fx.events_by_type(spark, d)
    entries = log.select(paths.namespace(paths.parts(F.col("path"))).alias("ns"))
    return stats.stats(entries, fold.simple_state(log))


LINES = "l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
LAST_LINE = f"SELECT lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS key, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(c + ' DESC' for c in LINES.split(', ')[1:])}) AS k FROM lineitem) WHERE k = 1"


def _line_state(spark, d):
    order = LINES.split(", ")[1:]
    rows = fx.table(spark, d, "lineitem").select(fx.padded("l_partkey", 9).alias("key"), *order)
    return fold.latest(rows, ["key"], order, []).select(F.lit("root").alias("ns"), "key", F.col("l_extendedprice").alias("price"))


@query(LAST_LINE)
def q15_compact(spark, d):
    return versions.compact(_line_state(spark, d)).select("key", "price")


@query("SELECT 'root' AS ns, count(DISTINCT l_partkey) AS live_keys, count(DISTINCT l_partkey) AS total_entries, CAST(0 AS DOUBLE) AS waste_ratio FROM lineitem")
def q16_stats_after_compact(spark, d):
    compacted = versions.compact(_line_state(spark, d))
    return stats.stats(compacted, compacted)


ODD_PATHS = ["x", "/x", "a//b", "a/", "/", "a//", "root/x", "//a/b//c/"]
CUT = "list_concat(list_filter(string_split(p, '/')[1:-2], lambda x: x <> ''), [string_split(p, '/')[-1]])"


@query(f"SELECT p AS path, array_to_string(list_concat(['root'], c[1:-2]), '/') AS ns, c[-1] AS key FROM (SELECT p, {CUT} AS c FROM (SELECT p FROM {values([(x,) for x in ODD_PATHS], 'p')} UNION ALL SELECT url FROM pages))")
def q17_paths(spark, d):
    rows = spark.createDataFrame([(x,) for x in ODD_PATHS], "path string").union(fx.table(spark, d, "pages").select("url"))
    return reads.located(rows)


@query(f"SELECT DISTINCT 'root/' || array_to_string(c[1:i], '/') AS ns FROM (SELECT c, unnest(range(1, len(c))) AS i FROM (SELECT {CUT} AS c FROM (SELECT url AS p FROM pages)))")
def q18_implicit_spawn(spark, d):
    log = fx.table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.lit("PUT").alias("op"), F.col("url").alias("path"), F.octet_length("html").cast("string").alias("value"))
    return fold.state(log).where("type = 'SUB'").select(F.col("value").alias("ns"))


def _shown(spark, script):
    return fold.state(fx.script(spark, script)).select("ns", "key", "type", "value")


@query(f"SELECT * FROM {values([('root', 'a', 'SUB', 'root/a'), ('root/a', 'b', 'INT', '1'), ('root', 'c', 'SUB', 'root/c'), ('root/c', 'd', 'STRING', 'y')], 'ns, key, type, value')}")
def q19_guard(spark, d):
    return _shown(spark, [("PUT", "a/b", "1"), ("PUT", "a", "lost"), ("PUT", "c", "5"), ("PUT", "c/d", "y")])


@query("""SELECT 'root/' || r_name || '/' || n_name AS ns, c_name AS key, c_mktsegment AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 OR c_custkey > 70""")
def q20_destroy_cascade(spark, d):
    name = fx.table(spark, d, "region").where("r_regionkey = 2").first()["r_name"]
    log = fx.geo(spark, d).select((F.col("seq") * 2).alias("seq"), "op", "path", "value")
    gone = spark.createDataFrame([(141, "DEL", name, "")], "seq long, op string, path string, value string")
    return fold.state(log.union(gone)).where("type <> 'SUB'").select("ns", "key", "value")


@query(f"SELECT * FROM {values([('root', 's', 'SUB', 'root/s'), ('root', 'n', 'SUB', 'root/n'), ('root/n', 'k', 'INT', '1'), ('root', 'absent', 'SUB', 'root/absent')], 'ns, key, type, value')}")
def q21_convert(spark, d):
    return _shown(spark, [("PUT", "s", "old"), ("CONVERT", "s", ""), ("PUT", "n/k", "1"), ("CONVERT", "n", ""), ("CONVERT", "absent", ""), ("CONVERT", "no/parent", "")])


@query(f"SELECT * FROM {values([('a/b', 'root/a/b'), ('root/a', 'root/a'), ('/a//b/', 'root/a/b'), ('a/x', None), ('root', 'root'), ('', 'root')], 'path, ns')}")
def q22_resolve(spark, d):
    s = fold.state(fx.script(spark, [("SPAWN", "a/b", ""), ("PUT", "a/x", "1")]))
    spaces = s.where("type = 'SUB'").select(F.col("value").alias("ns")).union(spark.createDataFrame([("root",)], "ns string"))
    asked = spark.createDataFrame([(x,) for x in ("a/b", "root/a", "/a//b/", "a/x", "root", "")], "path string")
    return reads.resolve(spaces, asked)


@query(f"SELECT key, props AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM ({EVENT_LOG}) WHERE seq <= 5000) WHERE k = 1 AND event_type <> 'error'")
def q23_as_of(spark, d):
    return fold.simple_state(versions.as_of(fx.events(spark, d), 5000)).select("key", "value")


@query(f"SELECT * FROM {values([('root/users', 'a', '1'), ('root/users2', 'a', '3'), ('root/users/x', 'b', '7')], 'ns, key, value')}")
def q24_subtree_restore(spark, d):
    log = fx.script(spark, [("PUT", "users/a", "1"), ("PUT", "users/x/b", "7"), ("PUT", "users2/a", "2"), ("PUT", "users/a", "9"), ("PUT", "users2/a", "3"), ("DEL", "users/x/b", "")])
    placed = log.withColumn("ns", paths.namespace(paths.parts(F.col("path"))))
    return fold.simple_state(versions.restored(placed, "root/users", 3, 6)).select("ns", "key", "value")


@query("SELECT 'b' AS state_name, 'root' AS target_ns, 20 AS seq_hi")
def q25_load_last(spark, d):
    rows = versions.snapshot(spark, "a", "root", 10, "2024-01-01 00:00:00").union(versions.snapshot(spark, "b", "root", 20, "2024-01-02 00:00:00"))
    rows = rows.union(versions.snapshot(spark, "autosave_1", "root", 30, "2024-01-03 00:00:00", True))
    return versions.load_last(rows).select("state_name", "target_ns", F.col("seq_hi").cast("int").alias("seq_hi"))


@query(f"SELECT key, 'JSON' AS type, props AS value FROM ({LAST_EVENT}) WHERE event_type <> 'error'")
def q26_recover(spark, d):
    return fold.state(fx.events(spark, d)).select("key", "type", "value")


@query("""SELECT key, value, run FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run) AS k FROM (
  SELECT o_orderkey AS key, o_orderpriority AS value, 0 AS run FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
  SELECT o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'old', 2 FROM orders)) WHERE k = 1""")
def q27_merge_runs(spark, d):
    o = fx.table(spark, d, "orders")
    one = lambda rows, value, n: rows.select(F.col("o_orderkey").alias("key"), value.alias("value"), F.lit(n).alias("run"))
    runs = [one(o.where("o_orderkey % 5 = 0"), F.col("o_orderpriority"), 0), one(o.where("o_orderkey % 3 = 0"), F.col("o_orderstatus"), 1), one(o, F.lit("old"), 2)]
    return reads.merge_runs(runs, ["key"])


INT_BYTES = "[n & 255, (n >> 8) & 255, (n >> 16) & 255, (n >> 24) & 255]"
CODES = "list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS BIGINT))"


@query(f"""WITH RECURSIVE r(i, n, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, n + 1, xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) FROM r WHERE n < 8
), t AS (SELECT list(c ORDER BY i) AS tab FROM r WHERE n = 8), e AS (
  SELECT seq, key, v, CASE {INFER} WHEN 'STRING' THEN 0 WHEN 'INT' THEN 1 WHEN 'DOUBLE' THEN 2 WHEN 'BOOL' THEN 3 ELSE 4 END AS tag FROM (SELECT seq, key, props AS v FROM ({EVENT_LOG}))
), b AS (
  SELECT seq, list_concat(list_concat(list_concat({INT_BYTES.replace("n ", "length(key) ")}, {CODES.format("key")}), list_concat({INT_BYTES.replace("n ", "length(v) ")}, [tag])), {CODES.format("v")}) AS bytes FROM e
) SELECT seq, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc FROM b, t""")
def q28_entry_crc(spark, d):
    log = fx.events(spark, d)
    return log.select("seq", hashing.entry_crc(F.col("path"), F.col("value"), infer_type(F.col("value"))).alias("crc"))



@query("""SELECT key, h, fp, h % 10000 AS bucket, xor(h % 10000, xor(m2 >> 16, m2)) % 10000 AS other FROM (
  SELECT *, (xor(m1 >> 16, m1) * 73244475) & 4294967295 AS m2 FROM (SELECT *, (xor(fp >> 16, fp) * 73244475) & 4294967295 AS m1 FROM (SELECT key, h, h % 255 + 1 AS fp FROM (
  SELECT c_name AS key, list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, CAST(i AS INTEGER), 1)) AS BIGINT)),
         lambda a, x: (xor(a, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM customer))))""")
def q29_filter_placement(spark, d):
    return physical.filter_placement(fx.table(spark, d, "customer").select(F.col("c_name").alias("key")))


@query(f"SELECT key, position FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS position FROM ({ORDERS})) WHERE position % 100 = 0")
def q30_sparse_index(spark, d):
    return physical.sparse_index(fx.orders_state(spark, d))


@query("""SELECT 'root/' || source AS ns, count(*) AS entries, CAST(sum(13 + strlen('doc_' || lpad(CAST(doc_id AS VARCHAR), 7, '0')) + strlen(text)) AS BIGINT) AS log_bytes
FROM documents GROUP BY source""")
def q31_log_bytes(spark, d):
    name = F.concat(F.lit("doc_"), fx.padded("doc_id", 7))
    docs = fx.table(spark, d, "documents").select(F.concat(F.lit("root/"), "source").alias("ns"), hashing.entry_size(name, F.col("text")).alias("n"))
    return docs.groupBy("ns").agg(F.count("*").alias("entries"), F.sum("n").cast("long").alias("log_bytes"))


@query("""SELECT doc_id, true AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q32_membership(spark, d):
    docs, labels = fx.table(spark, d, "documents").select("doc_id"), fx.table(spark, d, "labels")
    sides = [reads.members(docs, labels, ["doc_id"], inside).withColumn("labelled", F.lit(inside)) for inside in (True, False)]
    return sides[0].union(sides[1])


BLOCK = "\r\n".join(["--- {} MATCHES ---", "{}", "-" * 22])
SERVER = [("SET users/ann {\"r\":1}", "OK"), ("SET users/bob 7", "OK"), ("get users/ann", '{"r":1}'), ("GET nope", "ERROR: Key not found."), ("GET RANGE \"a\" \"z\"", BLOCK.format("RANGE", "[users] => root/users")),
          ("GET users/a*", BLOCK.format("PREFIX", '[users/ann] => {"r":1}')), ("GET q*", "ERROR: No matching keys found"), ("DEL users/bob", "OK"), ("STATS", "LIVE:1 TOTAL:1"), ("GET", "ERROR: Missing Key"),
          ("CONVERT \"a b\"", "OK"), ("GET a b", "ERROR: Key not found."), ("GET RANGE a", "ERROR: Missing Range Bounds"), ("FLY x", "ERROR: Unknown Command 'FLY'")]
SHELL = [("spawn users", ""), ("cd users", ""), ("put ameetesh {\"role\": \"admin\"}", ""), ("get ameetesh", '{"role": "admin"}'), ("get a*", "--- PREFIX MATCHES ---\n[ameetesh] => {\"role\": \"admin\"}\n" + "-" * 22),
         ("stats", "\n--- [root_users] HEALTH REPORT ---\n   Live Keys     : 1\n   Total Entries : 1\n   Waste Ratio   : 0.00%\n" + "-" * 32 + "\n"), ("ls", "[FILE] ameetesh"), ("cd ..", ""), ("ls", "[DIR]   users"), ("cd nope", "[SYSTEM] Error: 'nope' is not a valid directory."), ("fly", "[SYSTEM] Unknown command.")]


def _script(*scripts: tuple[str, list[tuple[str, str]]]) -> list[tuple[str, int, str, str]]:
    return [(language, i, line, reply) for language, lines in scripts for i, (line, reply) in enumerate(lines)]


def _replies(spark, script):
    server, shell = Session(spark), Session(spark, parse_shell)
    rows = [(language, n, line, (server if language == "server" else shell).run(line)) for language, n, line, _ in script]
    return spark.createDataFrame(rows, "language string, n int, line string, reply string")


SCRIPT = _script(("server", SERVER), ("shell", SHELL))


@query(f"SELECT * FROM {values(SCRIPT, 'language, n, line, reply')}")
def q33_commands(spark, d):
    return _replies(spark, SCRIPT)


REPORT = "\n--- [{}] HEALTH REPORT ---\n   Live Keys     : {}\n   Total Entries : {}\n   Waste Ratio   : {}%\n" + "-" * 32 + "\n"
#: Loads of a subtree that was deleted since, and compactions.
LOADS = [("SET u/a 1", "OK"), ("SAVE u s1", "OK"), ("DEL u", "OK"), ("LOAD s1", "OK"), ("GET u/a", "ERROR: Key not found."), ("SET u/b 9", "OK"), ("LOAD s1", "OK"), ("GET u/a", "1"), ("GET u/b", "ERROR: Key not found."),
         ("STATS", "LIVE:1 TOTAL:3"), ("LOAD nope", "OK"), ("LOAD", "ERROR: Missing State Name"), ("SAVE", "ERROR: Missing Argument")]
COMPACTIONS = [("put a 1", ""), ("put a 2", ""), ("del b", ""), ("stats", REPORT.format("root", 1, 3, "66.67")), ("compact", ""), ("stats", REPORT.format("root", 1, 1, "0.00")), ("put n/x 1", ""), ("put n/x 2", ""),
               ("save s1", ""), ("compact_all", "[SYSTEM] Initiating recursive compaction...\n[SYSTEM] Full database compaction complete."), ("cd n", ""), ("put y 3", ""),
               ("stats", REPORT.format("root_n", 2, 2, "0.00")), ("loadlast", "[SYSTEM] Loading most recent backup: s1"), ("cd n", ""), ("stats", REPORT.format("root_n", 1, 2, "50.00")), ("get y", "ERROR: Key not found.")]
RESTORES = _script(("server", LOADS), ("shell", COMPACTIONS))


@query(f"SELECT * FROM {values(RESTORES, 'language, n, line, reply')}")
def q34_load_and_compact(spark, d):
    return _replies(spark, RESTORES)


def stored(spark, log: DataFrame, last: int) -> Store:
    """A store whose log was appended, flushed and compacted in between; its last quarter is the tail."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for quarter, after in enumerate((store.flush, store.compact, store.flush, lambda: None)):
        store.append(log.where((F.col("seq") > last * quarter // 4) & (F.col("seq") <= last * (quarter + 1) // 4)))
        after()
    return store


def _event_store(spark, d) -> Store:
    return stored(spark, fx.events(spark, d), fx.table(spark, d, "events").agg(F.max("event_id")).first()[0])


@query(f"SELECT 'root' AS ns, key, 'JSON' AS type, props AS value, seq FROM ({LAST_EVENT}) WHERE event_type <> 'error'")
def q35_store_state(spark, d):
    return _event_store(spark, d).state()


@query(f"SELECT key, props AS value FROM ({LAST_EVENT}) WHERE event_type <> 'error' AND key BETWEEN 'user_00010' AND 'user_00040'")
def q36_store_range(spark, d):
    return _event_store(spark, d).range_scan("user_00010", "user_00040")


@query(f"SELECT 'user_00007' AS path, coalesce((SELECT props FROM ({LAST_EVENT}) WHERE event_type <> 'error' AND key = 'user_00007'), 'ERROR: Key not found.') AS value")
def q37_store_get(spark, d):
    return _event_store(spark, d).get("user_00007")


@query("SELECT o_orderkey AS seq, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000.0) AS BIGINT) AS run FROM orders")
def p1_flushes(spark, d):
    return physical.flushes(fx.orders(spark, d), 1000)


SEGMENTS = """WITH RECURSIVE e AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS seq, CAST(24 + strlen(text) AS BIGINT) AS bytes FROM documents
), w AS (
  SELECT i, seq, bytes, bytes AS used, CAST(0 AS BIGINT) AS segment FROM e WHERE i = 1 UNION ALL
  SELECT e.i, e.seq, e.bytes, CASE WHEN w.used + e.bytes > 262144 THEN e.bytes ELSE w.used + e.bytes END,
         CASE WHEN w.used + e.bytes > 262144 THEN w.segment + 1 ELSE w.segment END FROM w JOIN e ON e.i = w.i + 1
) """


def _doc_entries(spark, d):
    name = F.concat(F.lit("doc_"), fx.padded("doc_id", 7))
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), hashing.entry_size(name, F.col("text")).cast("long").alias("bytes"), F.col("text").alias("value"))


@query(SEGMENTS + "SELECT seq, bytes, segment FROM w")
def p2_segments(spark, d):
    return physical.segments(_doc_entries(spark, d), 262144)


@query(SEGMENTS + """SELECT seq, segment, CAST(used - bytes AS BIGINT) AS "offset", sha256(text) AS value_sha256, true AS found FROM w JOIN documents ON doc_id = seq WHERE seq % 7 = 0
UNION ALL SELECT -1, 999999, 0, NULL, false""")
def p3_point_read(spark, d):
    entries = _doc_entries(spark, d)
    placed = settled(physical.pointers(entries, 262144))
    asked = placed.where("seq % 7 = 0").select("seq", "segment", "offset").union(spark.createDataFrame([(-1, 999999, 0)], "seq long, segment long, offset long"))
    log = placed.join(entries.select("seq", "value"), "seq")
    return physical.point_read(asked, log).select("seq", "segment", "offset", F.sha2("value", 256).alias("value_sha256"), "found")
