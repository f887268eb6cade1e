"""WARC archives with a two-level capture index.

Writing: each task writes one gzip WARC file (a member for each record) into a folder that all machines
share, and yields an index line for each record. Index lines are sorted by reversed-host URL key, dealt by
range; each range is one file of compressed blocks, followed by its directory: one fixed-size entry for each
block with the block's place, and the block's first key. The table of ranges is as short as the number of files.

Reading: a lookup finds a key's range, then its block by binary search in the file's directory (a few
seeks, whatever its size) and decompresses that one block. Lookups are sorted by key first, so that neighbours
share a block. The places that are found are then sorted by file and offset, and records read by byte ranges.

Records: of records with equal payloads of at least `least_bytes` bytes, the one with the smallest id is the
response and others revisit it; smaller ones are responses. Rows: null html is an empty payload, a null url
an empty target; null ids come last, and rows that share id and payload with the first are responses too.
Repeated rows are records of their own. An empty table gives an archive without records. Payloads of any
length are written whole.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import bloom
from kvloom.llm.shared import HOT_SHARE, checkpointed, fresh_dir, order_id, parts

BLOCK_LINES = 1000
ENTRY = "<QIQI"  # of the directory: block offset and length, key offset and length
TAIL = "<QQ"  # directory offset, number of blocks
#: Records are read together if no more than GAP bytes lie between them, READ bytes at a time.
GAP, READ = 1 << 16, 4 << 20
#: A file's records are dealt to readers in stretches of so many bytes.
STRETCH = 64 << 20
PLACE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
FOUND = pa.schema(
    [("key", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary())]
)
CAPTURE = "key string, id long, file string, offset long, length long, digest string, record_type string, refers_to long"


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The folder's file system and its path there; a folder without a scheme is a local path."""
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" in folder:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def url_key(url: str | None) -> str:
    """The key of a url: host labels reversed and comma-joined, then path and query, lower-cased; its scheme and fragment don't count."""
    rest = (url or "").partition("#")[0]
    rest = rest.partition("://")[2] if "://" in rest else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].lower()
    key = ",".join(reversed(host.split("."))) + ")" + (rest[cut:].lower() or "/")
    return key.replace("\t", "%09").replace("\n", "%0A")


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(url: str, row_id: int | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str) -> bytes:
    """A WARC/1.1 record: a response, or a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + (b"Content-Length: %d\r\n\r\n" % len(payload)) + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row_id} {url}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if row_id is None else row_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {refers_url}')}>",
            f"WARC-Refers-To-Target-URI: {_clean(refers_url)}", f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields and its payload (the bytes after the HTTP head)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("truncated record")
    return fields, block.partition(b"\r\n\r\n")[2]


@dataclass(frozen=True)
class Archive:
    """An archive's folder, and its ranges: (first key, file) of each index file in key order."""

    folder: str
    ranges: list[tuple[str, str]]


def _write_records(folder: str):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        # A retried or duplicated task writes a file of its own; the index names those of the attempt that counts.
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lines = []
                for r in batch.slice(at, 256).to_pylist():
                    if out is None:
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (r["html"] or "").encode()
                    raw = record(r["url"] or "", r["id"], payload, r["digest"], r["refers_to"], r["refers_url"] or "")
                    member = gzip.compress(raw, 1, mtime=0)
                    out.write(member)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    lines.append((url_key(r["url"]), r["id"], name, offset, len(member), r["digest"], kind, r["refers_to"]))
                    offset += len(member)
                if lines:
                    cols = list(zip(*lines, strict=True))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in CAPTURE.split(", ")])
        if out is not None:
            out.close()

    return of_batches


def _write_index(folder: str):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, offset, held, first_key, entries = None, 0, [], None, []

        def close_block() -> None:
            nonlocal offset, held
            raw = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in r.values()) for r in held).encode(), 6)
            out.write(raw)
            entries.append((offset, len(raw), held[0]["key"].encode()))
            offset += len(raw)
            held = []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    first_key = r["key"]
                held.append(r)
                if len(held) == BLOCK_LINES:
                    close_block()
        if out is None:
            return
        if held:
            close_block()
        at = offset
        for _, _, key in entries:
            out.write(key)
        for start, length, key in entries:
            out.write(struct.pack(ENTRY, start, length, at, len(key)))
            at += len(key)
        out.write(struct.pack(TAIL, at, len(entries)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([first_key]), pa.array([name])], ["first_key", "file"])

    return of_batches


class IndexFile:
    """An index file: blocks are found by binary search in its directory, which stays on disk."""

    def __init__(self, store: pyarrow.fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.directory, self.blocks = struct.unpack(TAIL, self.file.read_at(16, size - 16))
        self.held: tuple[int, list[list[str]]] = (-1, [])

    def entry(self, i: int) -> tuple[int, int, str]:
        start, length, at, n = struct.unpack(ENTRY, self.file.read_at(24, self.directory + i * 24))
        return start, length, self.file.read_at(n, at).decode()

    def block(self, i: int) -> list[list[str]]:
        if self.held[0] != i:
            start, length, _ = self.entry(i)
            lines = zlib.decompress(self.file.read_at(length, start)).decode().split("\n")
            self.held = (i, [line.split("\t") for line in lines])
        return self.held[1]

    def find(self, key: str) -> Iterator[list[str]]:
        """All lines of the key: from the last block that begins before it, on."""
        low, high = 0, self.blocks
        if self.held[0] >= 0 and self.held[1][0][0] < key <= self.held[1][-1][0]:
            low = self.held[0] + 1
        else:
            while low < high:
                middle = (low + high) // 2
                if self.entry(middle)[2] < key:
                    low = middle + 1
                else:
                    high = middle
        for i in range(max(0, low - 1), self.blocks):
            lines = self.block(i)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1
            if at < len(lines):
                return


def _sketched(sketch: np.ndarray):
    """A function of a hash: whether the sketch has it. Texts are not sent to Python for it."""

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.maybe(bloom.flags(sketch), h.to_numpy().view(np.uint64)))

    return known


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> Archive:
    """Writes a record for every row, and the index."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    own = own.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("bytes", F.octet_length("html"))
    # The first of each payload that repeats is found from digests alone, and joined back: the few that a thousandth of the pages
    # have by broadcast. Of the rest, pages whose digest a sketch of fixed size has among the repeated ones are shuffled with
    # their payloads; all others are written where they are read.
    first = own.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(F.struct(order_id("id").alias("o"), "id", F.coalesce("url", F.lit("")).alias("url"))).alias("f"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("d"), F.xxhash64("digest").alias("dh"), "n", F.col("f.id").alias("first_id"), F.col("f.o").alias("first_o"), F.col("f.url").alias("first_url"))
    first = checkpointed(first)
    least = (first.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(first.where(F.col("n") > least).drop("dh", "n"))  # fewer than HOT_SHARE rows
    long_digest = F.when(F.col("bytes") >= least_bytes, F.col("digest"))
    near = own.withColumn("long_digest", long_digest).join(hot, F.col("long_digest") == F.col("d"), "left")
    repeated = F.col("d").isNull() & F.col("long_digest").isNotNull() & _sketched(bloom.build(first.where(F.col("n") <= least), "dh"))(F.xxhash64("digest"))
    near = near.withColumn("far", F.coalesce(repeated, F.lit(False)))
    far = near.where("far").drop("d", "first_id", "first_o", "first_url")
    far = far.join(first.where(F.col("n") <= least).drop("dh", "n"), F.col("long_digest") == F.col("d"), "left")
    later = order_id("id") > F.col("first_o")
    columns = ["id", "url", "html", "digest", F.when(later, F.col("first_id")).alias("refers_to"), F.when(later, F.col("first_url")).alias("refers_url")]
    marked = near.where("NOT far").select(columns).union(far.select(columns))
    captures = checkpointed(marked.mapInArrow(_write_records(folder), CAPTURE))
    sorted_lines = captures.repartitionByRange(parts(spark), "key", order_id("id")).sortWithinPartitions("key", order_id("id"), "file", "offset")
    ranges = checkpointed(sorted_lines.mapInArrow(_write_index(folder), "first_key string, file string"))
    return Archive(folder, sorted(map(tuple, ranges.collect()), key=lambda r: r[0].encode()))


def lookup(spark: SparkSession, archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Every capture of the given urls, read back: key, id, url, record_type, digest, refers_to, payload_length, payload.

    A null url is looked up as the empty one; captures whose keys agree (scheme, case, fragment) all count.
    """
    starts = [r[0] for r in archive.ranges]

    def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for url in batch.column(0).to_pylist():
                k = url_key(url)
                # A key's captures may begin in the range before the first one that starts with it.
                at = max(0, bisect.bisect_left(starts, k) - 1)
                while at < len(starts) and starts[at] <= k:
                    keys.append(k)
                    numbers.append(at)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32())], ["key", "range"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the records of the keys are: the index alone is read."""
        store, base = _store(archive.folder)
        name, index = None, None
        for batch in batches:
            found = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != archive.ranges[at][1]:
                    if index is not None:
                        index.file.close()
                    name = archive.ranges[at][1]
                    index = IndexFile(store, f"{base}/{name}")
                for _, _, file, offset, length, *_ in index.find(k):
                    found.append((k, file, int(offset), int(length)))
                    if len(found) == 4096:
                        yield _table(found, PLACE)
                        found = []
            yield _table(found, PLACE)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records at sorted places: neighbours are read in one range."""
        store, base = _store(archive.folder)
        name, warc = None, None
        for batch in batches:
            wanted, at = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), 0
            while at < len(wanted):
                _, file, start, length = wanted[at]
                until, end = at + 1, start + length
                while until < len(wanted) and wanted[until][1] == file and wanted[until][2] <= end + GAP and wanted[until][2] + wanted[until][3] - start <= READ:
                    end = max(end, wanted[until][2] + wanted[until][3])
                    until += 1
                if name != file:
                    if warc is not None:
                        warc.close()
                    name, warc = file, store.open_input_file(f"{base}/{file}")
                raw, rows = memoryview(warc.read_at(end - start, start)), []
                for k, _, offset, length in wanted[at:until]:
                    fields, payload = parse(gzip.decompress(raw[offset - start : offset - start + length]))
                    number = lambda v: int(v) if v else None
                    kind = fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {offset}: the payload's digest is wrong")
                    rows.append((k, number(fields["X-Page-Id"]), fields["WARC-Target-URI"], kind, digest, number(fields.get("X-Refers-To-Page-Id")),
                                 int(fields["X-Payload-Length"]), payload if kind == "response" else None))
                    if len(rows) == 64:
                        yield _table(rows, FOUND)
                        rows = []
                if rows:
                    yield _table(rows, FOUND)
                at = until

    # Each (key, range) is a task's work, so that a key with very many captures is read by many.
    keys = urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(ranges_of, "key string, range int").distinct()
    keys = keys.repartitionByRange(parts(spark), "key", "range").sortWithinPartitions("key", "range")
    found = keys.mapInArrow(places, "key string, file string, offset long, length long")
    found = found.repartition(parts(spark), "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return found.mapInArrow(records, "key string, id long, url string, record_type string, digest string, refers_to long, payload_length long, payload binary")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
