"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into reference blocks at content-defined anchors: an anchor is the
word 5-gram with the least hash in some window of 20 words, and its block is all the windows in which it is
the least. So equal windows lie in blocks with equal anchors, wherever they stand. All blocks are indexed by
anchor and content; the first occurrence of each is what others may be factored against. Where a block's
anchor occurs with another content too, a factor may end inside it; there, at the factor boundaries, each
window is looked up by itself. A document is then parsed greedily, left to right: at each window that occurs
earlier, the longest factor among its references goes on as far as it matches (adjacent matches with the same
displacement make one), and the parse resumes with the next window, which reaches over the factor's end. The
factors, of at least 20 words, are the duplicate spans, and their words are what goes: a word goes if, and only
if, a window that covers it starts earlier elsewhere.

Blocks and windows are equal if 128 bits of two independent hashes are (of blocks: 44 of the anchor and 84 of
the content); words are not shuffled to be compared again. A row is told from others with its id by its text's
128-bit hash.

Only hashes and positions are shuffled to find factors: about one row for 8 words. Groups are streamed in
sorted order with constant state, however large they are, and yield at most one row for each of theirs. Equal
blocks of a slice of documents are combined before the shuffle. Hot anchors, which a 64th of the texts holds
often (no more than MOST_HOT of them are asked for), are dealt by content, and their blocks are looked into in any case.

Rows: null and empty texts have no words and lose none. Rows that share an id count as one document; null
ids come after all others. Repeated rows keep what the first of them keeps. Empty tables give empty results.
Texts of any length are read whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm import bloom
from kvloom.llm.kernel import BASE, OTHER_BASE, SPACES, Sequences, Words, mix, signed, slices
from kvloom.llm.shared import checkpointed, order_id, parts

GRAM = 5
#: Low bits of an index key that belong to the content; the others are the anchor's.
CONTENT_BITS = 20
#: Of a 64th of the texts: the most hot anchors that are asked for, and the least occurrences of one.
MOST_HOT, LEAST_HOT = 1024, 100
ROW = ["doc", "t1", "t2"]
RUN = "doc long, t1 long, t2 long, a int, n int, ref_doc long, ref_a int"


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of (minimum or maximum) each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = of(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places (word index), index keys, the first and the last window of their blocks, and the blocks' hashes."""
    none = np.zeros(0, np.int64)
    n, width = len(w), window - GRAM + 1
    if n < window:
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    words = w.hashes()
    seq = Sequences(words)
    place = np.arange(n - GRAM + 1)
    h = seq.of(place, place + GRAM)
    least = _slide(h, width, np.minimum)  # of each window
    start = np.arange(len(least))
    end_of_row = np.repeat(w.first[1:], w.counts())
    valid = start + window <= end_of_row[: len(least)]
    least = np.where(valid, least, 0)
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)))
    at = np.flatnonzero((_slide(padded, width, np.maximum) == h) & (h != 0))
    first, last = np.full(len(at), -1), np.full(len(at), -1)
    for back in range(width):
        s = at - back
        inside = (s >= 0) & (s < len(least))
        own = np.zeros(len(at), bool)
        own[inside] = least[s[inside]] == h[at[inside]]
        first[own] = s[own]
        last[own & (last < 0)] = s[own & (last < 0)]
    ahead = (at - first).astype(np.uint64)
    content = mix(seq.of(first, last + window) + ahead)
    block = mix(Sequences(words, OTHER_BASE).of(first, last + window) + ahead)
    low = np.uint64((1 << CONTENT_BITS) - 1)
    return at, (h[at] & ~low) | (content & low), first, last, block


ROWS = "key long, block long, doc long, place long, t1 long, t2 long, ref_doc long, ref_a int"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _rows(key: np.ndarray, block: np.ndarray, doc: np.ndarray, place: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> pa.RecordBatch:
    """Index rows, combined before they are shuffled: of equal blocks here, all but the first are copies of it already.

    Such a copy is sent under a key of its own, with the place that it copies, so that a block that a third of all rows
    hold is not gathered in one task. place: position, windows before the anchor and after it, and whether the anchor is hot.
    """
    order = np.lexsort((t2, t1, place, doc, block, key) if t1.any() else (place, doc, block, key))
    key, block, doc, place, t1, t2 = (x[order] for x in (key, block, doc, place, t1, t2))
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))) if len(key) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
    again = np.zeros(len(key), bool)  # a repeated row
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1])
    copy = ~new & ((doc != doc[head]) | (place >> 32 != place[head] >> 32))
    own = signed(mix(mix(doc.view(np.uint64) * np.uint64(BASE) + t1.view(np.uint64)) + place.view(np.uint64)))
    keep = ~again if again.any() else slice(None)
    ref_a = (place[head] >> 32) - ((place[head] >> 28) & 15)
    columns = [
        pa.array(np.where(copy, own, key)[keep]), pa.array(block[keep]), pa.array(doc[keep]), pa.array(place[keep]), pa.array(t1[keep]), pa.array(t2[keep]),
        pa.array(doc[head][keep], mask=~copy[keep]), pa.array(ref_a.astype(np.int32)[keep], mask=~copy[keep]),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _row_names(part: pa.RecordBatch, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, t1 and t2 of each row; the text's hashes are 0 where the id is surely not repeated, so that they compress well."""
    doc, t1, t2, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "t1", "t2", "dh"))
    some = np.zeros(len(doc), bool) if flags is None else bloom.maybe(flags, h.view(np.uint64))
    return doc, np.where(some, t1, 0), np.where(some, t2, 0)


def _index(window: int, hot: np.ndarray, repeated: np.ndarray | None):
    """For mapInArrow: documents to index rows; blocks of hot anchors are dealt by their content."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if repeated is None else bloom.flags(repeated)
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), SPACES)
                at, key, first, last, block = anchors(w, window)
                row = w.row_of()[at] if len(at) else at
                is_hot = np.isin(key >> np.uint64(CONTENT_BITS), hot)
                key = np.where(is_hot, mix(key ^ block), key)
                place = ((at - w.first[row]) << 32) | ((at - first) << 28) | ((at - last) << 24) | is_hot
                yield _rows(signed(key), signed(block), *_moved(_row_names(part, flags), row, place))

    return of_batches


def _moved(names: tuple[np.ndarray, np.ndarray, np.ndarray], row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, place, t1 and t2 of index rows."""
    doc, t1, t2 = (x[row] for x in names)
    return doc, place.astype(np.int64), t1, t2


def hot_anchors(own: DataFrame, window: int) -> np.ndarray:
    """The anchors that a 64th of the texts (by hash) holds LEAST_HOT times or more, MOST_HOT of them at most; what is found decides only how rows are dealt."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                key, times = np.unique(anchors(Words(part.column("text"), SPACES), window)[1] >> np.uint64(CONTENT_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(times)], ["anchor", "times"])

    found = own.where(F.pmod("t1", F.lit(64)) == 0).select("text").mapInArrow(of_batches, "anchor long, times long")
    found = found.groupBy("anchor").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST_HOT).orderBy(F.desc("times"), "anchor").limit(MOST_HOT)
    return np.array([r["anchor"] for r in found.collect()], np.int64).view(np.uint64)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by NAMES: copies of earlier blocks, and blocks with factor boundaries (without a ref_doc).

    Rows with a ref_doc are known to be copies.

    A row that is not the first of its block is a copy of the first. The first of each block is looked into
    if its anchor has other blocks, or is hot; so are other rows at its place, of another text with its id. What is
    kept from one batch to the next: the first row of the anchor and the first row of the last block.
    """
    kept = np.zeros((0, 6), np.int64)
    told = np.zeros(0, bool)  # of the kept rows: given out as having boundaries
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
        rows = np.concatenate((kept, rows))
        old = len(kept)
        known = np.concatenate((np.zeros(old, bool), batch.column(6).is_valid().to_numpy(zero_copy_only=False)))
        ref = [np.concatenate((np.zeros(old, np.int64), pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False))) for k in (6, 7)]
        done = np.zeros(len(rows), bool)
        done[:old] = told
        key, block, doc, place, t1, t2 = rows.T
        new_anchor = np.concatenate(([True], (key[1:] ^ key[:-1]) >> CONTENT_BITS != 0))
        new_block = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
        head = np.flatnonzero(new_block)[np.cumsum(new_block) - 1]  # the first row of each row's block
        anchor_of = np.cumsum(new_anchor) - 1
        many = np.bincount(anchor_of[new_block]) > 1
        pos, ahead = place >> 32, (place >> 28) & 15
        again = np.zeros(len(rows), bool)  # a repeated row
        again[1:] = (rows[1:] == rows[:-1]).all(axis=1)
        same = (doc == doc[head]) & (pos == pos[head])
        look = same & (many[anchor_of] | (place & 1 == 1) | ~new_block) & ~done & ~again & ~known
        copy = (~same & ~again) | known
        copy[:old] = False
        look[:old] &= new_block[:old]
        out = np.flatnonzero(copy | look)
        a, n = pos - ahead, ((place >> 28) & 15) - ((place >> 24) & 15) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[out]), pa.array(t1[out]), pa.array(t2[out]), pa.array(a[out].astype(np.int32)), pa.array(n[out].astype(np.int32)),
                pa.array(np.where(known, ref[0], doc[head])[out], mask=look[out]), pa.array(np.where(known, ref[1], a[head])[out].astype(np.int32), mask=look[out]),
            ],
            [c.split()[0] for c in RUN.split(", ")],
        )
        keep = sorted({int(np.flatnonzero(new_anchor)[-1]), int(head[-1])})
        kept, told = rows[keep].copy(), np.array([bool(done[i] or look[i]) for i in keep])


def _streamed(rows: DataFrame) -> DataFrame:
    """Copies and boundary blocks among index rows: those of an anchor in one task."""
    n = parts(rows.sparkSession)
    return rows.repartition(n, F.shiftright("key", CONTENT_BITS)).sortWithinPartitions(*NAMES[:6]).mapInArrow(_matched, RUN)


def _packed(docs: DataFrame, repeated: np.ndarray | None) -> DataFrame:
    """(doc, t1, t2, z, rest): texts compressed, since they are shuffled."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, flags = zstandard.ZstdCompressor(level=1), None if repeated is None else bloom.flags(repeated)
        for batch in batches:
            for part in slices(batch):
                z = [tool.compress(t.as_buffer()) if t.is_valid else b"" for t in part.column("text")]
                names = [pa.array(x) for x in _row_names(part, flags)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(z, pa.binary()), part.column("rest")], [*ROW, "z", "rest"])

    schema = T.StructType([*T.StructType.fromDDL("doc long NOT NULL, t1 long NOT NULL, t2 long NOT NULL, z binary").fields, docs.schema["rest"]])
    return docs.mapInArrow(of_batches, schema)


def _unpacked(column: pa.Array) -> list[bytes]:
    tool = zstandard.ZstdDecompressor()
    return [tool.decompress(z) if z else b"" for z in column.to_pylist()]


def _boundary_windows(window: int):
    """For mapInArrow: texts with boundary blocks to window rows."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                w = Words(pa.array(_unpacked(part.column("z")), pa.large_binary()), SPACES)
                words = w.hashes()
                runs = part.column("runs")
                row = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
                flat = runs.flatten()
                a, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "n"))
                s = np.repeat(w.first[row] + a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                s = np.unique(s)
                row = w.row_of()[s]
                names = tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ROW)
                key, block = (Sequences(words, base).of(s, s + window) for base in (BASE, OTHER_BASE))
                yield _rows(signed(key), signed(block), *_moved(names, row, (s - w.first[row]) << 32))

    return of_batches


def parse(runs: list[tuple[int, int, int, int]], window: int) -> list[dict]:
    """The factors of a greedy parse; runs: (a, n, ref_doc, ref_a), of which windows a to a + n - 1 equal those from ref_a on in ref_doc.

    At each window that has a reference the longest factor is taken: of all displacements that match there, the one that goes on
    matching for the most windows (ties: the smaller ref_doc and place). The next factor begins with the next window, over its end.
    """
    spans: list[list[int]] = []  # (first window, past the last, ref_doc, displacement): adjacent runs of a displacement are one
    for doc, shift, a, n in sorted((doc, ref - a, a, n) for a, n, doc, ref in runs):
        if spans and spans[-1][2:] == [doc, shift] and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + n)
        else:
            spans.append([a, a + n, doc, shift])
    spans.sort()
    factors, open_, at, i = [], [], 0, 0
    while i < len(spans) or open_:
        if not open_:
            at = max(at, spans[i][0])
        while i < len(spans) and spans[i][0] <= at:
            heapq.heappush(open_, (-spans[i][1], spans[i][2], spans[i][3]))
            i += 1
        while open_ and -open_[0][0] <= at:
            heapq.heappop(open_)
        if open_:
            end, doc, shift = open_[0]
            factors.append({"start": at, "words": -end - 1 + window - at, "ref_doc": doc, "ref_start": at + shift})
            at = -end
    return factors


def _cut(window: int, verbatim: bool):
    """For mapInArrow: texts with their matches to (id, n_words, n_removed, kept, factors, rest): the words of the factors go."""
    factor = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))

    def one(text: bytes, runs: list[dict]) -> tuple[int, int, str, list[dict]]:
        words = text.split()
        if not runs:
            return len(words), 0, (text if verbatim else b" ".join(words)).decode(), []
        keep = np.ones(len(words), bool)
        factors = parse([(r["a"], r["n"], r["ref_doc"], r["ref_a"]) for r in runs], window)
        for f in factors:
            keep[f["start"] : f["start"] + f["words"]] = False
        return len(words), int(len(words) - keep.sum()), b" ".join(compress(words, keep.tolist())).decode(), factors

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [one(t, r or []) for t, r in zip(_unpacked(part.column("z")), part.column("runs").to_pylist(), strict=True)]
                n, gone, kept, factors = zip(*done, strict=True)
                if verbatim:
                    kept = [k if z.as_py() else None for k, z in zip(kept, part.column("z"), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ROW), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, factor), part.column("rest")],
                    [*ROW, "n_words", "n_removed", "kept", "factors", "rest"],
                )

    return of_batches


def dedup_substrings(
    docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), verbatim: bool = False
) -> DataFrame:
    """id, n_words, n_removed, kept (the words left, joined by one space), factors and rest of every row.

    factors are the duplicate spans with the earlier place that each copies; rest is a struct of the columns to carry.
    verbatim: a text that loses nothing stays as it is, blanks and all, and null if it was null.
    """
    if not 2 * GRAM <= window <= GRAM + 15:
        raise ValueError(f"window must be {2 * GRAM} to {GRAM + 15} words")
    rest = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    own = docs.select(order_id(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    own = own.select("doc", F.xxhash64("doc").alias("dh"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text", "rest")
    twice = own.groupBy("dh").agg(F.count("*").alias("n")).where("n > 1")
    repeated = bloom.build(twice, "dh")
    repeated = repeated if repeated.any() else None
    blocks = checkpointed(_streamed(own.drop("rest").mapInArrow(_index(window, hot_anchors(own, window), repeated), ROWS)))
    open_blocks = blocks.where("ref_doc IS NULL").groupBy(*ROW).agg(F.collect_set(F.struct("a", "n")).alias("runs"))
    texts = _packed(own, repeated)
    # Both joins deal the same columns of the texts alike, so that they are shuffled once.
    windows = texts.join(open_blocks, ROW).mapInArrow(_boundary_windows(window), ROWS)
    single = _streamed(windows)
    runs = blocks.union(single).where("ref_doc IS NOT NULL")
    runs = runs.groupBy(*ROW).agg(F.collect_set(F.struct("a", "n", "ref_doc", "ref_a")).alias("runs"))
    joined = texts.join(runs, ROW, "left")
    fields = T.StructType.fromDDL(
        "doc long, t1 long, t2 long, n_words long, n_removed long, kept string, factors array<struct<start:int,words:int,ref_doc:long,ref_start:int>>"
    ).fields
    out = joined.mapInArrow(_cut(window, verbatim), T.StructType([*fields, own.schema["rest"]]))
    return out.select(F.when(F.col("doc") < F.lit((1 << 63) - 1), F.col("doc")).alias(id_col), "n_words", "n_removed", "kept", "factors", "rest")
