"""SimHash near-duplicates by deletion-variant signatures.

A text's 64-bit fingerprint is the bitwise majority over the XXH64 (seed 42) of its word shingles. Two
fingerprints that differ in at most d bits, cut into ceil((d + 1) / 2) segments, have a segment in which they
differ in at most one bit. Each distinct fingerprint is therefore indexed under each of its segments, and
under each segment with one bit deleted; equal index keys are brought together by the shuffle and verified.
In a key with a deleted bit only the fingerprints that have the bit are held against those that lack it:
those that agree meet under the whole segment. A key yields a spanning forest of its links and not all
pairs. Keys with more than `block` fingerprints are cut into blocks, and each pair of blocks is a task.

Rows: null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id keep their
own row; the smallest id of a component ignores nulls, and is null only if all of its ids are. Repeated rows
stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.components import components
from kvloom.llm.shared import checkpointed, joined_by, parts

SEED = 42


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle_words, len(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    of = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        a, b = starts[at : min(n, at + 65536)].tolist(), ends[at + k - 1 : min(n, at + 65536) + k - 1].tolist()
        h = np.array([of(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of_batches, "id long, fp long"
    )


def segments(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    n = (max_distance + 2) // 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(left: np.ndarray, right: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right (the same array: within it)."""
    shift = 0 if left is right else len(left)
    label = np.arange(shift + len(right))
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= max_distance
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            other = np.flatnonzero(near[i])
            other = other[label[shift + other] != label[at + i]]
            while len(other):
                out.append((int(left[at + i]), int(right[other[0]])))
                label[label == label[shift + other[0]]] = label[at + i]
                other = other[label[shift + other] != label[at + i]]
    return out


def _variants(max_distance: int):
    """For mapInArrow: distinct fingerprints to (key, has the deleted bit, fp)."""
    cut = segments(max_distance)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                fp = whole.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                for s, (low, n) in enumerate(cut):
                    part = (fp >> np.uint64(low)) & np.uint64((1 << n) - 1)
                    keys, sides = [part | np.uint64(s << 58)], [np.full(len(fp), 2, np.int8)]
                    for bit in range(n):
                        keys.append((part & ~np.uint64(1 << bit)) | np.uint64((s << 58) | ((bit + 1) << 51)))
                        sides.append(((part >> np.uint64(bit)) & np.uint64(1)).astype(np.int8))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sides)), pa.array(np.tile(fp, n + 1).view(np.int64))],
                        ["key", "side", "fp"],
                    )

    return of_batches


def _verified(max_distance: int, block: int):
    """For mapInArrow over rows sorted by key: links, and, of keys with too many rows, the rows themselves."""
    names = ["key", "side", "a", "b"]

    def rows(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        cols = np.array(found, dtype=np.uint64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(cols[:, 0]).view(np.int64)),
             pa.array(cols[:, 1].astype(np.int8)),
             pa.array(np.ascontiguousarray(cols[:, 2]).view(np.int64)),
             pa.array(np.ascontiguousarray(cols[:, 3]).view(np.int64))], names)

    def links(side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int, int, int]]:
        if side[0] == 2:
            pairs = _forest(fp, fp, max_distance)
        else:
            pairs = _forest(fp[side == 0], fp[side == 1], max_distance)
        return [(0, 3, a, b) for a, b in pairs]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the key that the last batch ended in
        key_held, n_held, passing = None, 0, False

        def close() -> list[tuple[int, int, int, int]]:
            if n_held < 2 or passing:
                return []
            side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            return links(side, fp) if side[0] == 2 or side.min() != side.max() else []

        def passed(key: int, side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int, int, int]]:
            return [(key & (1 << 64) - 1, int(s), f, 0) for s, f in zip(side.tolist(), fp.tolist(), strict=True)]

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            side = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            found: list[tuple[int, int, int, int]] = []
            sizes = np.diff(cuts)
            # Whole keys of one row, and those in which all have or all lack the bit, link nothing.
            low, high = np.minimum.reduceat(side, cuts[:-1]), np.maximum.reduceat(side, cuts[:-1])
            open_ends = {0, len(sizes) - 1}
            for g in sorted(open_ends | set(np.flatnonzero((sizes > 1) & ((low == 2) | (low != high))).tolist())):
                a, b, k = int(cuts[g]), int(cuts[g + 1]), int(key[cuts[g]])
                if k != key_held:
                    found += close()
                    held, key_held, n_held, passing = [], k, 0, False
                n_held += b - a
                if passing:
                    found += passed(k, side[a:b], fp[a:b])
                elif n_held > block:
                    for s, f in [*held, (side[a:b], fp[a:b])]:
                        found += passed(k, s, f)
                    held, passing = [], True
                else:
                    held.append((side[a:b].copy(), fp[a:b].copy()))
                if g not in open_ends:
                    found += close()
                    held, key_held, n_held, passing = [], None, 0, False
            if found:
                yield rows(found)
        if found := close():
            yield rows(found)

    return of_batches


def links(distinct: DataFrame, max_distance: int, block: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints(fp): a forest under each index key."""
    n = parts(distinct.sparkSession)
    keyed = distinct.mapInArrow(_variants(max_distance), "key long, side byte, fp long")
    keyed = keyed.repartition(n, "key").sortWithinPartitions("key")
    out = checkpointed(keyed.mapInArrow(_verified(max_distance, block), "key long, side byte, a long, b long"))
    pairs = out.where("side = 3").select("a", "b")
    large = out.where("side < 3").select("key", "side", F.col("a").alias("fp"))
    if large.isEmpty():
        return pairs
    # Each block of a large key meets each other block of it once: (low block, high block) is a task.
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / (block // 2)).alias("blocks"))
    large = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")))
    large = large.select("key", "side", "fp", F.col("own").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "side", "fp")

    def pair(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        side, own = table.column("side").to_numpy(), table.column("own").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        at_lo, at_hi = own == lo, own == hi
        if side[0] == 2:
            tries = [(fp, fp)] if lo == hi else [(fp[at_lo], fp[at_hi])]
        else:
            tries = [(fp[at_lo & (side == 0)], fp[at_hi & (side == 1)])]
            if lo != hi:
                tries.append((fp[at_lo & (side == 1)], fp[at_hi & (side == 0)]))
        found = np.array([x for a, b in tries for x in _forest(a, b, max_distance)], dtype=np.uint64).reshape(-1, 2)
        return pa.table({"a": np.ascontiguousarray(found[:, 0]).view(np.int64), "b": np.ascontiguousarray(found[:, 1]).view(np.int64)})

    return pairs.union(large.groupBy("key", "lo", "hi").applyInArrow(pair, "a long, b long"))


def near_duplicates(
    docs: DataFrame, *, shingle_words: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = 2048
) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row."""
    marked = checkpointed(fingerprints(docs, shingle_words, id_col, text_col))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    found = checkpointed(components(links(classes.select("fp"), max_distance, block)))
    named = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rows", "first", F.coalesce("component", "fp").alias("component"))
    named = checkpointed(named)
    least = checkpointed(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    n_rows, n_classes = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    named = checkpointed(joined_by(named, least, "component", "n", n_classes).select("fp", "rows", "component_id"))
    return joined_by(marked, named, "fp", "rows", n_rows).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
