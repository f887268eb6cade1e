"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's window (10 consecutive words; the whole item if it has fewer) occurs in a document only if all of
its shingles do, so its one necessary prefix token is its rarest shingle, by the number of times that the
documents hold it. Documents' shingles are equality-joined with the prefix tokens; a token's place in window
and document then fixes where the window would lie, which must be inside the document, and there the words
themselves are compared. A sketch of fixed size keeps shingles that are no token from being shuffled, and
loses none.

Rows: null and empty texts have no words. Items without words have no windows; items with a null id count
for hit words but are not listed. Repeated documents each get a row, repeated items count once. Empty tables
give an empty result, or one without hits. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import bloom
from kvloom.llm.kernel import LOWER, NOT_ALNUM, Sequences, Words, signed, slices
from kvloom.llm.shared import checkpointed

SHINGLE = 3
#: Distinct shingles that a task counts before it gives the counts out.
HELD = 1 << 20


def item_windows(items: DataFrame, window_words: int, id_col: str, text_col: str) -> DataFrame:
    """(item, window, n, shingles): every window of every item with the hashes of its shingles in order."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), NOT_ALNUM, lower=True)
                seq = Sequences(w.hashes())
                raw = w.data.tobytes()
                item, window, size, shingles = [], [], [], []
                for r, name in enumerate(part.column("item").to_pylist()):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    n = min(window_words, b - a)
                    words = [raw[x:y].decode() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                    for s in range(b - a - n + 1) if n else ():
                        k = min(SHINGLE, n)
                        at = a + s + np.arange(n - k + 1)
                        item.append(name)
                        window.append(" ".join(words[s : s + n]))
                        size.append(n)
                        shingles.append(signed(seq.of(at, at + k)).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.string()), pa.array(window, pa.string()), pa.array(size, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))],
                    ["item", "window", "n", "shingles"],
                )

    own = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of_batches, "item string, window string, n int, shingles array<long>")


def _shingles(w: Words, seq: Sequences, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where k words of one row begin, and their hashes."""
    place = np.arange(len(w) - k + 1) if len(w) >= k else np.zeros(0, np.int64)
    last = np.repeat(w.first[1:], w.counts())[: len(place)]
    place = place[place + k <= last]
    return place, seq.of(place, place + k)


def _counted(sketch: np.ndarray, sizes: list[int]):
    """For mapInArrow: (shingle, times) of what the sketch lets through, summed over so many shingles as fit."""

    def told(times: dict[int, int]) -> pa.RecordBatch:
        h = np.fromiter(times, np.uint64, len(times))
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.fromiter(times.values(), np.int64, len(times)))], ["shingle", "times"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag, times = bloom.flags(sketch), {}
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), NOT_ALNUM, lower=True)
                seq = Sequences(w.hashes())
                for k in sizes:
                    _, h = _shingles(w, seq, k)
                    for x, c in zip(*(y.tolist() for y in np.unique(h[bloom.maybe(flag, h)], return_counts=True)), strict=True):
                        times[x] = times.get(x, 0) + c
                if len(times) > HELD:
                    yield told(times)
                    times = {}
        yield told(times)

    return of_batches


def _candidates(sketch: np.ndarray, sizes: list[int], window_words: int):
    """For mapInArrow: a row for each document (n_words), and one for each place of a possible token with the words around it."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = bloom.flags(sketch)
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), NOT_ALNUM, lower=True)
                seq, rows = Sequences(w.hashes()), w.row_of()
                places, tokens, reach = [], [], []
                for k in sizes:
                    at, h = _shingles(w, seq, k)
                    keep = bloom.maybe(flag, h)
                    places.append(at[keep])
                    tokens.append(h[keep])
                    reach.append(np.full(len(places[-1]), window_words if k == SHINGLE else k))  # a shorter token is its whole window
                at, h, reach = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, tokens, reach))
                row = rows[at]
                left = np.minimum(at - w.first[row], np.where(reach < SHINGLE, 0, reach - 1))
                until = np.minimum(at + reach, w.first[row + 1])
                raw = w.data.tobytes()
                around = [
                    " ".join(raw[x:y].decode() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True))
                    for a, b in zip((at - left).tolist(), until.tolist(), strict=True)
                ]
                n, m = w.rows, len(at)
                take = pa.array(np.concatenate((np.arange(n), row)))
                blank = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(take), part.column("th").take(take),
                        pa.concat_arrays([pa.array(w.counts()), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(signed(h.astype(np.uint64)))]),
                        pa.concat_arrays([blank, pa.array((at - w.first[row]).astype(np.int32))]),
                        pa.concat_arrays([blank, pa.array(left.astype(np.int32))]),
                        pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(around, pa.string())]),
                    ],
                    ["id", "th", "n_words", "token", "pos", "left", "around"],
                )

    return of_batches


def find_windows(
    docs: DataFrame, items: DataFrame, *, window_words: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, th, n_words), occurrences (id, th, start, n, window) and the items of each window (window, item).

    th, a hash of the text, tells rows apart that share an id.
    """
    windows = checkpointed(item_windows(items, window_words, item_col, text_col))
    distinct = windows.groupBy("window", "n").agg(F.first("shingles").alias("shingles"))
    sizes = sorted({min(SHINGLE, r["n"]) for r in windows.select("n").distinct().collect()})
    own = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text")
    )
    shingles = distinct.select(F.explode("shingles").alias("shingle"))
    times = own.select("text").mapInArrow(_counted(bloom.build(shingles, "shingle"), sizes), "shingle long, times long")
    times = times.groupBy("shingle").agg(F.sum("times").alias("times"))
    placed = distinct.select("window", "n", F.posexplode("shingles").alias("offset", "shingle")).join(times, "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "offset")).alias("r")
    prefix = placed.groupBy("window", "n").agg(rarest).where("r.times > 0").select("window", "n", F.col("r.shingle").alias("token"), F.col("r.offset").alias("offset"))
    prefix = checkpointed(prefix)
    found = own.mapInArrow(
        _candidates(bloom.build(prefix, "token"), sizes, window_words),
        "id long, th long, n_words long, token long, pos int, left int, around string",
    )
    found = checkpointed(found)
    words = F.split("around", " ")
    hits = (
        found.where("token IS NOT NULL")
        .join(prefix, "token")
        .where((F.col("left") >= F.col("offset")) & (F.col("left") - F.col("offset") + F.col("n") <= F.size(words)))
        .where(F.array_join(F.slice(words, F.col("left") - F.col("offset") + 1, F.col("n")), " ") == F.col("window"))
        .select("id", "th", (F.col("pos") - F.col("offset")).alias("start"), "n", "window")
    )
    return found.where("token IS NULL").select("id", "th", "n_words"), checkpointed(hits), windows.select("window", "item").distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window_words: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    texts, hits, named = find_windows(docs, items, window_words=window_words, id_col=id_col, item_col=item_col, text_col=text_col)
    reach = F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))
    words = hits.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    words = words.select("id", "th", F.size(F.array_distinct(F.flatten(reach))).cast("long").alias("n_hit"))
    listed = hits.select("id", "th", "window").distinct().join(named, "window").groupBy("id", "th").agg(F.collect_set("item").alias("items"))
    listed = listed.select(
        "id", "th", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
    )
    per_doc = words.join(listed, words["id"].eqNullSafe(listed["id"]) & (words["th"] == listed["th"]), "left").select(
        words["id"].alias("hit_id"), words["th"].alias("hit_th"), "n_hit", "n_items", "items_sha256"
    )
    joined = texts.join(per_doc, texts["id"].eqNullSafe(F.col("hit_id")) & (texts["th"] == F.col("hit_th")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )
