"""Cross-entropy difference of matched n-gram models.

A target and a background bigram model share one vocabulary, the same smoothing and the same size: they differ
in their counts alone. The background's are of all documents, scaled to as many words as the target's, which are
of the target documents. A document's score is the mean over its words of its loss under the target less that
under the background.

`cross_entropy_difference` counts every word, context and bigram of every document; nothing is cut or shared
(keys are 63 bits of a hash). Documents are dealt to blocks of about BLOCK_BYTES by their id. A block sends the
counts of its own keys once to ranges of keys, whose number grows with the input; a range sums them and answers
each block with the sums of its keys. So a hot key is one row's entry a block, and no task holds the whole table.

`train` and `score` are for callers that ask for models of a given size (`vocabulary` words, one class for all
others, 2**`bits` buckets of bigrams).

Rows: null and empty texts have no words and score 0. Repeated rows count, and are scored, each by itself. A null
id is in no target. An empty target, or table, gives scores from smoothing alone, or none. Texts of any length are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.kernel import BASE, NOT_ALNUM, Words, mix, signed, slices
from kvloom.llm.shared import parts

HELD = 1 << 21
BLOCK_BYTES, LEAST_BLOCK_BYTES = 8 << 20, 1 << 18
#: Stands before a text's first word.
START = np.uint64(0x5DEECE66D1CE4E5B)
SMOOTHING = 50.0


def lower_words(column: pa.Array) -> Words:
    return Words(column, NOT_ALNUM, lower=True)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (word, times), summed over so many words as fit."""
    hashes, times, n = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(hashes), return_inverse=True)
        return h, np.bincount(at, weights=np.concatenate(times)).astype(np.int64)

    def rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], ["word", "times"])

    for batch in batches:
        for part in slices(batch):
            h, c = np.unique(lower_words(part.column("text")).hashes(), return_counts=True)
            hashes.append(h)
            times.append(c)
            n += len(h)
            if n > HELD:
                h, c = merged()
                hashes, times, n = [h], [c], len(h)
                if n > HELD // 2:
                    yield rows(h, c)
                    hashes, times, n = [], [], 0
    if hashes:
        yield rows(*merged())


@dataclass
class Vocabulary:
    """Sorted word hashes; number len(words) is any other word, len(words) + 1 the start of a text."""

    words: np.ndarray
    bits: int

    def bigrams(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its number, the one before it, their bucket; and the first word of each row."""
        w = lower_words(column)
        h, v = w.hashes(), len(self.words)
        at = np.minimum(np.searchsorted(self.words, h), max(0, v - 1))
        number = np.where(self.words[at] == h, at, v) if v else np.zeros(len(h), np.int64)
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[w.first[:-1][w.counts() > 0]] = v + 1
        bucket = (mix((before * (v + 2) + number).astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        return number, before, bucket, w.first


def bigram_counts(vocabulary: Vocabulary):
    """For mapInArrow over (text, is_target): (cell, all, target); cells are buckets, then words, then contexts."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, v = 1 << vocabulary.bits, len(vocabulary.words) + 2
        total = np.zeros((2, size + 2 * v), np.int64)
        for batch in batches:
            for part in slices(batch):
                number, before, bucket, first = vocabulary.bigrams(part.column("text"))
                target = np.repeat(part.column("is_target").to_numpy(zero_copy_only=False), np.diff(first))
                for k, use in enumerate((slice(None), target)):
                    total[k] += np.bincount(np.concatenate((bucket[use], size + number[use], size + v + before[use])), minlength=size + 2 * v)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0, some]), pa.array(total[1, some])], ["cell", "all", "target"])

    return of_batches


@dataclass
class Model:
    """Counts of one model over the shared vocabulary; scale: what a count is worth."""

    pairs: np.ndarray
    words: np.ndarray
    contexts: np.ndarray
    scale: float = 1.0
    smoothing: float = 50.0

    def bits(self, number: np.ndarray, before: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The loss of each word in bits."""
        single = (self.scale * self.words[number] + 0.5) / (self.scale * self.words.sum() + 0.5 * len(self.words))
        # Buckets may be shared by bigrams; a context's count bounds each of its bigrams'.
        pair, context = self.scale * np.minimum(self.pairs[bucket], self.contexts[before]), self.scale * self.contexts[before]
        return -np.log2((pair + self.smoothing * single) / (context + self.smoothing))


def train(docs: DataFrame, target_ids: DataFrame, *, vocabulary: int = 1 << 15, bits: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, Model, Model]:
    """The vocabulary, the target model and the background model."""
    text = F.col(text_col).cast("string").alias("text")
    counts = docs.select(text).mapInArrow(word_counts, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    top = counts.orderBy(F.desc("times"), "word").limit(vocabulary).select("word").collect()
    known = Vocabulary(np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64)), bits)
    ids = target_ids.select(F.col(id_col).cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    # The same join at every size: one shuffle of the texts, whatever the number of target ids.
    marked = docs.select(F.col(id_col).cast("long").alias("id"), text).join(ids.hint("merge"), F.col("id") == F.col("target_id"), "left")
    marked = marked.select("text", F.col("target_id").isNotNull().alias("is_target"))
    cells = marked.mapInArrow(bigram_counts(known), "cell int, all long, target long").groupBy("cell").agg(F.sum("all").alias("all"), F.sum("target").alias("target"))
    size, v = 1 << bits, len(known.words) + 2
    total = np.zeros((2, size + 2 * v), np.float32)
    table = cells.toArrow()  # at most 2**bits + 2 * vocabulary rows
    at = table.column("cell").to_numpy()
    total[0, at], total[1, at] = table.column("all").to_numpy(), table.column("target").to_numpy()
    # Matched: the background's counts are worth as many words as the target has, so that smoothing weighs alike.
    sizes = total[:, size : size + v].sum(axis=1, dtype=np.float64)
    scales = (min(1.0, sizes[1] / sizes[0]) if sizes[1] else 1.0, 1.0)
    background, target = (Model(t[:size], t[size : size + v], t[size + v :], k) for t, k in zip(total, scales, strict=True))
    return known, target, background


def score(docs: DataFrame, known: Vocabulary, target: Model, background: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, target_bits, background_bits (means by word) and score, their difference: lower is more like the target."""
    models = docs.sparkSession.sparkContext.broadcast((known, target, background))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, target, background = models.value
        for batch in batches:
            for part in slices(batch):
                number, before, bucket, first = known.bigrams(part.column("text"))
                n = np.diff(first)
                means = []
                for m in (target, background):
                    sums = np.concatenate(([0.0], np.cumsum(m.bits(number, before, bucket), dtype=np.float64)))
                    means.append((sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1])], ["id", "n_words", "target_bits", "background_bits", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of_batches, "id long, n_words long, target_bits double, background_bits double, score double").withColumnRenamed("id", id_col)


def planes(counts: np.ndarray) -> bytes:
    """Counts, or gaps of sorted keys, with all lowest bytes first, then the next ones: the many zeros compress well."""
    return np.ascontiguousarray(counts.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    """The counts of `planes`."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and of each value its place among them."""
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, at.astype(np.int32)


class Block:
    """The words of a block's documents, and its distinct keys: words (even), contexts and bigrams (odd)."""

    def __init__(self, table: pa.Table):
        mark = table.column("mark").to_numpy()
        self.ids = table.column("id").filter(pa.array(~mark)).combine_chunks()
        wanted = table.column("id").filter(pa.array(mark)).to_numpy()
        known = pc.is_valid(self.ids).to_numpy(zero_copy_only=False)
        self.target = known & np.isin(pc.fill_null(self.ids, 0).to_numpy(), wanted)
        hashes, befores, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in table.filter(pa.array(~mark)).select(["text"]).to_batches():
            for part in slices(batch):
                w = lower_words(part.column("text"))
                h = w.hashes() & ~np.uint64(1)
                before = np.empty_like(h)
                before[1:] = h[:-1]
                before[w.first[:-1][w.counts() > 0]] = START
                hashes.append(h)
                befores.append(before)
                counts.append(w.counts())
        h, before, self.counts = np.concatenate(hashes), np.concatenate(befores), np.concatenate(counts)
        del hashes, befores
        words, self.word = numbered(h)
        contexts, self.context = numbered(before)
        pairs, self.pair = numbered(mix(before * np.uint64(BASE) + h) | np.uint64(1))
        del h, before
        keys = np.concatenate((words, mix(contexts ^ ~START) | np.uint64(1), pairs))
        self.cuts = len(words), len(words) + len(contexts)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def times(self, of: np.ndarray) -> np.ndarray:
        """How often each key occurs among the words that are selected."""
        a, b = self.cuts
        sizes = (a, b - a, len(self.keys) - b)
        found = [np.bincount(at[of], minlength=n) for at, n in zip((self.word, self.context, self.pair), sizes, strict=True)]
        return np.concatenate(found)[self.order]

    def by_word(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, what `times` has for it, for its context and for its bigram."""
        own = np.empty(len(times), np.float64)
        own[self.order] = times
        a, b = self.cuts
        return own[:a][self.word], own[a:b][self.context], own[b:][self.pair]


def block_counts(ranges: int):
    """For applyInArrow over a block: a row for each range of keys."""
    schema = pa.schema({"block": pa.int64(), "part": pa.int64(), "keys": pa.binary(), "all": pa.binary(), "target": pa.binary()})

    def of_block(table: pa.Table) -> pa.Table:
        b = Block(table)
        if not len(b.keys):
            return schema.empty_table()
        every, target = b.times(np.ones(len(b.word), bool)), b.times(np.repeat(b.target, b.counts))
        part = (b.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64)).tolist()
        at = [slice(x, y) for x, y in zip(edges, edges[1:], strict=False)]
        own = [table.column("block")[0].as_py()] * ranges
        return pa.table([own, range(ranges), [planes(np.diff(b.keys[x], prepend=np.uint64(0))) for x in at], [planes(every[x]) for x in at], [planes(target[x]) for x in at]], schema=schema)

    return of_block


ANSWER = pa.schema({"block": pa.int64(), "part": pa.int64(), "all": pa.binary(), "target": pa.binary(), "words": pa.int64(), "n_all": pa.int64(), "n_target": pa.int64()})


def range_sums(table: pa.Table) -> pa.Table:
    """For applyInArrow over a range of keys: to each block, the sums for its keys; and the range's words and their occurrences."""
    rows = {name: table.column(name).to_pylist() for name in ("block", "part", "keys", "all", "target")}
    keys, at = numbered(np.concatenate([np.cumsum(unplanes(k).view(np.uint64)) for k in rows.pop("keys")]))
    every, target = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    edges = np.cumsum([0, *(len(x) // 8 for x in rows["all"])]).tolist()
    for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
        np.add.at(every, at[x:y], unplanes(rows["all"][i]))
        np.add.at(target, at[x:y], unplanes(rows["target"][i]))
    word = keys & np.uint64(1) == 0
    totals = [[int(t)] * len(edges[1:]) for t in (word.sum(), every[word].sum(), target[word].sum())]
    of = [at[x:y] for x, y in zip(edges, edges[1:], strict=False)]
    return pa.table([rows["block"], rows["part"], [planes(every[i]) for i in of], [planes(target[i]) for i in of], *totals], schema=ANSWER)


def block_scores(table: pa.Table, answers: pa.Table) -> pa.Table:
    """For applyInArrow over a block and its answers: a row for each document."""
    b = Block(table)
    n = b.counts
    means = [np.zeros(len(n)), np.zeros(len(n))]
    if len(b.keys):
        answers = answers.sort_by("part")
        vocabulary, n_all, n_target = (pc.sum(answers.column(name)).as_py() for name in ("words", "n_all", "n_target"))
        # Matched: the background's counts are worth as many words as the target has, so that smoothing weighs alike.
        models = (("target", n_target, 1.0), ("all", n_all, min(1.0, n_target / n_all) if n_target else 1.0))
        row = np.repeat(np.arange(len(n)), n)
        for k, (name, total, scale) in enumerate(models):
            word, context, pair = b.by_word(np.concatenate([unplanes(x) for x in answers.column(name).to_pylist()]))
            single = (scale * word + 0.5) / (scale * total + 0.5 * vocabulary)
            bits = -np.log2((scale * pair + SMOOTHING * single) / (scale * context + SMOOTHING))
            means[k] = np.bincount(row, weights=bits, minlength=len(n)) / np.maximum(n, 1)
    return pa.table({"id": b.ids, "n_words": n, "target_bits": means[0], "background_bits": means[1], "score": means[0] - means[1]})


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, *, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `score` gives, for the documents that the models are of, from exact counts of all words and bigrams."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("mark"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes), min(parts(docs.sparkSession), size // LEAST_BLOCK_BYTES))
    ids = target_ids.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark")).where("id IS NOT NULL")
    block = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(n)).alias("block")
    blocks = own.unionAll(ids).select(block, "id", "text", "mark")  # one shuffle of the texts, read twice
    counts = blocks.groupBy("block").applyInArrow(block_counts(n), "block long, part long, keys binary, all binary, target binary")
    answers = counts.groupBy("part").applyInArrow(range_sums, "block long, part long, all binary, target binary, words long, n_all long, n_target long")
    scores = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        block_scores, "id long, n_words long, target_bits double, background_bits double, score double"
    )
    return scores.withColumnRenamed("id", id_col)
