"""Near-copies by word-shingle similarity: candidates from min-wise sampled shingles, then exact verification.

With `max_distance`, texts are also linked by their SimHash fingerprints, through the deletion-variant index of `simhash`
and without any loss; components are those of both kinds of links. The index alone would not do: at a Jaccard similarity
of 0.8 of five-word shingles, 64-bit SimHash fingerprints differ in 11 bits on average, far beyond what deletion variants
of few segments can reach.
Each text gets `views` keys, each made of three of its shingles, the least under a seeded hash: of two texts with
similarity s a key is equal with a probability of about s**3, and at 0.8 one of sixteen is with 99.999 %. Keys are
equality-joined by the shuffle. Within a key, texts whose whole SimHash fingerprints differ in at most `cutoff`
bits are linked by a minimal spanning forest, the nearest first; each link of a forest is then verified on the two
texts' shingle sets. A link that fails may have stood in for true ones, so its key is tried again with the sets at
hand, over all rows that may still join two components. Texts with equal sets are one class from the start, so
copies are never compared. What can be lost are pairs without an equal key, or with fingerprints beyond the cutoff.

Keys with more than `block` classes are cut into blocks, each pair of which is a task. Rows: null and empty texts
are one class; texts of fewer words than a shingle have their whole sequence as the only one. Null ids come
after all others. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm import simhash
from kvloom.llm.components import components
from kvloom.llm.kernel import BASE, SPACES, Sequences, Words, mix, signed, slices
from kvloom.llm.shared import LAST_ID, checkpointed, fitted, joined_by, order_id, parts, release

PICK = 3


def shingle_sets(column: pa.Array, shingle_words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; A-Z count as a-z."""
    w = Words(column, SPACES, lower=True)
    seq = Sequences(w.hashes())
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        k = min(shingle_words, b - a)
        place = np.arange(a, b - k + 1) if k else np.zeros(0, np.int64)
        yield np.unique(seq.of(place, place + k))


def _sketches(shingle_words: int, views: int, print_words: int | None):
    """For mapInArrow: (id, th, set digest, fingerprint of the set, view keys, fingerprint of `simhash` if it is asked for)."""
    seeds = mix(np.arange(1, views + 1, dtype=np.uint64) * np.uint64(BASE))

    def one(h: np.ndarray) -> tuple[int, int, np.ndarray]:
        if not len(h):
            return 0, 0, mix(seeds.copy())
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        fp = int(np.packbits(2 * bits > len(h)).view(np.uint64)[0])
        keys = np.empty(views, np.uint64)
        for r in range(views):
            order = mix(h ^ seeds[r])
            least = np.argpartition(order, PICK - 1)[:PICK] if len(h) > PICK else np.arange(PICK) % len(h)
            a, b, c = h[least]
            keys[r] = (a & b) | (b & c) | (a & c)
        digest = mix(h.copy()).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))
        return int(mix(digest)[0]), fp, mix(keys + seeds)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                digest, fp, keys = zip(*(one(h) for h in shingle_sets(part.column("text"), shingle_words)), strict=True)
                flat = pa.array(signed(np.concatenate(keys)))
                prints = [simhash.fingerprint(t.as_py(), print_words) if print_words else 0 for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), pa.array(signed(np.array(digest, np.uint64))), pa.array(signed(np.array(fp, np.uint64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, views, dtype=np.int32)), flat), pa.array(signed(np.array(prints, np.uint64)))],
                    ["id", "th", "digest", "fp", "views", "print"],
                )

    return of_batches


def nearest_first(left: np.ndarray, right: np.ndarray, cutoff: int) -> list[tuple[int, int]]:
    """Index pairs of a minimal spanning forest of the fingerprints within the cutoff; left may be right."""
    shift = 0 if left is right else len(left)
    label = np.arange(shift + len(right))
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 22) // max(1, len(right)))
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), step):
        distance = np.bitwise_count(left[at : at + step, None] ^ right[None, :])
        i, j = np.nonzero(distance <= cutoff)
        if shift == 0:
            keep = j > i + at
            i, j = i[keep], j[keep]
        near.append((distance[i, j], (i + at).astype(np.int32), j.astype(np.int32)))
    d, i, j = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, int),) * 3
    order = np.argsort(d, kind="stable")
    i, j = i[order], j[order]
    while len(i):
        apart = label[i] != label[shift + j]
        i, j = i[apart], j[apart]
        for x, y in zip(i[:4096].tolist(), j[:4096].tolist(), strict=True):
            if label[x] != label[shift + y]:
                out.append((x, y))
                label[label == label[shift + y]] = label[x]
        i, j = i[4096:], j[4096:]
    return out


def _linked(cutoff: int, block: int):
    """For mapInArrow over rows sorted by key: links (key, a, b), and the rows (key, name, fp) of keys with too many."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = np.zeros((3, 0), np.int64), False

        def told(rows: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], kind, np.int8)), *(pa.array(np.ascontiguousarray(x)) for x in rows)], ["kind", "key", "a", "b"])

        def group(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1] > block:
                yield told(rows, 1)
            elif rows.shape[1] > 1:
                fp = rows[2].view(np.uint64) if rows[2].flags["C_CONTIGUOUS"] else np.ascontiguousarray(rows[2]).view(np.uint64)
                if pairs := nearest_first(fp, fp, cutoff):
                    i, j = np.array(pairs).T
                    yield told(np.stack([np.full(len(i), rows[0, 0]), rows[1][i], rows[1][j]]), 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            if passing:  # the rest of a key that was too large
                same = int((rows[0] == held[0, 0]).sum())
                if same:
                    yield told(rows[:, :same], 1)
                if same == rows.shape[1]:
                    continue
                rows, held, passing = rows[:, same:], held[:, :0], False
            rows = np.concatenate((held, rows), axis=1)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]))
            for g in np.flatnonzero(np.diff(cuts[:-1]) > 1).tolist():
                yield from group(rows[:, cuts[g] : cuts[g + 1]])
            held = rows[:, cuts[-2] :].copy()
            if held.shape[1] > block:
                yield told(held, 1)
                held, passing = held[:, :1], True
        if not passing:
            yield from group(held)

    return of_batches


def _block_links(cutoff: int):
    """For applyInArrow over (key, lo, hi): links between two blocks of a large key, or within one."""

    def of(table: pa.Table) -> pa.Table:
        fp, name, own = table.column("fp").to_numpy().view(np.uint64), table.column("name").to_numpy(), table.column("own").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = own == lo, own == hi
        if lo == hi:
            pairs, a, b = nearest_first(fp, fp, cutoff), name, name
        else:
            pairs, a, b = nearest_first(fp[left], fp[right], cutoff), name[left], name[right]
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"key": pa.repeat(table.column("key")[0], len(i)), "a": a[i], "b": b[j]})

    return of


def _untried(table: pa.Table, cutoff: int, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of (lo, hi, own, fp, n, label) those after it that it may be linked with; the caller may merge labels on the way."""
    fp, n, label = (np.array(table.column(c).to_numpy()) for c in ("fp", "n", "label"))
    fp = fp.view(np.uint64)  # bits are counted of absolute values
    own, lo, hi = table.column("own").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    for at, i in enumerate(left.tolist()):
        j = right[at + 1 :] if lo == hi else right
        fits = (label[j] != label[i]) & (np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - 1e-9)
        j = j[fits & (np.bitwise_count(fp[j] ^ fp[i]) <= cutoff)]
        yield i, j, label


def _open(cutoff: int, similarity: float):
    """For applyInArrow over (key, lo, hi): the rows that may have a link to another component."""

    def of(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for i, j, _ in _untried(table, cutoff, similarity):
            some[j] = True
            some[i] |= len(j) > 0
        return table.filter(pa.array(some))

    return of


def _tried(cutoff: int, similarity: float):
    """For applyInArrow over (key, lo, hi), with sets: a spanning forest of the true links between components."""

    def of(table: pa.Table) -> pa.Table:
        name, sets, found = table.column("name").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("s")], []
        for i, j, label in _untried(table, cutoff, similarity):
            for k in j.tolist():
                if label[i] != label[k] and alike(sets[i], sets[k], similarity):
                    found.append((name[i], name[k]))
                    label[label == label[k]] = label[i]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b)})

    return of


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of distinct values have the Jaccard similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _sets(shingle_words: int):
    """For mapInArrow: (digest, sorted 32-bit shingle hashes)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in shingle_sets(part.column("text"), shingle_words)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(s, pa.binary())], ["digest", "s"])

    return of_batches


def _similar(similarity: float):
    """For mapInArrow over (a, b, sa, sb): the pairs whose sets are similar enough."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[r].as_buffer(), np.uint32) for k in (2, 3))
                keep[r] = alike(x, y, similarity)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return of_batches


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of keys that are one block each."""
    zero = F.lit(0).cast("long")
    return rows.withColumns({"own": zero, "lo": zero, "hi": zero})


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (key, name, ...) dealt to the blocks of their key, once for each pair of blocks (lo, hi); a key without blocks is one."""
    rows = rows.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name", F.lit(7)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")


def print_links(marked: DataFrame, max_distance: int) -> DataFrame:
    """Links (a < b) between the classes of rows (digest, print) whose fingerprints are equal or linked by the index of `simhash`."""
    both = fitted(checkpointed(marked.select("print", "digest").distinct()))
    prints = fitted(checkpointed(both.groupBy("print").agg(F.min("digest").alias("name"), F.count("*").alias("n"))))
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = joined_by(both, prints.where("n > 1"), "print", "n", total).select(F.col("digest").alias("a"), F.col("name").alias("b"))
    near = fitted(checkpointed(simhash.links(prints.select(F.col("print").alias("fp")), max_distance).distinct()))
    for side in ("a", "b"):
        near = near.join(prints.select(F.col("print").alias(side), F.col("name").alias(f"{side}_name")), side)
    out = same.union(near.select("a_name", "b_name")).where("a <> b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(
    docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8, views: int = 16, cutoff: int = 30, block: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    print_words: int = 3, max_distance: int | None = None,
) -> DataFrame:
    """(id, th, component_id, stays) of every row: stays marks the first row (id, then text hash th) of each group.

    With max_distance, texts whose fingerprints of print_words-word shingles differ in so many bits at most are linked as well.
    """
    spark = docs.sparkSession
    n = parts(spark)
    own = docs.select(order_id(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    sketches = _sketches(shingle_words, views, None if max_distance is None else print_words)
    marked = checkpointed(own.mapInArrow(sketches, "id long, th long, digest long, fp long, views array<long>, print long"))
    first = F.min(F.struct("id", "th"))
    classes = marked.groupBy("digest").agg(first.alias("first"), F.min("fp").alias("fp"), F.min("views").alias("views"), F.count("*").alias("rows"))
    classes = checkpointed(classes)
    keyed = classes.select(F.explode("views").alias("key"), F.col("digest").alias("name"), "fp")
    keyed = keyed.repartition(n, "key").sortWithinPartitions("key")
    found = checkpointed(keyed.mapInArrow(_linked(cutoff, block), "kind byte, key long, a long, b long"))
    edges = found.where("kind = 0").select("key", "a", "b")
    large = found.where("kind = 1").select("key", F.col("a").alias("name"), F.col("b").alias("fp"))
    if has_large := not large.isEmpty():
        blocks = checkpointed(large.groupBy("key").agg(F.ceil(F.count("*") / (block // 2)).alias("blocks")))
        dealt = _dealt(large, blocks)
        edges = edges.union(dealt.groupBy("key", "lo", "hi").applyInArrow(_block_links(cutoff), "key long, a long, b long"))
    edges = fitted(checkpointed(edges.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    pairs = fitted(checkpointed(edges.select("a", "b").distinct()))
    del keyed, found, large
    release(spark)
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = classes.join(wanted, "digest").select("digest", F.col("first.id").alias("id"), F.col("first.th").alias("th"))
    sets = own.join(wanted, ["id", "th"]).select("digest", "text").mapInArrow(_sets(shingle_words), "digest long, s binary").dropDuplicates(["digest"])
    sets = checkpointed(sets)
    release(spark)
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("s").alias("sb")), "b")
    links = both.select("a", "b", "sa", "sb").mapInArrow(_similar(similarity), "a long, b long")
    if max_distance is not None:
        links = links.union(print_links(marked, max_distance))
    links = fitted(checkpointed(links))
    del both, pairs, wanted
    release(spark)
    groups = checkpointed(components(links))
    # A link of a forest that fails may have stood in for true ones: such keys are tried again, with the sets at hand.
    doubtful = fitted(checkpointed(edges.join(links, ["a", "b"], "left_anti").select("key").distinct()))
    if not doubtful.isEmpty():
        again = classes.select(F.explode("views").alias("key"), F.col("digest").alias("name"), "fp").join(doubtful, "key", "left_semi")
        again = again.join(sets.select(F.col("digest").alias("name"), (F.length("s") / 4).cast("long").alias("n")), "name")
        again = again.join(groups.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("component", "name")).drop("component")
        again = _dealt(again, blocks) if has_large else _whole(again)
        rows = "key long, lo long, hi long, own long, name long, fp long, n long, label long"
        again = again.select(*(c.split()[0] for c in rows.split(", "))).groupBy("key", "lo", "hi").applyInArrow(_open(cutoff, similarity), rows)
        again = again.join(sets.withColumnRenamed("digest", "name"), "name")
        more = fitted(checkpointed(again.groupBy("key", "lo", "hi").applyInArrow(_tried(cutoff, similarity), "a long, b long")))
        del again
        if not more.isEmpty():
            groups = checkpointed(components(links.union(more)))
    del sets, edges, doubtful, links
    release(spark)
    named = classes.join(groups, F.col("digest") == F.col("node"), "left").select("digest", "rows", "first", F.coalesce("component", "digest").alias("component"))
    named = checkpointed(named)
    least = checkpointed(named.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    n_rows, n_classes = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    named = checkpointed(joined_by(named, least, "component", "n", n_classes).select("digest", "rows", "least"))
    out = joined_by(marked.select("id", "th", "digest"), named, "digest", "rows", n_rows)
    real = lambda c: F.when(c < F.lit(LAST_ID), c)
    return out.select(
        real(F.col("id")).alias(id_col), "th", real(F.col("least.id")).alias("component_id"),
        ((F.col("id") == F.col("least.id")) & (F.col("th") == F.col("least.th"))).alias("stays"),
    )


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of near-copies."""
    id_col, text_col = parameters.get("id_col", "doc_id"), parameters.get("text_col", "text")
    decided = checkpointed(near_copies(docs, **parameters).where("stays").select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("_id"), F.col("th").alias("_th")))
    repeated = decided.count() > decided.distinct().count()
    kept = docs.join(decided.distinct(), (order_id(id_col) == F.col("_id")) & (F.xxhash64(text_col) == F.col("_th")), "left_semi")
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
