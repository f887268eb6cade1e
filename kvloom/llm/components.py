"""Connected components of a distributed edge table: small ones in one task, others by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.shared import checkpointed, joined_by


#: So many edges (16 MB) are one task's work; the rounds would cost the driver far more than that.
ONE_TASK = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # x and y are roots: each goes below its smallest neighbour
        while not np.array_equal(above := label[label], label):
            label = above
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over a single partition of edges(a, b)."""
    held = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches]
    if held:
        nodes, least = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(least[at : at + (1 << 16)])], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that is reachable.

    At most ONE_TASK edges are joined by union-find in one task. More go by rounds: nothing but two counts a round reaches the driver. Each round's edges are checkpointed in the shared
    folder. A star's centre is found by aggregation and joined back; nodes with more than a thousandth of all
    edges are joined by broadcast, so that none is gathered in one place. Null nodes and loops are ignored; no edges, no rows.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, edges.count()
    if n <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours are linked with its smallest neighbour (or itself).
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = joined_by(both, checkpointed(least), "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # Small star: each node's smaller neighbours, and itself, are linked with the smallest of them.
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = joined_by(large, least, "a", "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
