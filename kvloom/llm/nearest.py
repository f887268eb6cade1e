"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are dealt to column blocks, queries to row blocks; each pair of a row block and a column block meets
once, by an equality join on the two block numbers. In a pair, vectors are quantised to int8 with a scale of
their own; the integer product of two tiles then gives every inner product with a proven error bound. A pair
survives if its upper bound reaches the k-th best lower bound of its query; survivors alone are computed in
double precision on the original vectors, and go to the query's heap. The heaps of all column blocks are
merged at the end. So the result is exact, and does not depend on how rows are dealt.

Vectors of floats are shuffled as floats. A vector is sent once to each row block and a query once to each
column block; blocks hold as many rows as `block_bytes` allows, so that copies are few.

Rows: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, take
no part. Vectors of another length than the query's are no candidates. Every row is a candidate of its own,
repeated rows and repeated ids too, but for the rows with the query's id. Rows that share id and vector are one
query; an id with several vectors is a query for each. Ties go to the smaller id; of many equal vectors in a
tile no more than the first k of an id, and 2 k in all, are computed: at least k of those are of other ids
than the query's. An empty table gives an empty result. Vectors of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.shared import checkpointed, parts

TILE = 2048
#: Rows of a block, whatever their bytes: no more than this many.
MOST_ROWS = 1 << 16
HEAP = "query_id long, q long, vec_id long, score double"


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v has floats or doubles."""
    kind = embeddings.schema[vector_col].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = F.col(vector_col) if exact else F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and for the bound the sums of the absolute values before and after."""
    scale = np.abs(v).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    q = np.rint(v / scale[:, None]).astype(np.int8)
    return q, scale, np.abs(v).sum(axis=1), np.abs(q.astype(np.float64)).sum(axis=1) * scale


def tile_survivors(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, vector row) of the pairs that may be among the k nearest; own marks pairs that are no candidates.

    floor: of each query, the k-th best product that is known already. |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|, and
    rounding moves a component by half a scale at most.
    """
    qa, sa, la, _ = quantised(queries)
    qb, sb, _, mb = quantised(vectors)
    # Products of int8 sum to less than 2**24 for up to 1,040 components: float32 holds them without rounding.
    kind = np.float32 if queries.shape[1] <= 1024 else np.float64
    about = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    error = (sa[:, None] * mb[None, :] + la[:, None] * sb[None, :]) / 2 * (1 + 1e-9) + 1e-300
    low, high = np.where(own, -np.inf, about - error), np.where(own, -np.inf, about + error)
    if low.shape[1] >= k:
        floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
    slack = 1e-12 * (np.abs(floor) + 1)
    slack[~np.isfinite(slack)] = 0
    return np.nonzero((high >= (floor - slack)[:, None]) & ~own)


def _merge(qi: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The rows that are their query's k best: highest score, then smallest id."""
    order = np.lexsort((vid, -score, qi))
    rank = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
    return order[rank < k]


def _few(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows that may be among the k nearest of some query: of equal vectors the first k of an id, and of these the first 2 k."""
    _, same = np.unique(vectors, axis=0, return_inverse=True)
    by = np.lexsort((ids, same.ravel()))
    group, own = same.ravel()[by], ids[by]
    at = np.arange(len(by))
    new = np.concatenate(([True], group[1:] != group[:-1]))
    new_id = new | np.concatenate(([True], own[1:] != own[:-1]))
    by, group = by[at - np.maximum.accumulate(np.where(new_id, at, 0)) < k], group[at - np.maximum.accumulate(np.where(new_id, at, 0)) < k]
    return np.sort(by[np.arange(len(by)) - np.searchsorted(group, group) < 2 * k])


def _pair(k: int):
    """For applyInArrow: the heaps of a row block over one column block."""

    def of(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), -1)
        qid, name, q = ids[is_query], table.column("q").to_numpy()[is_query], v[is_query].astype(np.float64)
        cid, c = ids[~is_query], v[~is_query]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(cid):
            few = _few(cid, c, k)
            cid, c = cid[few], c[few]
        for qa in range(0, len(qid), TILE):
            for at in range(0, len(cid), TILE):
                qs, cs, ci = q[qa : qa + TILE], c[at : at + TILE].astype(np.float64), cid[at : at + TILE]
                floor = np.full(len(qs), -np.inf)
                here = (best[0] >= qa) & (best[0] < qa + len(qs))
                held = np.bincount(best[0][here] - qa, minlength=len(qs))
                np_floor = np.full(len(qs), np.inf)
                np.minimum.at(np_floor, best[0][here] - qa, best[2][here])
                floor[held >= k] = np_floor[held >= k]
                r, s = tile_survivors(qs, cs, qid[qa : qa + TILE, None] == ci[None, :], k, floor)
                score = np.concatenate([exact_products(qs[r[i : i + 65536]], cs[s[i : i + 65536]]) for i in range(0, max(1, len(r)), 65536)])
                best = tuple(np.concatenate(x) for x in zip(best, (r + qa, ci[s], score), strict=True))
                top = _merge(*best, k)
                best = tuple(x[top] for x in best)
        return pa.table({"query_id": qid[best[0]], "q": name[best[0]], "vec_id": best[1], "score": best[2]})

    return of


def search(
    embeddings: DataFrame, is_query: Column, *, k: int = 20, block_bytes: int = 64 << 20, row_block: int | None = None, column_block: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query among all other vectors, by inner product.

    row_block and column_block are rows of a block; by default what block_bytes holds, and fewer where that leaves tasks idle.
    """
    # The row number deals rows of one id, or equal rows, to many blocks; it is fixed by the checkpoint.
    rows = usable(embeddings, id_col, vector_col).withColumn("is_query", is_query).withColumn("dim", F.size("v")).withColumn("n", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    queries = checkpointed(rows.where("is_query").select("dim", "id", "v").distinct())
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(TILE // 2, min(MOST_ROWS, block_bytes // (8 * dim)))
    spread = max(4 * TILE, -(-n // parts(embeddings.sparkSession)))
    columns, lines = max(1, -(-n // (column_block or min(most, spread)))), max(1, -(-queries.count() // (row_block or most)))
    column = F.pmod(F.xxhash64("n"), F.lit(columns)).cast("int")
    line = F.pmod(F.xxhash64("id", "v"), F.lit(lines)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("dim", line.alias("i"), each(columns).alias("j"), F.lit(True).alias("is_query"), "id", F.xxhash64("v").alias("q"), "v")
    right = rows.select("dim", each(lines).alias("i"), column.alias("j"), F.lit(False).alias("is_query"), "id", F.lit(0).cast("long").alias("q"), "v")
    heaps = left.union(right).groupBy("dim", "i", "j").applyInArrow(_pair(k), HEAP)
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
