"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(x w - t_k): one vector of hashed-text weights is shared by all grades, and the ordered
thresholds t_1 < t_2 < ... part them. x holds the shares of a text's words (hashed), of its character-class
trigrams (case, digits, punctuation), and of words that repeat the one before. The expected grade is the sum
of the tail probabilities; selection takes the texts whose tail probability at a grade is high enough.

The model is fitted on at most `sample_rows` rated rows, chosen by a seeded hash of the id; scoring covers
all rows and whole texts. Rows: null and empty texts have x = 0, and so the score that thresholds alone
give. Null ratings are ignored; of different ratings of an id the highest holds; of rows that share a rated id one text (that of
the least hash) is learnt from, and all are scored. Texts of any length are read whole. Without ratings every grade is 0 and the tail probability 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.kernel import LOWER, SPACES, Words, slices
from kvloom.llm.shared import checkpointed

WORD_BUCKETS = 1 << 16
#: Lower case, upper case, digits, other letters, blanks, line ends; each other ASCII byte is a class of its own.
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:], CLASS[[32, 9]], CLASS[[10, 13]] = 0, 1, 2, 3, 4, 5
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS[_OTHER] = 6 + np.arange(len(_OTHER))
CLASSES = 7 + len(_OTHER)
CLASS[[*range(9), 11, 12, *range(14, 32), 127]] = CLASSES - 1
SIZE = WORD_BUCKETS + CLASSES**3 + 1
SCALE = 30.0


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Three groups of (row, feature) with the number of each row's entries."""
    w = Words(column, SPACES)
    lower = Words(column, SPACES)
    lower.data = LOWER[w.data]
    h = lower.hashes()
    yield w.row_of(), (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), w.counts()
    c = CLASS[w.data]
    row = np.repeat(np.arange(w.rows), np.diff(w.offsets))
    inside = np.flatnonzero(row[:-2] == row[2:]) if len(c) > 2 else np.zeros(0, np.int64)
    grams = WORD_BUCKETS + (c[inside] * CLASSES + c[inside + 1]) * CLASSES + c[inside + 2]
    yield row[inside], grams, np.bincount(row[inside], minlength=w.rows)
    again = np.flatnonzero((h[1:] == h[:-1]) & (w.row_of()[1:] == w.row_of()[:-1])) if len(h) > 1 else np.zeros(0, np.int64)
    yield w.row_of()[again], np.full(len(again), SIZE - 1), w.counts()


@dataclass
class Model:
    """Weights and thresholds; of fixed size."""

    weights: np.ndarray
    thresholds: np.ndarray

    def linear(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for row, feature, n in features(column):
            out += np.bincount(row, weights=self.weights[feature], minlength=len(column)) * SCALE / np.maximum(n, 1)
        return out

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for each row and k = 1, 2, ..."""
        z = self.linear(column)[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ordered(p: np.ndarray, m: int) -> np.ndarray:
    """Thresholds from parameters: m weights, the first threshold, and the logarithms of the steps to the next ones."""
    return np.cumsum(np.concatenate((p[m : m + 1], np.exp(p[m + 1 :]))))


def loss(p: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, decay: float) -> tuple[float, np.ndarray]:
    """The mean log loss of the cumulative links (with half the decay times the squared weights), and its gradient by p."""
    n, m = len(grade), len(p) - grades + 1
    w, t = p[:m], ordered(p, m)
    z = np.bincount(row, weights=w[at] * value, minlength=n)
    s = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30)))
    ends = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
    own = np.maximum(ends[np.arange(n), grade] - ends[np.arange(n), grade + 1], 1e-9)
    # d(-log P(y))/dz_k: a row's own grade lies between the tails y and y + 1.
    slope = np.zeros((n, grades - 1))
    for k in range(1, grades):
        d = s[:, k - 1] * (1 - s[:, k - 1])
        slope[:, k - 1] = np.where(grade == k, -d / own, np.where(grade == k - 1, d / own, 0.0))
    by_t = -slope.mean(axis=0)
    by_w = np.bincount(at, weights=slope.sum(axis=1)[row] * value, minlength=m) / n + decay * w
    steps = [np.exp(p[m + j]) * by_t[j:].sum() for j in range(1, grades - 1)]
    return float(-np.log(own).mean() + decay / 2 * (w**2).sum()), np.concatenate((by_w, [by_t.sum()], steps))


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, their weights, thresholds), by Adam on the loss."""
    names, at = np.unique(feature, return_inverse=True)
    tail = np.array([(grade >= k).mean() for k in range(1, grades)])
    tail = np.clip(tail, 1e-3, 1 - 1e-3)
    t = -np.log(tail / (1 - tail))
    p = np.concatenate((np.zeros(len(names)), [t[0]], np.log(np.maximum(np.diff(t), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, rounds + 1):
        _, by_p = loss(p, row, at, value, grade, grades, decay)
        m, v = 0.9 * m + 0.1 * by_p, 0.999 * v + 0.001 * by_p**2
        p = p - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return names, p[: len(names)], ordered(p, len(names))


def fitted(grades: int):
    """For mapInArrow over a bounded sample in one task: (text, grade) to (feature, weight); thresholds have features below 0."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns, values, labels, n = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                for row, feature, total in features(part.column("text")):
                    pair, times = np.unique(row * SIZE + feature, return_counts=True)
                    rows.append(pair // SIZE + n)
                    columns.append((pair % SIZE).astype(np.int32))
                    values.append((times * SCALE / np.maximum(total[pair // SIZE], 1)).astype(np.float32))
                labels.append(part.column("grade").to_numpy(zero_copy_only=False))
                n += part.num_rows
        if n:
            names, w, t = fit(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), np.concatenate(labels).astype(np.int64), grades)
            some = np.flatnonzero(np.abs(w) > 1e-4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((names[some].astype(np.int64), -1 - np.arange(len(t))))), pa.array(np.concatenate((w[some], t)))], ["feature", "weight"]
            )

    return of_batches


def train(docs: DataFrame, ratings: DataFrame, *, grades: int, sample_rows: int = 6_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """A model from ratings (id, grade from 0 to grades - 1)."""
    own = ratings.where(F.col(grade_col).between(0, grades - 1) & F.col(id_col).isNotNull())
    own = checkpointed(own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(grade_col).cast("int").alias("grade")))
    share = min(1.0, sample_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most about sample_rows ids, and one text of each; in order, so that sums come out alike.
    sample = texts.join(F.broadcast(own), "id").groupBy("id", "grade").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "t.text", "grade")
    weights, thresholds = np.zeros(SIZE), np.zeros(grades - 1)
    for feature, weight in sample.repartition(1).sortWithinPartitions("id").select("text", "grade").mapInArrow(fitted(grades), "feature long, weight double").collect():
        if feature < 0:
            thresholds[-1 - feature] = weight
        else:
            weights[feature] = weight
    return Model(weights.astype(np.float32), thresholds)


def score(docs: DataFrame, model: Model, *, least_grade: int = 1, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, tail_probability (of least_grade or more) and selected of every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tails = model.tails(part.column("text"))
                tail = tails[:, least_grade - 1]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least_tail)], ["id", "expected_grade", "tail_probability", "selected"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(of_batches, "id long, expected_grade double, tail_probability double, selected boolean").withColumnRenamed("id", id_col)
