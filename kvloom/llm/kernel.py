"""Vectorised words and word hashes over Arrow text, for use inside mapInArrow.

Everything works on the UTF-8 bytes of many texts at once; there is no Python loop over words or rows.
A batch is handled in slices of a few MB, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Odd multiplier of the polynomial word-sequence hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes that part words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that part words of letters and digits: all ASCII but 0-9, A-Z, a-z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
#: A-Z lower-cased, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about SLICE_BYTES of text; one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, pa.scalar(b"" if binary else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a slice: byte ranges (start, end), and for each row the range of its words (first)."""

    def __init__(self, column: pa.Array, parting: np.ndarray, lower: bool = False):
        data, offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.rows = len(column)
        n = len(data)
        inside = ~parting[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        length = self.end - self.start
        out = np.zeros(len(self), np.uint64)
        alive = np.arange(len(self))
        at, left = self.start.copy(), length.copy()
        step, j = np.uint64(BASE), 0
        while len(alive):
            out[alive] = out[alive] * step + BYTE_VALUES[self.data[at]]
            j += 1
            at += 1
            left -= 1
            if j < 64:
                keep = left > 0
                alive, at, left = alive[keep], at[keep], left[keep]
            else:  # the few very long words, one by one
                for w, a, k in zip(alive.tolist(), at.tolist(), left.tolist(), strict=True):
                    if k > 0:
                        rest = BYTE_VALUES[self.data[a : a + k]]
                        power = np.full(k, BASE, np.uint64)
                        power = np.multiply.accumulate(power)
                        tail = (rest[::-1] * power).sum(dtype=np.uint64, keepdims=True)
                        out[w : w + 1] = out[w : w + 1] * power[-1:] + tail
                break
        return mix(out + length.astype(np.uint64) * np.uint64(BASE_INVERSE))


#: Odd multiplier of a second word-sequence hash, independent of the first.
OTHER_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size, both = max(n, 1 << 16), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = (both[0], both[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


class Sequences:
    """Hashes of any word ranges [a, b) of a slice, from prefix sums."""

    def __init__(self, word_hashes: np.ndarray, base: int = BASE):
        up, self.down = _powers(len(word_hashes) + 1, base)
        self.sums = np.zeros(len(word_hashes) + 1, np.uint64)
        np.cumsum(word_hashes * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(BASE))


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return h.view(np.int64)
