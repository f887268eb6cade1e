"""A membership sketch of fixed size for 64-bit keys: no false negatives, and it never grows with the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23


def build(keys: DataFrame, key: str) -> np.ndarray:
    """2**BITS flags as packed bits (1 MB) of the keys, gathered as at most 2**BITS / 64 words."""
    at = [F.col(key).bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftrightunsigned(key, BITS).bitwiseAND(F.lit((1 << BITS) - 1))]
    bits = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*at)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")
    )
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for word, value in words.collect():
        out[word] = value & (1 << 64) - 1
    return out


def flags(packed: np.ndarray) -> np.ndarray:
    """The sketch as a bool for each bit."""
    return np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)


def maybe(flag: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be among the keys."""
    low = np.uint64((1 << BITS) - 1)
    out = flag[(h & low).view(np.int64)]
    some = np.flatnonzero(out)
    out[some] = flag[((h[some] >> np.uint64(BITS)) & low).view(np.int64)]
    return out
