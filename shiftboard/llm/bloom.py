"""A filter of fixed size that says which 64-bit keys cannot be in a set.

Bits are set by a Spark aggregation.  The driver holds at most ``MOST_BITS`` bits (4 MB),
whatever the size of the set; a fuller filter lets more keys pass and never loses one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MOST_BITS = 1 << 25
LEAST_BITS = 1 << 16
BITS_PER_KEY = 16


def size_for(keys: int) -> int:
    bits = LEAST_BITS
    while bits < keys * BITS_PER_KEY and bits < MOST_BITS:
        bits *= 2
    return bits


class Filter:
    """Two bits per key, both taken from the key itself, so keys must be hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        mask = np.uint64(len(self.words) * 32 - 1)
        found = np.ones(len(keys), bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & mask
            found &= (self.words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
        return found


def build(d: DataFrame, key: Column, keys: int) -> Filter:
    """``key``: a hashed bigint column; ``keys``: about how many values it has."""
    bits = size_for(keys)

    def at(shift: int) -> Column:
        return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(bits - 1))

    marks = d.filter(key.isNotNull()).select(F.explode(F.array(at(0), at(32))).alias("at"))
    words = marks.groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS INT))")).alias("set")
    )
    got = words.toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["set"].to_numpy(np.int64).astype(np.uint32)
    return Filter(out)
