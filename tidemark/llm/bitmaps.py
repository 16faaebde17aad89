"""Bitmaps of bounded size over 64-bit keys, for map tasks in numpy to tell early what a join would drop.

A bitmap has at most 2**26 bits (8 MB) whatever the data, so it can go to every task; the fuller it is, the
less it spares. What passes by chance must be dropped by the exact step that follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 26


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Words of a bitmap of the keys' low bits; `keys` is a stored table, as it is counted first."""
    bits = 1 << max(16, min(MOST_BITS, (32 * keys.count()).bit_length()))
    at = keys.select(F.col(key).bitwiseAND(F.lit(bits - 1)).alias("h"))
    got = at.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return out


def probe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each key may be in the bitmap."""
    at = h & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
