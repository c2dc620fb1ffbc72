"""A Bloom filter of fixed size, built by SQL aggregation and probed in numpy.

It only ever spares work: whatever passes is decided exactly afterwards, so a corpus that
overfills it costs time but no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**BITS bits (4 MB), the size of the broadcast and of what reaches the driver, for any corpus.
BITS = 25
_PROBES = (1, 2)
_U = np.uint64


def _place(key: Column, probe: int) -> Column:
    return F.shiftrightunsigned(key.bitwiseXOR(F.shiftleft(key, 7 * probe)), 64 - BITS)


def bloom_of(keys: DataFrame, col: str):
    """Broadcast bit words of the 64-bit hashes in `col`, which should already be well mixed."""
    place = keys.select(F.explode(F.array(*[_place(F.col(col), p) for p in _PROBES])).alias("p"))
    words = place.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    rows = words.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(_U))


def maybe(bits: np.ndarray, keys) -> np.ndarray:
    """Whether each key may be in the filter."""
    k = np.asarray(keys, np.int64).view(_U)
    out = np.ones(len(k), bool)
    for p in _PROBES:
        at = (k ^ (k << _U(7 * p))) >> _U(64 - BITS)
        out &= (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
    return out
