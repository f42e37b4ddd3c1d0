"""Sets of hashes as bit sets of bounded size: what a scan needs to know before anything is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A set has eight bits for every hash, at least 2^16 and at most 2^29 (64 MB).
BITS = (16, 29)


class BitSet:
    """Hashes by their first `bits` bits: a hash that was put in is always there, others seldom are."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __contains__(self, h: int) -> bool:
        place = (h % 2**64) >> (64 - self.bits)
        return bool(int(self.words[place >> 6]) >> (place & 63) & 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Of each unsigned hash whether it may be in the set."""
        place = h >> np.uint64(64 - self.bits)
        return ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def bit_set(hashes: DataFrame, column: str, bits: tuple[int, int] = BITS) -> BitSet:
    """The set of a BIGINT column of hashes. Counts them first; at most 2^(bits-6) rows of two numbers come to the driver."""
    n = hashes.count()
    size = int(min(max(bits[0], np.ceil(np.log2(8 * max(n, 1)))), bits[1]))
    place = F.shiftrightunsigned(column, 64 - size)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - size}) & 63 as int))")
    got = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(1 << (size - 6), np.int64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return BitSet(size, words.view(np.uint64))
