"""A bit filter of 64-bit hashes that goes to every task: of a bounded size, whatever the number of hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import U64

#: Most bits of a filter: 16 MB.  Beyond ``FILTER_BITS`` / ``ROOM`` hashes it only lets more wrong ones through.
FILTER_BITS = 1 << 27
ROOM = 16


class Sieve:
    """Two bits for each hash; no hash put in is ever missed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, U64(64 - (8 * len(bits) - 1).bit_length())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in (hashes >> self.shift, (hashes << U64(32)) >> self.shift):
            found &= (self.bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
        return found


def sieve_of(hashes: DataFrame, most: int = FILTER_BITS) -> Sieve:
    """Filter with the column ``hash`` of a stored table: ``ROOM`` bits for each row, at most ``most`` bits.

    Bits are gathered by words of 64 with partial aggregation, so at most ``most`` / 64 rows reach the driver.
    """
    size = 64
    while size < min(most, ROOM * hashes.count()):
        size *= 2
    width = (size - 1).bit_length()
    first, second = F.shiftrightunsigned("hash", 64 - width), F.shiftrightunsigned(F.shiftleft("hash", 32), 64 - width)
    rows = hashes.select(F.explode(F.array(first, second)).alias("place"))
    rows = rows.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return Sieve(bits.view(np.uint8))


@contextmanager
def sent(spark: SparkSession, value) -> Iterator:
    """``value`` as a broadcast variable that is gone afterwards; what uses it must be stored by then."""
    variable = spark.sparkContext.broadcast(value)
    try:
        yield variable
    finally:
        variable.destroy()
