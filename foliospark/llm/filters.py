"""Filters of bounded size over the keys of a join, which keep most rows without a partner out of the shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each value of a filter, and the most a filter has; beyond that it lets more values pass, never fewer.
FILTER_BITS, FILTER_MOST = 16, 1 << 27


class Filter:
    """A bitmap over the low bits of some 64-bit values: what is not in it is none of them."""

    def __init__(self, words: np.ndarray):
        self.words, self.low = words, np.uint64(64 * len(words) - 1)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values & self.low
        return self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def filter_of(values: DataFrame, column: str) -> Filter:
    """The filter of a column of bigints, FILTER_BITS bits for each of them and FILTER_MOST at most, put together by the executors."""
    n = values.count()
    size = min(FILTER_MOST, max(1 << 10, 1 << (n * FILTER_BITS).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(size - 1).cast("bigint"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    rows = values.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_MOST / 64 rows at most
    words = np.zeros(size // 64, dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return Filter(words.view(np.uint64))
