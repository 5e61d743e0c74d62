"""A blocked Bloom filter: built by DataFrame aggregates, tested in tasks.

A key's 64-bit hash names a block of 512 bits and one bit in each of its eight
64-bit lanes.  The filter has a fixed largest size, so it may be sent to every
task whatever the number of keys; more keys only mean more false positives,
which the exact join behind it removes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 8
MAX_BLOCKS = 1 << 17  # 8 MB
BITS_PER_KEY = 16
#: odd 31-bit multipliers, one a lane
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x2DF1424B, 0x705495C7, 0x2DF1424F, 0x1EFC4947, 0x5C6BFB31)

_LOW = (1 << 32) - 1


def n_blocks(n_keys: int) -> int:
    want = max(n_keys * BITS_PER_KEY // (64 * LANES), 1)
    return min(1 << (want - 1).bit_length(), MAX_BLOCKS)


def build(keys: DataFrame, hash_col: str) -> np.ndarray:
    """The filter of a long column as an array (blocks, lanes).

    Tasks fold their keys block by block before the shuffle; the driver gets
    one row a block, at most :data:`MAX_BLOCKS`.
    """
    n = n_blocks(keys.count())
    h = F.col(hash_col)
    low = h.bitwiseAND(F.lit(_LOW))
    block = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(n - 1))
    lanes = [F.expr(f"bit_or(shiftleft(1L, cast(shiftright(low * {s}L, 25) & 63 as int)))").alias(f"l{i}") for i, s in enumerate(SALTS)]
    rows = keys.select(block.alias("b"), low.alias("low")).groupBy("b").agg(*lanes).toArrow()
    out = np.zeros((n, LANES), np.int64)
    b = rows.column("b").to_numpy()
    for i in range(LANES):
        out[b, i] = rows.column(f"l{i}").to_numpy()
    return out.view(np.uint64)


def test(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    h = h.view(np.uint64) if h.dtype == np.int64 else h
    block = ((h >> np.uint64(32)) & np.uint64(len(bits) - 1)).astype(np.int64)
    low = h & np.uint64(_LOW)
    at = np.arange(len(h))
    hit = np.ones(len(h), bool)
    for i, s in enumerate(SALTS):
        bit = (low[at] * np.uint64(s) >> np.uint64(25)) & np.uint64(63)
        ok = (bits[block[at], i] >> bit) & np.uint64(1) != 0
        hit[at[~ok]] = False
        at = at[ok]
        if not len(at):
            break
    return hit


def marked(rows: DataFrame, keys: DataFrame, col: str, mark: str) -> DataFrame:
    """Adds ``mark``: whether ``col`` may be among ``keys`` (a column of that name); certain where false."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(build(keys.select(F.xxhash64(col).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(test(bits.value, h.to_numpy()))

    return rows.withColumn(mark, may(F.xxhash64(col)))


#: so many counted long keys (8 MB) are broadcast
SMALL_KEYS = 500_000


def semi_join(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``rows`` whose ``col`` is among the stored, distinct long ``keys``.

    Up to :data:`SMALL_KEYS` counted keys are broadcast; beyond, only rows that
    may be among them are shuffled.
    """
    if keys.count() <= SMALL_KEYS:
        return rows.join(F.broadcast(keys.select(col)), col, "left_semi")
    return marked(rows, keys, col, "_may").filter("_may").drop("_may").join(keys.select(col), col, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``rows`` whose ``col`` is not among the stored, distinct long ``keys`` (see :func:`semi_join`)."""
    if keys.count() <= SMALL_KEYS:
        return rows.join(F.broadcast(keys.select(col)), col, "left_anti")
    both = marked(rows, keys, col, "_may")
    rest = both.filter("_may").drop("_may").join(keys.select(col), col, "left_anti").select(*rows.columns)
    return both.filter("not _may").select(*rows.columns).unionByName(rest)
