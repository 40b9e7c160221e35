"""Blocked Bloom filters as tables: a block of eight lanes of 32 bits a row, one bit a lane for each key. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
BITS_PER_KEY = 16
#: Rows of a block table (72 bytes each) that may be broadcast.
BROADCAST_BLOCKS = 500_000


def blocks_for(keys: int) -> int:
    """Blocks that give each key its bits."""
    return max(1, -(-keys * BITS_PER_KEY // (32 * LANES)))


def block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def bit(key: Column, lane: int) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.pmod(F.hash(key, F.lit(lane)), F.lit(32)))


def table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, lane0..lane7) of column key; bits are or-ed map-side first."""
    lanes = [F.bit_or(bit(F.col(key), k)).alias(f"lane{k}") for k in range(LANES)]
    return keys.groupBy(block(F.col(key), blocks).alias("block")).agg(*lanes)


def passed(key: Column) -> Column:
    """Whether all bits of key are set in the lanes beside it; false where there is no block."""
    ok = F.lit(True)
    for k in range(LANES):
        ok = ok & (F.col(f"lane{k}").bitwiseAND(bit(key, k)) != 0)
    return F.coalesce(ok, F.lit(False))
