"""A blocked Bloom filter in column expressions.

Each key sets four bits of one 64-bit block. There are at most ``MAX_BLOCKS`` blocks (1 MB), which
are all that reaches the driver or goes into a plan; more keys mean more false positives, nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    spread = F.xxhash64(F.lit("block bits"), key)
    out = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def build(keys: DataFrame, name: str) -> list[int]:
    """The filter's blocks, as signed longs, for the column ``name`` of ``keys``."""
    blocks = 1
    wanted = keys.count() * BITS_PER_KEY / 64
    while blocks < min(wanted, MAX_BLOCKS):
        blocks *= 2
    words = [0] * blocks
    for row in keys.groupBy(_block(F.col(name), blocks).alias("block")).agg(F.bit_or(_mask(F.col(name))).alias("bits")).collect():
        words[row["block"]] = row["bits"]
    return words


def test(words: list[int]) -> Callable[[Column], Column]:
    """Whether the filter may hold a key."""
    filled = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    return lambda key: F.element_at(filled, _block(key, len(words)) + 1).bitwiseAND(_mask(key)) == _mask(key)
