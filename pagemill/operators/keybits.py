"""A filter of keys as a table of bitmaps, for scans whose rows are too wide to be moved before a join.

A key sets one of 32,768 bits in one of ``bitmaps`` bitmaps. The table has at most that many rows of 4 KiB, whatever
the number of keys, so it can always be broadcast; with many keys more rows pass that the join then drops, and none
is ever lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAPS = 1024
BITS = 32_768


def _place(key: str, bitmaps: int) -> tuple[Column, Column]:
    code = F.xxhash64(F.col(key))
    return F.pmod(code, F.lit(bitmaps)).cast("int"), F.pmod(F.shiftright(code, 20), F.lit(BITS))


def key_bits(keys: DataFrame, key: str, bitmaps: int = BITMAPS) -> DataFrame:
    """The filter of a key column: ``(bitmap, bits)``. Null keys are no keys."""
    bitmap, bit = _place(key, bitmaps)
    places = keys.where(F.col(key).isNotNull()).select(bitmap.alias("bitmap"), bit.alias("bit"))
    return places.groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(df: DataFrame, key: str, bits: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """The rows whose key may be one of the filter's, without an exchange of the rows."""
    bitmap, bit = _place(key, bitmaps)
    known = F.broadcast(bits.select(F.col("bitmap").alias("__bitmap"), F.col("bits").alias("__bits")))
    placed = df.where(F.col(key).isNotNull()).withColumns({"__at": bitmap, "__bit": bit.cast("int")})
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(__byte, __bit & 7) & 1") == 1
    met = placed.join(known, F.col("__at") == F.col("__bitmap")).withColumn("__byte", byte)
    return met.where(is_set).drop("__at", "__bit", "__bitmap", "__bits", "__byte")
