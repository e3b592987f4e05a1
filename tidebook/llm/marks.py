"""Which rows surely have none of many keys: told by a table of bits that is broadcast, of a bounded size.

The table has at most ``SLOTS`` rows of 64 bits, whatever the number of keys; with more keys than that it tells less, and
what it does not tell is left to a join. So rows with long texts need not be shuffled to find out that they are not meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 17


def _places(key: str) -> tuple[Column, Column]:
    spread = F.xxhash64(F.lit("marks"), key)
    return F.pmod(spread, F.lit(SLOTS)), F.pmod(F.shiftright(spread, 32), F.lit(64)).cast("int")


def marks_of(keys: DataFrame, key: str) -> DataFrame:
    slot, bit = _places(key)
    return keys.groupBy(slot.alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))


def with_marks(rows: DataFrame, key: str, marks: DataFrame, name: str) -> DataFrame:
    """``rows`` and whether their key may be one of the marked ones; a null key is none."""
    slot, bit = _places(key)
    placed = rows.withColumn("_slot", slot).join(F.broadcast(marks), "_slot", "left")
    held = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return placed.withColumn(name, F.coalesce(held, F.lit(False)) & F.col(key).isNotNull()).drop("_slot", "_bits")
