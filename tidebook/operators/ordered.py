"""Order-dependent columns over keys of any size.

A plain window over a key sends all its rows to one task, and a single key may hold a third of the data.
Here a key with more than ``rows`` rows is cut into blocks of its order column, at quantiles of that key's own orders
(approximate ones, off by a ten-thousandth of the key's rows), so blocks are alike in size however the orders lie.
Windows run inside blocks; what must cross a block border is carried by a second window over one summary row per block.
Keys are counted first, by a job of its own; if none is that large, plain windows over keys are all there is.
A key has at most ``MOST`` blocks; beyond ``MOST * rows`` rows its blocks grow, which a sort can spill.

Orders are unique within a key, or an order is several columns: the first, a number, is what blocks are cut by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 16
MOST = 1000
ACCURACY = 10_000
#: Cuts that are searched one after the other, in each of two steps.
_STEP = 32


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _large(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more than ``rows`` rows, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)


def _block(order: str) -> Column:
    """How many cuts are below the order."""
    below = lambda c: c < F.col(order)
    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_cuts") - 1, F.lit(0)), F.lit(_STEP)), lambda i: F.get("_cuts", i))
    step = F.size(F.filter(heads, below))
    rest = F.slice("_cuts", (step - 1) * _STEP + 2, F.lit(_STEP - 1))
    within = (step - 1) * _STEP + 1 + F.size(F.filter(rest, below))
    return F.when(F.col("_cuts").isNull() | (step == 0), 0).otherwise(within)


def _blocked(df: DataFrame, key: str | Sequence[str], order: str, rows: int) -> DataFrame:
    keys = _names(key)
    large = _large(df, keys, rows)
    shares = [k / MOST for k in range(1, MOST)]
    found = df.select(*keys, order).join(large, keys).groupBy(*keys).agg(
        F.percentile_approx(order, shares, ACCURACY).alias("_all"), F.first("_n").alias("_n")
    )
    n = F.least(F.ceil(F.col("_n") / rows), F.lit(MOST)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.col("_blocks") - 1), lambda k: F.get("_all", F.floor(k * MOST / F.col("_blocks")).cast("int") - 1))
    found = found.withColumn("_blocks", n).select(*keys, F.array_distinct(cuts).alias("_cuts"))
    return df.join(found, keys, "left").withColumn("_block", _block(order)).drop("_cuts")


def neighbours(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """For each name of ``before`` the last value that isn't NULL in the rows strictly before, in the order of a key;
    for each name of ``after`` the first one strictly after."""
    keys, orders = _names(key), _names(order)
    marks = {**(before or {}), **(after or {})}
    marked = df.withColumns({f"_mark_{n}": c for n, c in marks.items()})
    plain = _large(df, keys, rows).isEmpty()
    blocks = marked if plain else _blocked(marked, keys, orders[0], rows)
    within = keys if plain else [*keys, "_block"]
    whole = F.struct(*orders)
    sides = [(n, F.max_by, [F.col(o).asc() for o in orders], F.col("_block").asc()) for n in before or {}]
    sides += [(n, F.min_by, [F.col(o).desc() for o in orders], F.col("_block").desc()) for n in after or {}]
    ends, carried, inside = [], [], {}
    for name, end, by, across in sides:
        mark = F.col(f"_mark_{name}")
        ends.append(end(mark, F.when(mark.isNotNull(), whole)).alias(f"_end_{name}"))
        upto = Window.partitionBy(*keys).orderBy(across).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last(f"_end_{name}", True).over(upto).alias(f"_carry_{name}"))
        own = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        inside[f"_own_{name}"] = F.last(mark, True).over(own)
    if plain:
        return blocks.withColumns(inside).withColumnsRenamed({f"_own_{n}": n for n in marks}).drop(*[f"_mark_{n}" for n in marks])
    carry = blocks.groupBy(*keys, "_block").agg(*ends).select(*keys, "_block", *carried)
    carry = carry.where(reduce(Column.__or__, [F.col(f"_carry_{n}").isNotNull() for n in marks]))  # none for keys of one block
    joined = blocks.withColumns(inside).join(carry, [*keys, "_block"], "left")
    joined = joined.withColumns({n: F.coalesce(f"_own_{n}", f"_carry_{n}") for n in marks})
    return joined.drop("_block", *[f"_{part}_{n}" for n in marks for part in ("mark", "own", "carry")])


def previous_in_order(
    df: DataFrame, key: str, order: str, value: str, name: str, rows: int = ROWS
) -> DataFrame:
    """``lag(value)`` per key; NULL at the first row."""
    found = neighbours(df, key, order, before={name: F.struct(F.col(value).alias("v"))}, rows=rows)
    return found.withColumn(name, F.col(f"{name}.v"))


def running_total(
    df: DataFrame, key: str, order: str, amount: Column, name: str, rows: int = ROWS
) -> DataFrame:
    """Sum of ``amount`` over this and all earlier rows of the key."""
    if _large(df, [key], rows).isEmpty():
        whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_amount", amount).withColumn(name, F.sum("_amount").over(whole)).drop("_amount")
    blocks = _blocked(df.withColumn("_amount", amount), key, order, rows)
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocks.groupBy(key, "_block")
        .agg(F.sum("_amount").alias("_sum"))
        .select(key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    )
    return (
        blocks.withColumn("_inside", F.sum("_amount").over(inside))
        .join(carry, [key, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_carry"))
        .drop("_block", "_amount", "_inside", "_carry")
    )
