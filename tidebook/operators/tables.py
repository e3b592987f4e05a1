"""Enriched records to rows of the three output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import identity, levels, timeparts
from tidebook.operators.parse import INVALID_TIME


def split_by_time(records: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """Records with a storable exchange time, and the others with a reason."""
    valid = timeparts.is_valid_us(F.col("exchange_timestamp"), as_of_year)
    return records.where(valid), records.where(~valid).withColumn("reject_reason", F.lit(INVALID_TIME))


def _trade_date():
    return timeparts.trade_date(F.col("exchange_timestamp")).alias("trade_date")


def to_trades(records: DataFrame) -> DataFrame:
    return records.select(
        "exchange_timestamp",
        "local_diff",
        "trade_id",
        "price",
        "quantity",
        identity.direction(F.col("is_buyer_maker")).cast("int").alias("direction"),
        "is_buyer_maker",
        "symbol",
        "exchange",
        "market_type",
        _trade_date(),
    )


def to_orderbook(records: DataFrame, keep_update_id: bool = False) -> DataFrame:
    """Each side cut and zero-padded to the channel's stored depth."""
    arrays = levels.depth_arrays(
        F.col("bids"), F.col("asks"), levels.effective_depth(F.col("depth_level"), F.col("bids"), F.col("asks"))
    )
    extra = ["last_update_id"] if keep_update_id else []
    return records.select(
        "exchange_timestamp",
        "local_diff",
        "symbol",
        "exchange",
        "market_type",
        _trade_date(),
        *[column.alias(name) for name, column in arrays.items()],
        *extra,
    )


def to_bookticker(records: DataFrame) -> DataFrame:
    return records.select(
        "exchange_timestamp",
        "local_diff",
        "best_bid_price",
        "best_bid_qty",
        "best_ask_price",
        "best_ask_qty",
        "symbol",
        "exchange",
        "market_type",
        _trade_date(),
    )


def to_wide(orderbook: DataFrame, depth: int) -> DataFrame:
    """Array columns to four columns per level, in file order."""
    keys = [c for c in orderbook.columns if not c.endswith(("_prices", "_sizes"))]
    return orderbook.select(*keys, *levels.wide_columns(depth))


def from_wide(wide: DataFrame) -> DataFrame:
    arrays = levels.arrays_from_wide(wide.columns)
    keys = [c for c in wide.columns if not c.startswith(("ask_", "bid_"))]
    return wide.select(*keys, *[column.alias(name) for name, column in arrays.items()])


def to_long(orderbook: DataFrame) -> DataFrame:
    """One row per level: ``level`` counts from 1."""
    keys = [c for c in orderbook.columns if not c.endswith(("_prices", "_sizes"))]
    zipped = F.arrays_zip("bid_prices", "bid_sizes", "ask_prices", "ask_sizes")
    return orderbook.select(*keys, F.posexplode(zipped).alias("pos", "l")).select(
        *keys,
        (F.col("pos") + 1).alias("level"),
        F.col("l.bid_prices").alias("bid_price"),
        F.col("l.bid_sizes").alias("bid_size"),
        F.col("l.ask_prices").alias("ask_price"),
        F.col("l.ask_sizes").alias("ask_size"),
    )
