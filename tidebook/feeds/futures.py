"""Futures trades and best bid/ask, already typed; only units and names change.

Membership and channel id come from one equi-join with the registry on (exchange, ticker), which equals a
lookup by the hashed id while ids do not collide (the registry refuses collisions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.identity import trimmed
from tidebook.functions.timeparts import seconds_to_us

MARKET = "futures"


def _with_channel(df: DataFrame, channels: DataFrame, how: str) -> DataFrame:
    members = channels.where(F.col("market_type") == MARKET).select(
        F.col("exchange").alias("_exchange"), F.col("symbol").alias("_ticker"), "channel_id"
    )
    keyed = df.withColumn("_x", trimmed(F.col("exchange"))).withColumn("_t", trimmed(F.col("ticker")))
    match = (F.col("_x") == F.col("_exchange")) & (F.col("_t") == F.col("_ticker"))
    return keyed.join(members, match, how)


def _order(df: DataFrame):
    """The feed's own ``seq``, or the receive time where it has none."""
    return F.col("seq" if "seq" in df.columns else "recv_us").alias("seq")


def unmapped(df: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows whose contract is not registered."""
    return _with_channel(df, channels, "left_anti").drop("_x", "_t")


def normalise_trades(df: DataFrame, channels: DataFrame) -> DataFrame:
    """Trade prints (and trade conditions, which have the same form)."""
    return _with_channel(df, channels, "inner").select(
        "channel_id",
        F.col("_x").alias("exchange"),
        F.lit(MARKET).alias("market_type"),
        F.col("_t").alias("symbol"),
        _order(df),
        "recv_us",
        F.lit(0).cast("bigint").alias("local_diff"),
        seconds_to_us(F.col("ssboe"), F.col("usecs")).alias("exchange_timestamp"),
        F.lit(0).cast("bigint").alias("trade_id"),
        "price",
        F.col("size").cast("double").alias("quantity"),
        F.coalesce(trimmed(F.col("aggressor_side")) == "S", F.lit(False)).alias("is_buyer_maker"),
    )


def normalise_bbo(df: DataFrame, channels: DataFrame) -> DataFrame:
    """Best bid and ask; a value whose flag is off is 0.0, and the time is the bid's."""

    def flagged(name: str, flag: str, alias: str):
        return F.when(F.col(flag), F.col(name).cast("double")).otherwise(F.lit(0.0)).alias(alias)

    return _with_channel(df, channels, "inner").select(
        "channel_id",
        F.col("_x").alias("exchange"),
        F.lit(MARKET).alias("market_type"),
        F.col("_t").alias("symbol"),
        _order(df),
        "recv_us",
        F.lit(0).cast("bigint").alias("local_diff"),
        seconds_to_us(F.col("ssboe"), F.col("usecs")).alias("exchange_timestamp"),
        flagged("bid_price", "bid_price_flag", "best_bid_price"),
        flagged("bid_size", "bid_size_flag", "best_bid_qty"),
        flagged("ask_price", "ask_price_flag", "best_ask_price"),
        flagged("ask_size", "ask_size_flag", "best_ask_qty"),
    )
