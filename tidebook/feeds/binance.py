"""Binance spot and perpetual messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.feeds.base import DEPTH, TICK, TICKER, Feed, Fields, by_name, depth, tick, ticker
from tidebook.functions.jsonfields import flag_at, integer_at, kind_at, text_at, unsigned_at, value_at
from tidebook.functions.levels import positional_levels
from tidebook.functions.numbers import price_at
from tidebook.functions.timeparts import ms_to_us

# Event names of the "e" field and the record kind each stands for.
EVENT_KINDS = {"trade": TICK, "aggTrade": TICK, "depthUpdate": DEPTH, "bookTicker": TICKER}


def classify(doc: Column) -> Column:
    """Spot depth and ticker messages carry no ``e``; ``lastUpdateId`` tells them apart."""
    unnamed = F.when(value_at(doc, "$.lastUpdateId").isNotNull(), DEPTH).otherwise(TICKER)
    return F.when(kind_at(doc, "$.e").isNull(), unnamed).otherwise(by_name(text_at(doc, "$.e"), EVENT_KINDS))


def _tick(doc: Column, ts: Column) -> Fields:
    # aggTrade numbers its trades in "a"; a plain trade message numbers them in "t"
    is_plain = F.try_variant_get(doc, "$.e", "string") == "trade"
    trade_id = F.when(is_plain, integer_at(doc, "$.t")).otherwise(integer_at(doc, "$.a"))
    return tick(ts, trade_id, price_at(doc, "$.p"), price_at(doc, "$.q"), flag_at(doc, "$.m"))


def spot_tick(doc: Column, item: Column) -> Fields:
    return _tick(doc, integer_at(doc, "$.E"))


def perpetual_tick(doc: Column, item: Column) -> Fields:
    return _tick(doc, ms_to_us(integer_at(doc, "$.E")))


def spot_depth(doc: Column, recv_us: Column) -> Fields:
    return depth(
        recv_us, unsigned_at(doc, "$.lastUpdateId"), value_at(doc, "$.bids"), value_at(doc, "$.asks")
    )


def perpetual_depth(doc: Column, recv_us: Column) -> Fields:
    ts = ms_to_us(integer_at(doc, "$.E"))
    return depth(ts, integer_at(doc, "$.u"), value_at(doc, "$.b"), value_at(doc, "$.a"))


def _ticker(doc: Column, ts: Column) -> Fields:
    return ticker(ts, price_at(doc, "$.b"), price_at(doc, "$.B"), price_at(doc, "$.a"), price_at(doc, "$.A"))


def spot_ticker(doc: Column, recv_us: Column) -> Fields:
    return _ticker(doc, recv_us)


def perpetual_ticker(doc: Column, recv_us: Column) -> Fields:
    return _ticker(doc, ms_to_us(integer_at(doc, "$.E")))


SPOT = Feed(
    "binance", "spot", classify, spot_tick, spot_depth, spot_ticker, positional_levels, side_paths=("bids", "asks")
)
PERPETUAL = Feed(
    "binance", "perpetual", classify, perpetual_tick, perpetual_depth, perpetual_ticker, positional_levels,
    side_paths=("b", "a"),
)
