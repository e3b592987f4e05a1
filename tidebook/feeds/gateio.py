"""Gate.io spot and perpetual messages.

The ``time``/``time_ms`` envelope needs no handling, as paths do not depend on the order of fields.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.feeds.base import DEPTH, TICK, TICKER, UNKNOWN, Feed, Fields, by_name, depth, tick, ticker
from tidebook.functions.jsonfields import list_at, text_at, unsigned_at, value_at
from tidebook.functions.levels import keyed_levels, positional_levels
from tidebook.functions.numbers import decimal_prefix, price_at, quantity_at
from tidebook.functions.timeparts import ms_to_us

# Suffixes of the "channel" field and the record kind each stands for.
CHANNEL_KINDS = {"trades": TICK, "order_book": DEPTH, "book_ticker": TICKER}


def _classify(prefix: str) -> Callable[[Column], Column]:
    def classify(doc: Column) -> Column:
        channel = text_at(doc, "$.channel")
        kind = by_name(F.substr(channel, F.lit(len(prefix) + 2)), CHANNEL_KINDS)
        return F.when(channel.startswith(prefix), kind).otherwise(UNKNOWN)

    return classify


def _carries_trades(doc: Column) -> Column:
    return text_at(doc, "$.event") != "subscribe"


def _carries_book(doc: Column) -> Column:
    return text_at(doc, "$.event").isin("update", "all")


def spot_tick(doc: Column, item: Column) -> Fields:
    # the milliseconds come as decimal text and keep their fraction
    ts = (decimal_prefix(text_at(doc, "$.result.create_time_ms")) * 1000.0).try_cast("bigint")
    return tick(
        F.when(_carries_trades(doc), ts),
        unsigned_at(doc, "$.result.id"),
        price_at(doc, "$.result.price"),
        F.abs(price_at(doc, "$.result.amount")),
        text_at(doc, "$.result.side") == "sell",
    )


def perpetual_tick(doc: Column, item: Column) -> Fields:
    size = quantity_at(item, "$.size")
    ts = ms_to_us(unsigned_at(item, "$.create_time_ms"))
    return tick(
        F.when(_carries_trades(doc), ts),
        unsigned_at(item, "$.id"),
        price_at(item, "$.price"),
        F.abs(size),
        size < 0,
    )


def spot_depth(doc: Column, recv_us: Column) -> Fields:
    ts = F.when(_carries_book(doc), ms_to_us(unsigned_at(doc, "$.result.t")))
    update_id = unsigned_at(doc, "$.result.lastUpdateId")
    return depth(ts, update_id, value_at(doc, "$.result.bids"), value_at(doc, "$.result.asks"))


def perpetual_depth(doc: Column, recv_us: Column) -> Fields:
    ts = F.when(_carries_book(doc), ms_to_us(unsigned_at(doc, "$.result.t")))
    update_id = unsigned_at(doc, "$.result.id")
    return depth(ts, update_id, value_at(doc, "$.result.bids"), value_at(doc, "$.result.asks"))


def book_ticker(doc: Column, recv_us: Column) -> Fields:
    ts = F.when(text_at(doc, "$.event") == "update", ms_to_us(unsigned_at(doc, "$.result.t")))
    return ticker(
        ts,
        price_at(doc, "$.result.b"),
        quantity_at(doc, "$.result.B"),
        price_at(doc, "$.result.a"),
        quantity_at(doc, "$.result.A"),
    )


SPOT = Feed(
    "gateio",
    "spot",
    _classify("spot"),
    spot_tick,
    spot_depth,
    book_ticker,
    positional_levels,
    side_paths=("result.bids", "result.asks"),
)
PERPETUAL = Feed(
    "gateio",
    "perpetual",
    _classify("futures"),
    perpetual_tick,
    perpetual_depth,
    book_ticker,
    keyed_levels,
    trades=lambda doc: list_at(doc, "$.result"),
)
# For those who want only the first trade of a message, as some collectors keep it.
PERPETUAL_FIRST_TRADE = replace(PERPETUAL, trades=lambda doc: F.slice(list_at(doc, "$.result"), 1, 1))
