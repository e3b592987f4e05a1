"""What a feed is: column expressions over a parsed document.

A new exchange is added by building a :class:`Feed` and passing it to ``parse_messages``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK, DEPTH, TICKER, UNKNOWN = "TICK", "DEPTH", "BOOK_TICKER", "UNKNOWN"

# Fields of each record kind as a feed delivers them. Depth sides are still variants here.
FIELDS: dict[str, dict[str, str]] = {
    TICK: {
        "exchange_timestamp": "bigint",
        "trade_id": "bigint",
        "price": "double",
        "quantity": "double",
        "is_buyer_maker": "boolean",
    },
    DEPTH: {"exchange_timestamp": "bigint", "last_update_id": "bigint", "bids": "variant", "asks": "variant"},
    TICKER: {
        "exchange_timestamp": "bigint",
        "best_bid_price": "double",
        "best_bid_qty": "double",
        "best_ask_price": "double",
        "best_ask_qty": "double",
    },
}
Fields = dict[str, Column]


def _whole_message(doc: Column) -> Column | None:
    return None


@dataclass(frozen=True)
class Feed:
    """Column makers of one (exchange, market type).

    ``classify(doc)`` names the kind. ``tick(doc, item)``, ``depth(doc, recv_us)`` and ``ticker(doc, recv_us)``
    give the fields of ``FIELDS``; a field that does not read is NULL, and then the message is a failed parse.
    ``trades(doc)`` gives the array of trade documents where a message may carry several; ``item`` is then one
    of them. ``recv_us`` is the captured receive time; it stands in where the exchange sends none, so reruns
    agree. ``levels`` turns a depth side from a variant into levels; ``side_paths`` are the paths of bids and asks where they are
    positional lists, which are read straight from the text; in ``doc``, short lists that start with a text stand for them.
    """

    exchange: str
    market_type: str
    classify: Callable[[Column], Column]
    tick: Callable[[Column, Column], Fields]
    depth: Callable[[Column, Column], Fields]
    ticker: Callable[[Column, Column], Fields]
    levels: Callable[[Column], Column]
    trades: Callable[[Column], Column | None] = _whole_message
    side_paths: tuple[str, str] | None = None

    def owns(self, exchange: Column, market_type: Column) -> Column:
        return (exchange == self.exchange) & (market_type == self.market_type)


def tick(ts: Column, trade_id: Column, price: Column, quantity: Column, maker: Column) -> Fields:
    return dict(zip(FIELDS[TICK], (ts, trade_id, price, quantity, maker)))


def depth(ts: Column, update_id: Column, bids: Column, asks: Column) -> Fields:
    return dict(zip(FIELDS[DEPTH], (ts, update_id, bids, asks)))


def ticker(ts: Column, bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Fields:
    return dict(zip(FIELDS[TICKER], (ts, bid, bid_qty, ask, ask_qty)))


def by_name(name: Column, kinds: dict[str, str]) -> Column:
    """The kind a name stands for, by one lookup in a constant map."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(UNKNOWN))
