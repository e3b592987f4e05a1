"""Feeds by (exchange, market type)."""

from tidebook.feeds import binance, gateio
from tidebook.feeds.base import Feed

FEEDS: tuple[Feed, ...] = (binance.SPOT, binance.PERPETUAL, gateio.SPOT, gateio.PERPETUAL)
