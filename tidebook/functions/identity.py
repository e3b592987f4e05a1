"""Channel identity, topics and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.schemas import MARKET_TYPES

# Fixed values of 64-bit FNV-1a: offset basis 14695981039346656037 and prime 2^40 + 435.
FNV_BASIS_HIGH = 3421674724
FNV_BASIS_LOW = 2216829733
FNV_PRIME_LOW = 435
LOW_32 = 0xFFFFFFFF


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def channel_key(exchange: Column, market_type: Column, symbol: Column) -> Column:
    return F.concat_ws(":", exchange, market_type, symbol)


def channel_id(exchange: Column, market_type: Column, symbol: Column) -> Column:
    """FNV-1a of the channel key, folded to 32 bits, for ASCII keys.

    The 64-bit state is kept as two 32-bit halves, since a BIGINT product would overflow. Meant for the
    registry (one row per channel); messages then join on the result.
    """
    letters = F.split(channel_key(exchange, market_type, symbol), "")
    codes = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))

    def step(state: Column, code: Column) -> Column:
        low = state.low.bitwiseXOR(code)
        product = low * _big(FNV_PRIME_LOW)
        high = state.high * _big(FNV_PRIME_LOW) + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(
            high.bitwiseAND(_big(LOW_32)).alias("high"), product.bitwiseAND(_big(LOW_32)).alias("low")
        )

    start = F.struct(_big(FNV_BASIS_HIGH).alias("high"), _big(FNV_BASIS_LOW).alias("low"))
    return F.aggregate(codes, start, step, lambda s: s.high.bitwiseXOR(s.low))


def is_market_type(name: Column) -> Column:
    return F.coalesce(name.isin(*MARKET_TYPES), F.lit(False))


def trimmed(text: Column) -> Column:
    return F.rtrim(F.coalesce(text, F.lit("")))


def topic(prefix: Column, suffix: str) -> Column:
    return F.concat_ws(":", prefix, F.lit(suffix))


def bucket(symbol: Column, buckets: int = 20) -> Column:
    return F.pmod(F.hash(symbol), F.lit(buckets))


def direction(is_buyer_maker: Column) -> Column:
    return F.when(is_buyer_maker, -1).otherwise(1)
