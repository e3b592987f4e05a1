"""The whole path from raw messages to tables, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.feeds import FEEDS, Feed, futures
from tidebook.feeds.base import DEPTH, FIELDS, TICK, TICKER
from tidebook.functions import timeparts
from tidebook.operators import enrich, parse, tables


@dataclass(frozen=True)
class Records:
    """Enriched, time-checked records by kind, and everything that was not stored, with its reason."""

    ticks: DataFrame
    depths: DataFrame
    tickers: DataFrame
    rejects: DataFrame

    def trades(self) -> DataFrame:
        return tables.to_trades(self.ticks)

    def orderbook(self, keep_update_id: bool = False) -> DataFrame:
        return tables.to_orderbook(self.depths, keep_update_id)

    def bookticker(self) -> DataFrame:
        return tables.to_bookticker(self.tickers)

    def persisted(self) -> Records:
        return Records(
            enrich.persisted(self.ticks),
            enrich.persisted(self.depths),
            enrich.persisted(self.tickers),
            self.rejects,
        )


REJECT_COLUMNS = ("channel_id", "seq", "recv_us", "kind", "reject_reason")


def judged(
    parsed: DataFrame, channels: DataFrame, as_of_year: int, kinds: Sequence[str] = tuple(parse.RECORD_COLUMNS)
) -> DataFrame:
    """Every parsed message with its ``channel`` (registry entry) and, in ``reject_reason``, why it is not stored.
    ``kinds`` are those that were read: of them, what isn't refused by the parser has a record."""
    times = [F.when(F.col("kind") == k, F.col(f"{parse.RECORD_COLUMNS[k]}.exchange_timestamp")) for k in kinds]
    valid = timeparts.is_valid_us(F.coalesce(*times), as_of_year)
    missed = (
        F.when(F.col("channel").isNull(), parse.UNREGISTERED)
        .when((F.col("kind") == TICK) & ~F.coalesce("channel.record_tick", F.lit(False)), parse.UNRECORDED)
        .when(~valid, parse.INVALID_TIME)
    )
    reason = F.coalesce("reject_reason", F.when(F.col("kind").isin(*kinds), missed))
    return enrich.with_channel(parsed, channels, "left").withColumn("reject_reason", reason)


def records_of(messages: DataFrame) -> Records:
    """Judged messages by kind. Each part is one filter over the same rows; persist them when several are written."""
    stored = messages.where("reject_reason IS NULL")

    def part(column: str) -> DataFrame:
        keys = ("channel_id", "seq", "recv_us", parse.latency().alias("local_diff"))
        return stored.where(F.col(column).isNotNull()).select(*keys, f"{column}.*", "channel.*")

    rejects = messages.where("reject_reason IS NOT NULL").select(*REJECT_COLUMNS)
    return Records(*[part(column) for column in parse.RECORD_COLUMNS.values()], rejects)


def records_from_parsed(
    parsed: DataFrame, channels: DataFrame, as_of_year: int, kinds: Sequence[str] = tuple(parse.RECORD_COLUMNS)
) -> Records:
    """Join with the registry once, and check each message."""
    return records_of(judged(parsed, channels, as_of_year, kinds))


def outcomes(messages: DataFrame) -> DataFrame:
    """Judged messages per kind and outcome; the counts add up to all that came in."""
    outcome = F.coalesce("reject_reason", F.lit("stored"))
    return messages.groupBy("kind", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("messages"))


def futures_records(trades: DataFrame, bbo: DataFrame, channels: DataFrame, as_of_year: int) -> Records:
    """Typed futures feeds on the same path: trades and best bid/ask become parsed messages (no depth)."""

    def message(rows: DataFrame, column: str, kind: str) -> DataFrame:
        fields = [F.col(name).cast(type_).alias(name) for name, type_ in FIELDS[kind].items()]
        return rows.select("channel_id", *enrich.NAMES, "seq", "recv_us", F.lit(kind).alias("kind"), F.struct(*fields).alias(column))

    both = message(futures.normalise_trades(trades, channels), "tick", TICK).unionByName(
        message(futures.normalise_bbo(bbo, channels), "ticker", TICKER), allowMissingColumns=True
    )
    depth = ",".join(f"{n}:{parse.LEVELS if t == 'variant' else t}" for n, t in FIELDS[DEPTH].items())
    none = {"recv_ns": "bigint", "dispatch_ns": "bigint", "reject_reason": "string", "depth": f"struct<{depth}>"}
    return records_from_parsed(
        both.select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()]), channels, as_of_year
    )


def records_from_raw(
    raw: DataFrame,
    channels: DataFrame,
    as_of_year: int,
    feeds: Sequence[Feed] = FEEDS,
    kinds: Sequence[str] = ("TICK", "DEPTH", "BOOK_TICKER"),
) -> Records:
    """``kinds`` narrows what is read; the tables of other kinds are then empty."""
    return records_from_parsed(parse.parse_messages(raw, feeds, kinds), channels, as_of_year, kinds)


def union_records(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All feeds of one kind on one path."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
