"""Joins of records with the registry, and the filters its flags drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("exchange", "market_type", "symbol")
REGISTRY_COLUMNS = (
    *NAMES,
    "depth_level",
    "record_tick",
    "persist_to_disk",
    "topic_prefix",
)


def with_channel(records: DataFrame, channels: DataFrame, how: str) -> DataFrame:
    """Records joined with the registry by ``channel_id``; the entry is in ``channel``.

    An id is a hash of 32 bits, so some channels of a large registry share one. For those the names in the record decide as
    well; a record of such an id without names, or with others, has no channel.
    """
    same_id = Window.partitionBy("channel_id")
    entries = channels.select(
        F.col("channel_id").alias("_id"),
        (F.min("topic_prefix").over(same_id) < F.max("topic_prefix").over(same_id)).alias("_shared"),
        *[F.col(c).alias(f"_own_{c}") for c in REGISTRY_COLUMNS],
    )
    named = F.lit(True)
    for name in NAMES:
        own = F.col(name) if name in records.columns else F.lit(None).cast("string")
        named = named & F.coalesce(own == F.col(f"_own_{name}"), F.lit(False))
    joined = records.join(entries, (F.col("channel_id") == F.col("_id")) & (~F.col("_shared") | named), how)
    if how == "left_anti":
        return joined
    # A struct made before an outer join loses its NULLs when its fields are read: fields that are never NULL there count as
    # such after the join too. So it is made here.
    entry = F.struct(*[F.col(f"_own_{c}").alias(c) for c in REGISTRY_COLUMNS])
    return joined.select(*records.columns, F.when(F.col("_id").isNotNull(), entry).alias("channel"))


def registered(records: DataFrame, channels: DataFrame) -> DataFrame:
    """Inner lookup: identity and flags come from the registry, unknown channels are dropped."""
    own = [c for c in records.columns if c not in NAMES]
    return with_channel(records, channels, "inner").select(*own, "channel.*")


def unregistered(records: DataFrame, channels: DataFrame) -> DataFrame:
    return with_channel(records, channels, "left_anti")


def with_defaults(records: DataFrame, channels: DataFrame) -> DataFrame:
    """Left lookup: an unknown channel keeps its own symbol, has blank names and depth 0, that is, all levels are stored."""
    own = [c for c in records.columns if c not in NAMES]
    return with_channel(records, channels, "left").select(
        *own,
        F.coalesce("channel.exchange", F.lit("")).alias("exchange"),
        F.coalesce("channel.market_type", F.lit("")).alias("market_type"),
        F.coalesce("channel.symbol", "symbol").alias("symbol"),
        F.coalesce("channel.depth_level", F.lit(0)).alias("depth_level"),
        F.coalesce("channel.record_tick", F.lit(True)).alias("record_tick"),
        F.coalesce("channel.persist_to_disk", F.lit(True)).alias("persist_to_disk"),
        F.coalesce("channel.topic_prefix", F.lit("")).alias("topic_prefix"),
    )


def recordable(ticks: DataFrame) -> DataFrame:
    """Trades of channels that record trades."""
    return ticks.where("record_tick")


def persisted(records: DataFrame) -> DataFrame:
    """Records of channels that are written to disk; applied before sinks, not before publishing."""
    return records.where("persist_to_disk")


def of_persisted_channels(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """The same filter for rows that no longer carry the flags."""
    keys = list(NAMES)
    return rows.join(channels.where("persist_to_disk").select(*keys), keys, "left_semi")
