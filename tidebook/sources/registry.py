"""The channel registry: one row per (exchange, market type, symbol)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions import identity


class RegistryError(ValueError):
    """The registry breaks a rule; the message names the first offending channels."""


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Nested channel configuration, one JSON document per file."""
    return spark.read.schema(schemas.CONFIG).option("multiLine", True).json(path)


def channels_from_config(config: DataFrame) -> DataFrame:
    """``exchanges[] -> channels[] -> symbols[]`` flattened, defaults filled in.

    An exchange is off unless switched on; a symbol is on unless switched off. A channel is persisted when
    both the global switch and its own allow it.
    """

    def default(column: str, value) -> F.Column:
        return F.coalesce(F.col(column), F.lit(value))

    flat = (
        config.select("global_persist", F.explode("exchanges").alias("e"))
        .select("global_persist", "e.name", "e.enabled", F.explode("e.channels").alias("c"))
        .select("global_persist", "name", "enabled", "c.type", F.explode("c.symbols").alias("s"))
    )
    named = flat.select(
        F.col("name").alias("exchange"),
        F.col("type").alias("market_type"),
        F.col("s.name").alias("symbol"),
        default("s.depth_level", schemas.DEFAULT_DEPTH_LEVEL).alias("depth_level"),
        (default("enabled", False) & default("s.enabled", True)).alias("enabled"),
        default("s.record_tick", True).alias("record_tick"),
        (default("global_persist", True) & default("s.persist_to_disk", True)).alias("persist_to_disk"),
    )
    return with_identity(named)


def with_identity(channels: DataFrame) -> DataFrame:
    """Add ``channel_id`` and ``topic_prefix``."""
    names = [F.col(c) for c in ("exchange", "market_type", "symbol")]
    return channels.select(
        identity.channel_id(*names).alias("channel_id"),
        *names,
        "depth_level",
        "enabled",
        "record_tick",
        "persist_to_disk",
        identity.channel_key(*names).alias("topic_prefix"),
    )


def violations(channels: DataFrame) -> DataFrame:
    """One row per broken rule: (topic_prefix, problem)."""
    symbol, depth = F.col("symbol"), F.col("depth_level")
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce(symbol, F.lit("")) == "", "symbol_missing"),
            F.when(depth < 0, "depth_out_of_range"),
            F.when(~identity.is_market_type(F.col("market_type")), "market_type"),
            F.when(F.octet_length("topic_prefix") != F.char_length("topic_prefix"), "not_ascii"),
        )
    )
    return channels.select("topic_prefix", F.explode(problems).alias("problem"))


def collisions(channels: DataFrame) -> DataFrame:
    """Ids claimed by more than one channel. Registering the same channel twice is fine."""
    return (
        channels.groupBy("channel_id")
        .agg(F.count_distinct("topic_prefix").alias("channels"))
        .where(F.col("channels") > 1)
    )


def register(channels: DataFrame) -> DataFrame:
    """The checked registry: enabled channels, each once. Raises on any violation or id collision."""
    bad = violations(channels).take(5)
    if bad:
        raise RegistryError("; ".join(f"{r.topic_prefix}: {r.problem}" for r in bad))
    clash = collisions(channels).take(5)
    if clash:
        raise RegistryError("; ".join(f"id {r.channel_id} claimed by {r.channels} channels" for r in clash))
    return channels.where("enabled").dropDuplicates(["channel_id"])
