"""Publishing records under topics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import identity

# Topic suffix and message type tag per record kind.
MESSAGE_TYPES = {"TICK": ("tick", 1), "DEPTH": ("depth", 2), "BOOK_TICKER": ("book_ticker", 3)}


def addressed(records: DataFrame, kind: str) -> DataFrame:
    """All records as (topic, msg_type, value, sendable). Value is the record as JSON."""
    suffix, tag = MESSAGE_TYPES[kind]
    flags = ("record_tick", "persist_to_disk", "topic_prefix")
    body = F.to_json(F.struct(*[c for c in records.columns if c not in flags]))
    named = records.select(
        identity.topic(F.col("topic_prefix"), suffix).alias("topic"),
        F.lit(tag).cast("tinyint").alias("msg_type"),
        body.alias("value"),
        (F.col("topic_prefix") != "").alias("sendable"),
    )
    return named


def messages(records: DataFrame, kind: str) -> DataFrame:
    """What is sent: records of registered channels."""
    return addressed(records, kind).where("sendable").drop("sendable")


def write_files(sent: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines per topic; AQE spreads a busy topic over several files."""
    spread = sent.hint("rebalance", "topic")
    spread.write.mode(mode).partitionBy("topic").json(path)


def write_kafka(sent: DataFrame, servers: str) -> None:
    """To a broker, keyed by topic so the order within a channel is kept, the message type as a header; needs the Kafka connector."""
    tag = F.struct(F.lit("msg_type").alias("key"), F.encode(F.col("msg_type").cast("string"), "utf-8").alias("value"))
    rows = sent.select(
        F.regexp_replace("topic", ":", ".").alias("topic"), F.col("topic").alias("key"), "value", F.array(tag).alias("headers")
    )
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def read_files(spark, path: str) -> DataFrame:
    return spark.read.schema("topic STRING, msg_type TINYINT, value STRING").json(os.path.join(path))
