"""Batch and streaming readers for the input tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook import schemas

INPUTS = {
    "raw_feed": schemas.RAW_FEED,
    "book_events": schemas.BOOK_EVENTS,
    "futures_trades": schemas.FUTURES_TRADES,
    "futures_bbo": schemas.FUTURES_BBO,
    **schemas.TABLES,
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(INPUTS[name]).format(fmt).load(path)


def stream_table(
    spark: SparkSession, name: str, path: str, fmt: str = "parquet", max_files: int | None = None, **options: str
) -> DataFrame:
    """A directory as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(INPUTS[name]).format(fmt).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_topic(spark: SparkSession, servers: str, topics: str, max_offsets: int | None = None) -> DataFrame:
    """Raw messages from a topic whose values are ``raw_feed`` rows as JSON; needs the Kafka connector."""
    from pyspark.sql import functions as F

    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    row = F.from_json(F.col("value").cast("string"), schemas.RAW_FEED)
    return reader.load().select(row.alias("r")).select("r.*")
