"""Latency, backlog, drop and gap measures as plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.ordered import previous_in_order


def last_latency(records: DataFrame, *keys: str) -> DataFrame:
    """Latest latency per key in microseconds. ``max_by`` combines map-side, so a hot key is no burden."""
    keys = keys or ("channel_id",)
    return records.groupBy(*keys).agg(
        (F.max_by("local_diff", "seq") / F.lit(1000.0)).alias("latency_us"), F.max("seq").alias("seq")
    )


def drop_totals(rejects: DataFrame) -> DataFrame:
    """Rows per reject reason, and the total under a NULL reason."""
    return rejects.rollup("reject_reason").agg(F.count(F.lit(1)).alias("dropped"))


def sequence_gaps(records: DataFrame, id_column: str = "trade_id") -> DataFrame:
    """Missing ids between neighbours of a channel (an addition; the gap counter is otherwise always 0)."""
    with_prev = previous_in_order(records, "channel_id", "seq", id_column, "previous_id")
    gap = F.col(id_column) - F.col("previous_id") - 1
    return with_prev.where(gap > 0).withColumn("gap", gap)
