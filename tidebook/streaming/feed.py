"""Continuous raw feed -> tables, topics, telemetry.

One ``foreachBatch`` parses the batch once, keeps it for the batch, and writes every output below a folder of the batch
and of this attempt at it; then it commits them together (``commits``). ``read`` gives committed rows only. Counts and
latencies are taken by the jobs that write (``gauges``) and stand in the commit. Nothing is watermarked: a late row is
stored under its own date.

A write that fails is tried once more for order books and best bid/ask. Trades are not: a failed write may have reached
the store, and trades add up. What then isn't stored waits in the dead letter. Only errors of the store or of its job
count as failed writes; errors of the code end the stream.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.feeds import FEEDS, Feed
from tidebook.operators import enrich
from tidebook.operators import tables as shaped
from tidebook.operators.parse import REASONS, parse_messages
from tidebook.plans.records import Records, judged, records_of
from tidebook.sinks import deadletter, tables, topics
from tidebook.streaming import commits
from tidebook.streaming.commits import Batch
from tidebook.streaming.gauges import Counted, counted_input

# Fixed value: default time between two batches.
DEFAULT_INTERVAL = "1 second"
KINDS = ("TICK", "DEPTH", "BOOK_TICKER")
TABLES = {"TICK": "trades", "DEPTH": "orderbook", "BOOK_TICKER": "bookticker"}
# How often the write of a table is tried.
TRIES = {"trades": 1, "orderbook": 2, "bookticker": 2}


@dataclass(frozen=True)
class Outputs:
    """Where a stream writes, and how its tables are partitioned."""

    root: str
    granularity: str = "day"
    buckets: int = tables.SYMBOL_BUCKETS
    publish: bool = True


Writer = Callable[[DataFrame, str], None]


def batch_writer(outputs: Outputs, batch: Batch) -> Writer:
    def write(rows: DataFrame, kind: str) -> None:
        tables.write_parquet(rows, batch.path(kind), outputs.granularity, outputs.buckets, mode="overwrite")

    return write


def write_records(
    records: Records,
    batch: Batch,
    outputs: Outputs,
    primary: Writer | None = None,
    kinds: Sequence[str] = KINDS,
) -> list[tuple]:
    """Fan one batch out to storage and topics; kinds that aren't wanted cost no job. Returns what a commit says."""
    write = primary or batch_writer(outputs, batch)
    shapes = {"TICK": shaped.to_trades, "DEPTH": shaped.to_orderbook, "BOOK_TICKER": shaped.to_bookticker}
    all_kinds = {"TICK": records.ticks, "DEPTH": records.depths, "BOOK_TICKER": records.tickers}
    facts = []
    for kind in kinds:
        made: list[Counted] = []

        def stored(kind: str = kind, made: list = made) -> DataFrame:
            made.append(
                Counted(
                    all_kinds[kind],
                    F.count(F.lit(1)).alias("messages"),
                    F.count_if("persist_to_disk").alias("stored"),
                    (F.max_by("local_diff", "seq") / F.lit(1000.0)).alias("latency_us"),
                )
            )
            return shapes[kind](enrich.persisted(made[-1].rows))

        table = TABLES[kind]
        target = deadletter.write_with_fallback(stored, table, batch, write, TRIES[table])
        found = made[-1].facts()
        facts.append((table, target, found["messages"], found["stored"], found["latency_us"], None))
        if outputs.publish:
            topics.write_files(topics.messages(all_kinds[kind], kind), os.path.join(batch.path("topics"), f"kind={kind}"), mode="overwrite")
    if outputs.publish:
        facts.append(("topics", deadletter.PRIMARY, None, None, None, None))
    refused = Counted(records.rejects, *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS], F.count(F.lit(1)).alias("all"))
    refused.rows.write.mode("overwrite").parquet(batch.path("rejects"))
    reasons = refused.facts()
    total = reasons.pop("all")
    facts.append(("rejects", deadletter.PRIMARY, total, total, None, reasons))
    return facts


def start(
    raw: DataFrame,
    channels: DataFrame,
    outputs: Outputs,
    as_of_year: int,
    feeds: Sequence[Feed] = FEEDS,
    interval: str | None = DEFAULT_INTERVAL,
    name: str | None = None,
    primary: Callable[[Batch], Writer] | None = None,
    kinds: Sequence[str] = KINDS,
) -> StreamingQuery:
    """Run the job over a ``raw_feed`` stream.

    ``interval=None`` drains what is there and stops. Bound a batch at the source (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``). ``primary(batch)`` may supply another table writer; ``kinds`` names the record
    kinds that the feed holds.
    """

    spark = raw.sparkSession

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        if commits.is_committed(spark, outputs.root, batch_id):
            return  # the run ended between this batch's commit and its checkpoint
        batch = Batch(outputs.root, batch_id)
        messages = judged(parse_messages(rows, feeds, kinds), channels, as_of_year, kinds).persist()
        try:
            facts = write_records(records_of(messages), batch, outputs, primary(batch) if primary else None, kinds)
        finally:
            messages.unpersist()
        commits.commit(spark, batch, facts)

    writer = counted_input(raw).writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", os.path.join(outputs.root, "_checkpoint")
    )
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def append_stream(
    rows: DataFrame, kind: str, outputs: Outputs, interval: str | None = DEFAULT_INTERVAL
) -> StreamingQuery:
    """A stream that already has a table's schema, appended to that table batch by batch."""

    spark = rows.sparkSession

    def on_batch(own: DataFrame, batch_id: int) -> None:
        if commits.is_committed(spark, outputs.root, batch_id):
            return
        batch = Batch(outputs.root, batch_id)
        counted = Counted(own, F.count(F.lit(1)).alias("rows"))
        batch_writer(outputs, batch)(counted.rows, kind)
        n = counted.facts()["rows"]
        commits.commit(spark, batch, [(kind, deadletter.PRIMARY, n, n, None, None)])

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        rows.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", os.path.join(outputs.root, f"_checkpoint_{kind}"))
        .trigger(**trigger)
        .start()
    )


def read(spark: SparkSession, outputs: Outputs, kind: str) -> DataFrame:
    """The committed rows of a table, of ``topics``' folder or of ``rejects``."""
    return commits.read(spark, outputs.root, kind)


def compact(spark: SparkSession, outputs: Outputs, kind: str, path: str, batches: Sequence[int] | None = None) -> list[str]:
    """Bring the committed rows of some batches (all, if none are named) into the sorted table at ``path``.

    Only partitions whose dates these batches touch are written anew, and returned: each replaces the one that stands
    there when the job commits. Rows keep their ``batch_id``, so a compaction that is run again adds nothing.
    """
    rows = read(spark, outputs, kind)
    if batches is not None:
        rows = rows.where(F.col("batch_id").isin(*batches))
    rows = rows.drop("attempt", "part_date", "symbol_bucket")
    start = tables.partition_start(F.col("trade_date"), outputs.granularity)
    touched = [r.d for r in rows.select(start.alias("d")).distinct().collect()]  # as many as dates
    if not touched:
        return []
    found = _stored(spark, path)
    if found is not None:
        own = found.where(F.col("part_date").isin(*touched)).drop("part_date", "symbol_bucket")
        named = rows.select("batch_id").distinct()
        rows = rows.unionByName(own.join(F.broadcast(named) if batches else named, "batch_id", "left_anti"))
    out, keys = tables.laid_out(rows, outputs.granularity, outputs.buckets)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return sorted(map(str, touched))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not commits.is_missing(error):
            raise
        return None


def backlog(query: StreamingQuery) -> dict[str, float]:
    """Rows of the last batch and rows per second in and out, from the query's own progress."""
    progress = query.lastProgress
    if not progress:
        return {"rows": 0, "in_per_s": 0.0, "out_per_s": 0.0}
    return {
        "rows": progress["numInputRows"],
        "in_per_s": progress["inputRowsPerSecond"] or 0.0,
        "out_per_s": progress["processedRowsPerSecond"] or 0.0,
    }
