"""Writing the output tables."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidebook import schemas
from tidebook.functions import identity
from tidebook.operators.tables import to_wide
from tidebook.session import scratch

log = logging.getLogger(__name__)

# Number of symbol buckets of a table, and the partition granularities a table may have.
SYMBOL_BUCKETS = 20
GRANULARITIES = ("day", "month", "year")


def _check_granularity(granularity: str) -> None:
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, not {granularity!r}")


def partition_start(day: Column, granularity: str) -> Column:
    _check_granularity(granularity)
    return F.trunc(day, granularity) if granularity != "day" else day


def partition_bounds(spark: SparkSession, first: str, last: str, granularity: str) -> DataFrame:
    """Start dates of the partitions that cover ``first`` to ``last``, plus the closing bound."""
    _check_granularity(granularity)
    step = F.expr(f"INTERVAL 1 {granularity}")
    start = partition_start(F.lit(first).cast("date"), granularity)
    end = partition_start(F.lit(last).cast("date"), granularity) + step
    return spark.range(1).select(F.explode(F.sequence(start, end.cast("date"), step)).alias("bound"))


def laid_out(
    rows: DataFrame, granularity: str = "day", buckets: int = SYMBOL_BUCKETS
) -> tuple[DataFrame, list[str]]:
    """Rows in table layout, and the partition columns.

    The shuffle is a rebalance by partition: AQE splits a day or bucket that holds much of the data over many
    tasks and joins small ones, from the sizes that the shuffle itself finds, so rows are made once. Every file is
    sorted, which is what row-group pruning needs; :func:`range_sorted` also gives each file a stretch of time of its
    own. The partition columns lead the sort, so the writer has no reason to sort again.
    """
    keys = ["part_date", "symbol_bucket"]
    keyed = rows.withColumn("part_date", partition_start(F.col("trade_date"), granularity)).withColumn(
        "symbol_bucket", identity.bucket(F.col("symbol"), buckets)
    )
    order = [*keys, "symbol", "exchange_timestamp"]
    return keyed.hint("rebalance", *keys).sortWithinPartitions(*order), keys


def range_sorted(stored: DataFrame) -> DataFrame:
    """Stored rows by range of symbol and time, for a table at rest: reading them twice is cheap."""
    return stored.repartitionByRange("symbol", "exchange_timestamp").sortWithinPartitions("symbol", "exchange_timestamp")


def write_parquet(
    rows: DataFrame,
    path: str,
    granularity: str = "day",
    buckets: int = SYMBOL_BUCKETS,
    mode: str = "append",
) -> None:
    out, keys = laid_out(rows, granularity, buckets)
    out.write.mode(mode).partitionBy(*keys).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(
    rows: DataFrame, name: str, buckets: int = SYMBOL_BUCKETS, mode: str = "append", path: str | None = None
) -> None:
    """A catalog table bucketed by symbol, so later joins and aggregates on symbol need no shuffle; at ``path``, if given.

    Rows are first rebalanced by (date, bucket), so few tasks write to one bucket of one day, and a busy one still
    gets several.
    """
    keyed = rows.withColumn("_bucket", identity.bucket(F.col("symbol"), buckets))
    writer = (
        keyed.hint("rebalance", "trade_date", "_bucket")
        .drop("_bucket")
        .write.mode(mode)
        .partitionBy("trade_date")
        .bucketBy(buckets, "symbol")
        .sortBy("symbol", "exchange_timestamp")
    )
    (writer.option("path", path) if path else writer).saveAsTable(name)


CSV_KEYS = ("exchange", "market_type", "symbol", "trade_date")
_CSV_COLUMNS = {
    "trades": ("exchange_timestamp", "local_diff", "price", "quantity", "direction"),
    "bookticker": (
        "exchange_timestamp",
        "local_diff",
        "symbol_text",
        "best_bid_price",
        "best_bid_qty",
        "best_ask_price",
        "best_ask_qty",
    ),
}


def write_csv(rows: DataFrame, path: str, kind: str, depth: int | None = None, mode: str = "append") -> None:
    """Daily files per channel under ``{path}/{kind}/exchange=../market_type=../symbol=../trade_date=../``.

    A late row lands in its own day. Order books are written wide, each row with as many levels as it has (its
    channel's stored depth), or with ``depth``; files of one depth have one header. Rows of several depths are made once
    and kept by depth in the shared folder, from where each depth's files are written.
    """
    if kind != "orderbook":
        out = rows.withColumn("symbol_text", F.col("symbol")) if kind == "bookticker" else rows
        _write_csv(out.select(*_CSV_COLUMNS[kind], *CSV_KEYS), os.path.join(path, kind), mode)
        return
    if depth:
        _write_csv(to_wide(rows, depth), os.path.join(path, kind), mode)
        return
    by_depth = scratch(rows.sparkSession, "by-depth")
    size = F.greatest(F.size("bid_prices"), F.size("ask_prices"))
    rows.withColumn("_depth", size).hint("rebalance", "_depth").write.partitionBy("_depth").parquet(by_depth)
    made = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("_depth", IntegerType())])).parquet(by_depth)
    depths = [r[0] for r in made.select("_depth").distinct().orderBy("_depth").collect()]  # from folder names
    for k, n in enumerate(depths):
        own = made.where(F.col("_depth") == n).drop("_depth")
        _write_csv(to_wide(own, n), os.path.join(path, kind), mode if k == 0 else "append")


def _write_csv(out: DataFrame, path: str, mode: str) -> None:
    """Tasks get rows of few partitions; AQE splits those that are large, without a sampling pass."""
    order = [*CSV_KEYS, "exchange_timestamp"]
    spread = out.hint("rebalance", *CSV_KEYS).sortWithinPartitions(*order)
    spread.write.mode(mode).partitionBy(*CSV_KEYS).option("header", True).csv(path)


Writer = Callable[[DataFrame, str, str], None]
BACKENDS: dict[str, Writer] = {
    "csv": write_csv,
    "parquet": lambda rows, path, kind: write_parquet(rows, os.path.join(path, kind)),
    "bucketed": lambda rows, path, kind: save_bucketed(rows, kind),
}


def backend(name: str | None) -> Writer:
    """A writer by name; an unknown or empty name means CSV, with a warning."""
    if name in BACKENDS:
        return BACKENDS[name]
    log.warning("unknown storage backend %r, using csv", name)
    return BACKENDS["csv"]


def write_table(rows: DataFrame, path: str, kind: str, backend_name: str | None = "parquet") -> None:
    backend(backend_name)(rows, path, kind)


def check_tables(spark: SparkSession, path: str, queries: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with the stored tables; empty when all is well.

    Every table must exist with its columns and types. A missing streaming query is only logged.
    """
    problems = []
    for kind, ddl in schemas.TABLES.items():
        try:
            found = spark.read.parquet(os.path.join(path, kind)).schema
        except Exception as error:  # noqa: BLE001  a missing path surfaces as one of several classes
            problems.append(f"{kind}: {type(error).__name__}")
            continue
        types = {f.name: f.dataType.simpleString() for f in found.fields}
        for field in StructType.fromDDL(ddl).fields:
            if types.get(field.name) != field.dataType.simpleString():
                problems.append(f"{kind}.{field.name}: {types.get(field.name)}")
    running = {q.name for q in spark.streams.active}
    for name in queries:
        if name not in running:
            log.warning("streaming query %s is not running", name)
    return problems
