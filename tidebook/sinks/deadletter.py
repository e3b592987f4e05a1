"""The degraded path: rows whose primary write failed, and their replay."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Where a row was stored (0 primary, 1 fallback) and whether it was replayed (0 no, 1 yes).
PRIMARY, FALLBACK = 0, 1
WAITING, REPLAYED = 0, 1


#: What a write that the store refused raises: errors of the system, and failed jobs. Errors of the code are others.
STORE_ERRORS = (OSError, Py4JJavaError)


def _batch_path(root: str, kind: str, batch_id: int) -> str:
    return os.path.join(root, "dead_letter", kind, f"batch_id={batch_id}")


def write_with_fallback(
    make: Callable[[], DataFrame], kind: str, batch, primary: Callable[[DataFrame, str], None], tries: int = 1
) -> int:
    """Try the primary write, as often as told, with rows made anew for each try; else store the whole batch in the
    dead-letter table of its kind. Returns where the rows are.

    The batch's part of the dead letter is overwritten, so a retried micro-batch leaves one copy.
    """
    for k in range(tries):
        try:
            primary(make(), kind)
            return PRIMARY
        except STORE_ERRORS:
            log.exception("write %s of %s of %s failed in batch %s", k + 1, tries, kind, batch.batch_id)
    store_waiting(make(), kind, batch.batch_id, batch.root)
    return FALLBACK


def store_waiting(rows: DataFrame, kind: str, batch_id: int, root: str) -> None:
    """Put a batch in the dead-letter table of its kind, in place of an earlier copy."""
    flagged = rows.withColumn("storage_target", F.lit(FALLBACK)).withColumn("recovery_status", F.lit(WAITING))
    flagged.write.mode("overwrite").parquet(_batch_path(root, kind, batch_id))


def replay(spark: SparkSession, kind: str, root: str, path: str, keys: list[str]) -> None:
    """Append the waiting rows that the table at ``path`` lacks, then mark every waiting batch as replayed.

    A batch is marked by writing it anew beside itself and putting that in its place. A replay that breaks off before
    finds, when run again, the rows it has stored already, by ``keys``.
    """
    rows = waiting(spark, kind, root).where(F.col("recovery_status") == WAITING)
    stored = spark.read.parquet(path)
    lost = rows.select(*stored.columns).dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    lost.write.mode("append").parquet(path)
    for row in rows.select("batch_id").distinct().collect():  # one row for each failed batch
        own = _batch_path(root, kind, row.batch_id)
        marked = f"{os.path.dirname(own)}/.replayed-{row.batch_id}"
        done = spark.read.parquet(own).withColumn("recovery_status", F.lit(REPLAYED))
        done.write.mode("overwrite").parquet(marked)
        spark.read.parquet(marked).write.mode("overwrite").parquet(own)


def waiting(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """All dead-letter rows of a kind, with their ``batch_id``."""
    return spark.read.parquet(os.path.join(root, "dead_letter", kind))


def replayed(primary: DataFrame, degraded: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and degraded rows as one table, each row once.

    A batch that failed half-way is in both; the primary copy wins. Copies are merged by an aggregate with
    map-side combine, so any number of copies of one key costs one row per task.
    """
    left = primary.withColumn("storage_target", F.lit(PRIMARY)).withColumn("recovery_status", F.lit(WAITING))
    right = degraded.drop("batch_id").withColumn("recovery_status", F.lit(REPLAYED))
    both = left.unionByName(right.select(*left.columns))
    rest = [c for c in both.columns if c not in keys and c != "storage_target"]
    merged = both.groupBy(*keys).agg(F.min_by(F.struct("storage_target", *rest), "storage_target").alias("r"))
    return merged.select(*keys, "r.*").select(*left.columns)
