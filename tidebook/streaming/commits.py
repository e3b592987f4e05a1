"""Which outputs of a stream count.

Every output of a micro-batch is written below a folder of that batch and of the attempt that wrote it; nothing there is
read until the batch is committed. A commit is one small file, put in place by one rename when all outputs stand:
a row for each kind of output with the attempt that counts. So readers see all outputs of a batch or none, a run killed
between two writes leaves only folders that no commit names, and a batch that was committed before its checkpoint was is
not written again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_commits"
COMMIT = (
    "batch_id BIGINT, attempt STRING, kind STRING, target INT, messages BIGINT, stored BIGINT, latency_us DOUBLE, "
    "reasons MAP<STRING, BIGINT>"
)


def new_attempt() -> str:
    """A folder name that Spark takes for text."""
    return f"a-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Batch:
    """One attempt at one micro-batch."""

    root: str
    batch_id: int
    attempt: str = field(default_factory=new_attempt)

    def path(self, kind: str) -> str:
        return os.path.join(self.root, kind, f"batch_id={self.batch_id}", f"attempt={self.attempt}")


def is_missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def log(spark: SparkSession, root: str) -> DataFrame:
    """All commits; empty before the first one."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(os.path.join(root, FOLDER))
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], COMMIT)


def is_committed(spark: SparkSession, root: str, batch_id: int) -> bool:
    try:
        return not spark.read.schema(COMMIT).json(os.path.join(root, FOLDER, str(batch_id))).isEmpty()
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return False


def commit(spark: SparkSession, batch: Batch, facts: Iterable[tuple]) -> None:
    """``facts``: (kind, target, messages, stored, latency_us, reasons) for each output."""
    rows = [(batch.batch_id, batch.attempt, *f) for f in facts]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").json(os.path.join(batch.root, FOLDER, str(batch.batch_id)))


def of_committed(rows: DataFrame, root: str, kind: str, **wanted: int) -> DataFrame:
    """Those rows of an output that a commit names, by their ``batch_id`` and ``attempt``."""
    named = log(rows.sparkSession, root).where(F.col("kind") == kind)
    for column, value in wanted.items():
        named = named.where(F.col(column) == value)
    return rows.join(named.select("batch_id", "attempt").distinct(), ["batch_id", "attempt"], "left_semi")


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The committed rows of one output, with ``batch_id`` and ``attempt``. The join prunes the folders it reads."""
    return of_committed(spark.read.parquet(os.path.join(root, kind)), root, kind)


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, kind, outcome, messages): what became of each batch's messages, as counted by the jobs that wrote them."""
    own = log(spark, root)
    kinds = own.where(F.col("reasons").isNull())
    stored = kinds.select("batch_id", "kind", F.lit("stored").alias("outcome"), F.col("stored").alias("messages"))
    passed = kinds.select("batch_id", "kind", F.lit("not_persisted").alias("outcome"), (F.col("messages") - F.col("stored")).alias("messages"))
    refused = own.where(F.col("reasons").isNotNull()).select("batch_id", "kind", F.explode("reasons").alias("outcome", "messages"))
    return stored.unionByName(passed).unionByName(refused).where("messages > 0")
