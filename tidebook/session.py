"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "tidebook", cores: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's own session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.log.level", "ERROR")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings the jobs rely on: dates and times are in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already: of long messages, Spark's own would take some
    hundred MB at a time in the executor and its workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name).lower().removesuffix("b")
    if not (own.isdigit() and 0 < int(own) <= size):
        spark.conf.set(name, f"{size}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a temporary folder; on a cluster that is an error, as
    executors don't see each other's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_already = spark.sparkContext.getCheckpointDir()
        if not set_already and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = set_already or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created and nothing reused."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
