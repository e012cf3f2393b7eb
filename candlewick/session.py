"""Session defaults."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Shuffle partitions for a volume, so that one fits a task's memory.

    Adaptive execution merges small partitions but does not split the rest of a
    shuffle, so the number has to follow the largest shuffle.
    """
    return max(200, -(-shuffled_bytes // PARTITION_BYTES))


def session(
    app: str = "candlewick", master: str | None = None, shuffled_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings every query here relies on.

    ``shuffled_bytes`` is the size of the largest shuffle expected; for a run
    over 100 TB of bars that is about the size of the columns it reads.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Recording a call site per column call slows down building wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    if shuffled_bytes is not None:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions(shuffled_bytes))
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Stored timestamps are UTC, so date arithmetic has to run in UTC too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A cluster sets it. It is unset only on a single machine (tests), where a
    new folder is made and recorded in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder
