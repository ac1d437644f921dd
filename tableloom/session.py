"""Session settings and the one place that decides where intermediate data lives."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tableloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the configured checkpoint folder.

    Only a local session without one (tests, local runs) gets a temporary folder,
    which goes when Python ends; on a cluster a missing folder is an error, for
    executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    active = context.getCheckpointDir()
    if configured:
        if active is None:
            context.setCheckpointDir(configured)
        return configured
    if active is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="tableloom-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        context.setCheckpointDir(folder.name)
        active = context.getCheckpointDir()
    return active


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Survives lost executors and cuts the lineage, and the size of what was
    written is known, so later joins broadcast it only when it is small.
    ``rows_per_file``: for rows of megabytes, since a reader takes some thousand
    rows of a file at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most so many rows at once to Python; for rows of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
