"""Checkpoints and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A folder of our own only where that is unset and all runs on this machine; on
    a cluster each executor would write to a disk of its own.
    """
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not set_.isEmpty():
        root = set_.get()
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.gettempdir()}/quillon-checkpoints-{os.getpid()}"
    if set_.isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/quillon-tables/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there, so that later steps read only the columns and rows that they need.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def sizes_at_run_time(spark: SparkSession) -> Iterator[None]:
    """Within, a join is broadcast by the size that its rows turn out to have, not by that of files.

    Parquet holds repeated values once, so that millions of rows may look small enough
    to be gathered in the driver.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {c: spark.conf.get(c, None) for c in (static, adaptive)}
    spark.conf.set(adaptive, before[adaptive] or spark.conf.get(static))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended  # noqa: BLE001, S110
            pass
