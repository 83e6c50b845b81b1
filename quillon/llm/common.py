"""Shared storage, sizing and text helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an Arrow batch on its way to a Python worker may hold.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 10_000

#: Unicode White_Space beyond what ASCII has, for exact splitting.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir``. Only where that is unset and all runs
    on this machine (a local master) a folder of our own, which is then set for the
    session; on a cluster each executor would write to a disk of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/quillon-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended  # noqa: BLE001, S110
            pass


class Stored:
    """A table written to the shared folder, by ``apart`` in folders of their own, which any executor can read again."""

    def __init__(self, df: DataFrame, name: str, apart: str | None = None):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, name)
        self.schema = df.schema
        (df.write.partitionBy(apart) if apart else df.write).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, part: str = "") -> None:
        """Delete the table, or one of its folders."""
        remove(self.spark, f"{self.path}/{part}" if part else self.path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer as long as a column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long texts don't add up, and let a finished query's shuffle files go."""
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        if spark.conf.get(key, None) != str(value):
            spark.conf.set(key, str(value))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; reads the lengths in one pass on the JVM."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(total: float, each: float, least: int = 1) -> int:
    """How many parts of at most about ``each`` hold ``total``."""
    return max(least, math.ceil(total / each))


#: Letters of one section of a long text.
SECTION = 1 << 18
_SPACE = re.compile(f"(?<=[^\\t-\\r {WIDE_SPACE}])[\\t-\\r {WIDE_SPACE}]")


def sections(text: str) -> Iterator[str]:
    """The text in parts of about ``SECTION`` letters; each but the first begins with a whole run of white space."""
    at = 0
    while len(text) - at > SECTION:
        space = _SPACE.search(text, at + SECTION)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


class BoundedCache(dict):
    """A dict by strings, of values no larger than their keys, that ``trim`` empties once its entries hold more than ``most`` bytes."""

    #: What an entry takes besides its letters, and a letter in key and value.
    ENTRY, LETTER = 200, 4

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def put(self, key: str | bytes, value: object) -> None:
        self[key] = value
        self.held += self.ENTRY + self.LETTER * len(key)

    def put_all(self, keys: list, values: Iterable) -> None:
        self.update(zip(keys, values, strict=True))
        self.held += self.ENTRY * len(keys) + self.LETTER * sum(map(len, keys))

    def trim(self) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give memory that a Python worker has freed back to the system; the worker lives on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a shared-folder URI, usable on executors."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a text column, nulls as empty strings."""
    return [s or "" for s in column.to_pylist()]
