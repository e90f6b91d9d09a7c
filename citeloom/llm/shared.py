"""Where intermediate tables go, and small helpers that all operators of this subpackage use."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that may be broadcast, as Spark holds it in memory; what is larger goes through a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a kernel works on at a time.
SLICE_BYTES = 2 << 20
#: Spark's setting for shuffle files to go as the query ends that wrote them; else they stay until the driver happens to collect its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, under ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine it is
    a temporary one; on a cluster each executor would write to a disk of its own. The file system deletes it as the application ends."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="citeloom-"))
        named = sc.getCheckpointDir()
    path = f"{named.rstrip('/')}/{sc.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (or one of ``passing``): computed once, and readable after executors are lost."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[str]:
    """A folder for ``stored`` tables that nothing reads after the block, which deletes them."""
    path = new_path(spark, "passing")
    try:
        yield path
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """In the block, a query's shuffle files are deleted as it ends. What it returns must be ``stored``, as the files are gone."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def _held(df: DataFrame) -> int:
    """About the bytes of a stored table as rows in a hash table: 8 a field, 24 a row, and what its strings, binaries and arrays hold."""
    per_row = F.lit(8 * len(df.columns) + 24)
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType
        if kind.typeName() in ("string", "binary"):
            per_row += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            element = {"integer": 4, "long": 8, "double": 8}.get(kind.elementType.typeName(), 32)
            per_row += F.coalesce(element * F.size(c) + 16, F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row.cast("long")), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it holds no more than ``most`` bytes, else as it is. ``df`` should be stored."""
    return F.broadcast(df) if _held(df) <= most else df


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes in a column of strings, one row at least; memory is given back at the end."""
    try:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
                yield b.slice(at, to - at)
                at = to
    finally:
        give_back()


def give_back() -> None:
    """Return what this worker process has freed to the system, as workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
