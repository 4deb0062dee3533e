"""What the operators share: written intermediate tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at a time, so that outputs stay small.
SLICE_ROWS = 256


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tallyhouse-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Where that is unset (tests on one
    machine) a temporary folder is made, which only a local master may do.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local()
    return found.rstrip("/")


#: Intermediate folders that this driver program has made and not yet deleted.
_MADE: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder for intermediate data, which is deleted when the driver program ends, or before by dropped()."""
    if not _MADE:
        atexit.register(_at_exit, spark._jvm, spark._jsc.hadoopConfiguration())
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def _delete(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        with contextlib.suppress(ValueError):
            _MADE.remove(path)


def _at_exit(jvm, conf) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and with it only the chance to tidy up
        _delete(jvm, conf, list(_MADE))


def made() -> list[str]:
    """The intermediate folders there are."""
    return list(_MADE)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate folders that nothing reads any more."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), paths)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str = "4m", rows: int = 2048) -> Iterator[None]:
    """Batches to and from Python of bounded bytes while an action runs, so that long texts don't add up."""
    keys = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: an executor that is lost later costs nothing that was written, and the
    planner knows the size of what it reads. Unlike a checkpoint it runs the plan once.
    """
    path = new_path(df.sparkSession, tag)
    with arrow_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that are sent to every executor at most, and bytes of its files.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it is counted to have few rows and its files are small; else it is joined by a shuffle."""
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(written) if size <= BROADCAST_BYTES and written.count() <= rows else written


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of batches; when a task has read all of them, its worker gives unused memory back before it waits for another."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
