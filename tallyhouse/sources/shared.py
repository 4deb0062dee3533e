"""Tables that are written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tallyhouse-")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, which only a local master may do, a temporary folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local()
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder that is deleted when the driver program ends."""
    if not _MADE:
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration())
    _MADE.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _delete(jvm, conf) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and with it only the chance to tidy up
        for path in _MADE:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: what is read again costs no executor's loss and has a known size."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
