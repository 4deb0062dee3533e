"""The session that the engine's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, strict casts and run-time replanning; partitions are sized for spilling late on large inputs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "tallyhouse", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as Arrow knows it: one without gets Hadoop's default, not each machine's own disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme, _, rest = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().partition(":")
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{'' if rest.startswith('//') else '//'}{rest}"
