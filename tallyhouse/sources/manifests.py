"""Folders of files against their manifests, hashed by the executors."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import qualified


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes, sha256 of every file in it, each read by a task of its own or with other small ones.

    Spark reads no files without bytes, so these come from its own listing of the folder.
    """
    root = qualified(spark, folder).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Spark writes local paths with one slash after the scheme.
    below = lambda path: F.substring(F.regexp_replace(path, "^file:/+", "file:///"), F.lit(len(root) + 1), F.length(path) + 2)
    hashed = files.select(below(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string").select(below(F.col("path")).alias("path"))
    return listed.join(hashed, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))


def manifest_problems(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """path, problem of what doesn't agree between a folder and its manifest of path and sha256.

    `escaping`: the path is absolute, names a scheme, or leaves the folder by `..`; it is never opened.
    `repeated`: the manifest has it more than once. `missing`: there is no such file. `changed`: its
    content has another hash. `extra`: a file that the manifest hasn't. A sound folder gives no rows.
    """
    escaping = F.startswith("path", F.lit("/")) | F.contains("path", F.lit("://")) | F.array_contains(F.split("path", "[/\\\\]"), "..")
    named = manifest.groupBy("path").agg(F.count("*").alias("n"), F.max("sha256").alias("said")).withColumn("escaping", escaping)
    both = named.where(~F.col("escaping")).join(file_hashes(spark, folder), "path", "full_outer")
    problem = F.when(F.col("n").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("said").eqNullSafe(F.col("sha256")), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL").union(named.where("escaping").select("path", F.lit("escaping")))
