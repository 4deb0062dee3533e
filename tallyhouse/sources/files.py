"""Reading logs, policies, passages and markup from files, and writing results once."""

from __future__ import annotations

import io
import json
import uuid
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import qualified
from tallyhouse.sources import jats

# The raw log's columns, in order.
LOG_SCHEMA = T.StructType([
    T.StructField("Date", T.StringType()), T.StructField("Workout Name", T.StringType()), T.StructField("Exercise Name", T.StringType()), T.StructField("Set Order", T.IntegerType()),
    T.StructField("Weight", T.DoubleType()), T.StructField("Reps", T.IntegerType()), T.StructField("Distance", T.DoubleType()), T.StructField("Seconds", T.IntegerType()),
    T.StructField("Notes", T.StringType()), T.StructField("Workout Notes", T.StringType()),
])
DECISIONS = ("merge", "defer", "reject")


def log_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The raw log with started_at. Strict: another header, a bad value or an unparseable date fails; else bad dates are null.

    source_row is the place in the file (data begin at 2), which one task gives, as only order in the file defines it.
    """
    text = spark.read.text(path).limit(1).collect()
    header = text[0][0] if text else ""
    names = [x.strip().strip('"') for x in header.split(",")]
    if strict and names != LOG_SCHEMA.names:
        raise ValueError(f"unexpected header {names}")
    reader = spark.read.schema(LOG_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.csv(path)
    at = F.try_to_timestamp("Date", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    if strict:
        at = F.when(at.isNull(), F.raise_error(F.concat(F.lit("unparseable date: "), F.coalesce("Date", F.lit("null")))).cast("timestamp_ntz")).otherwise(at)
    return rows.coalesce(1).withColumn("source_row", F.monotonically_increasing_id() + 2).withColumn("started_at", at)


def alias_decisions(spark: SparkSession, path: str) -> DataFrame:
    """raw_name, canonical_name, decision; another decision or two merge targets of one name fail when the rows are used."""
    rows = spark.read.option("header", True).csv(path)
    known = F.when(F.lower(F.trim("decision")).isin(*DECISIONS), F.lower(F.trim("decision"))).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), F.col("decision"))).cast("string"))
    return rows.withColumn("decision", known)


def policy(text: str, required: set[str], version: str | None = None) -> dict:
    """A JSON policy with all its required keys and, if asked, a version."""
    found = json.loads(text)
    if missing := sorted(required - found.keys()):
        raise ValueError(f"policy lacks {missing}")
    if version and found.get("version") != version:
        raise ValueError(f"policy version {found.get('version')} isn't {version}")
    return found


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """path, ids, title, year, journal, authors, license, sections of article XML files, each read whole by one row's function."""

    @F.pandas_udf("pmcid string, pmid string, doi string, title string, year int, journal string, authors array<string>, license string, sections array<struct<title:string,paragraphs:array<string>>>")
    def parse(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(bytes(f)) for f in files])

    rows = spark.read.format("binaryFile").load(path).select("path", parse("content").alias("a"))
    return rows.select("path", "a.*")


def article(data: bytes) -> dict:
    """Metadata and sections of one article, with or without namespaces; an electronic publication year comes first."""
    root = ET.fromstring(data)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else "comment"
    ids = {e.get("pub-id-type"): (e.text or "").strip() for e in root.iter("article-id")}
    years = {d.get("pub-type") or d.get("date-type") or "": int(d.findtext("year")) for d in root.iter("pub-date") if (d.findtext("year") or "").isdigit()}
    first = next((years[k] for k in ("epub", "pub", "ppub", "collection", *sorted(years)) if k in years), None)
    title = next((" ".join("".join(e.itertext()).split()) for e in root.iter("article-title")), None)
    licence = next((e.get("{http://www.w3.org/1999/xlink}href") or " ".join("".join(e.itertext()).split()) for e in root.iter("license")), None)
    pmcid = ids.get("pmc") or ids.get("pmcid")
    return {"pmcid": pmcid, "pmid": ids.get("pmid"), "doi": ids.get("doi"), "title": title, "year": first, "journal": jats.said(root.find(".//journal-title")) or None, "authors": jats.authors(root), "license": licence, "sections": jats.sections(root)}


@dataclass(frozen=True)
class Manifest:
    """What a frozen table was when it was written."""

    rows: int
    digest: str


def content_digest(rows: DataFrame) -> Manifest:
    """Number of rows and an order-free digest of all their values, aggregated on the executors."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{k}") for k in range(4)]
    got = rows.agg(F.count("*").alias("n"), *parts).collect()[0]
    return Manifest(got.n, "-".join(str(got[f"p{k}"] or 0) for k in range(4)))


def freeze(rows: DataFrame, path: str) -> Manifest:
    """Write a table once, atomically, with its manifest beside it; a table that is there is an error."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    made = content_digest(rows.sparkSession.read.parquet(f"{path}/rows"))
    rows.sparkSession.createDataFrame([(made.rows, made.digest)], "rows long, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return made


def verified(spark: SparkSession, path: str) -> DataFrame:
    """A frozen table, if it is still what its manifest says."""
    rows = spark.read.parquet(f"{path}/rows")
    said = spark.read.schema("rows long, digest string").json(f"{path}/manifest").collect()[0]
    if content_digest(rows) != Manifest(said.rows, said.digest):
        raise ValueError(f"{path} was changed after it was frozen")
    return rows


def store_absent(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Append rows whose keys aren't there yet; a key that is there with other values is an error."""
    spark = rows.sparkSession
    old = spark.read.parquet(path)
    clash = rows.join(old, key, "left_semi").exceptAll(old.join(rows.select(*key), key, "left_semi").select(*rows.columns)).limit(1).count()
    if clash:
        raise ValueError("a stored key has other values")
    rows.join(old.select(*key), key, "left_anti").dropDuplicates(key).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def replace_guarded(rows: DataFrame, path: str, replace: bool) -> None:
    """Load a table; one that is there is replaced only if asked."""
    rows.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def write_matrix(rows: DataFrame, key: str, vector: str, folder: str) -> int:
    """Vectors as .npy matrices, one for each partition, with their keys beside them; returns how many rows. The folder is shared
    by the driver and all executors, and a file is moved into place when it is whole."""

    folder = qualified(rows.sparkSession, folder)

    def work(batches):
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        keys, parts = [], []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            if batch.num_rows:
                parts.append(np.array(batch.column("vector").to_pylist(), np.float32))
        if keys:
            nth = TaskContext.get().partitionId()
            for name, data in ((f"keys-{nth:05d}", np.array(keys)), (f"matrix-{nth:05d}", np.concatenate(parts))):
                held = io.BytesIO()
                np.save(held, data, allow_pickle=False)
                part = f"{top}/{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(held.getvalue())
                fs.move(part, f"{top}/{name}.npy")
        yield pa.record_batch([pa.array([len(keys)], pa.int64())], ["n"])

    kept = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    return sum(r.n for r in kept.mapInArrow(work, "n long").collect())


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """key, vector of matrices that write_matrix wrote; each pair of files is read by one task."""
    folder = qualified(spark, folder)
    fs, top = pafs.FileSystem.from_uri(folder)
    names = sorted(x.base_name[7:-4] for x in fs.get_file_info(pafs.FileSelector(top)) if x.base_name.startswith("matrix-") and x.base_name.endswith(".npy"))

    def work(batches):
        reader, at = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                keys, matrix = (np.load(io.BytesIO(reader.open_input_file(f"{at}/{kind}-{name}.npy").readall()), allow_pickle=False) for kind in ("keys", "matrix"))
                if len(keys) != len(matrix):
                    raise ValueError(f"{name}: keys and matrix differ in length")
                for k in range(0, len(keys), 1024):
                    some = matrix[k : k + 1024]
                    yield pa.record_batch([pa.array(keys[k : k + 1024].astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(some.ravel()), some.shape[1]).cast(pa.list_(pa.float32()))], ["key", "vector"])

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return files.repartition(max(1, len(names))).mapInArrow(work, "key long, vector array<float>")


def relational(lines: DataFrame, schema: str, key: str, lists: list[str], column: str = "value") -> dict[str, DataFrame]:
    """JSON lines as tables: `rows` with the plain fields, and one table for each list with the key and the place of each item.

    A line that isn't of the schema stops the load.
    """
    read = F.from_json(column, schema)
    bad = F.raise_error(F.concat(F.lit("not of the schema: "), F.left(F.col(column), F.lit(80))))
    parsed = lines.withColumn("_r", read).where(F.when(F.try_parse_json(column).isNull() | F.col(f"_r.{key}").isNull(), bad.cast("boolean")).otherwise(True))
    fields = [f for f in parsed.select("_r.*").columns if f not in lists]
    out = {"rows": parsed.select(*[F.col(f"_r.{f}") for f in fields])}
    for name in lists:
        out[name] = parsed.select(F.col(f"_r.{key}"), F.posexplode(f"_r.{name}").alias("nth", "item"))
    return out
