"""Queries that run as streams over a table's files, and give what a batch over the whole table would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.plans.registry import query
from tallyhouse.sources.shared import new_folder
from tallyhouse.sources.tables import read
from tallyhouse.streaming import clarifications

DAYS = 86_400


def as_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; a pattern names a single file as well as a folder."""
    return spark.readStream.schema(read(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def finished(stream: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now, written exactly once; a given folder holds what earlier runs gave and where they ended."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, tag)
    key, path = "spark.sql.streaming.stateStore.providerClass", f"{folder}/rows"
    before = spark.conf.get(key)
    spark.conf.set(key, clarifications.STATE_STORE)
    try:
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(path)
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(path)


def actions(events: DataFrame) -> DataFrame:
    """Views ask, with as many options as the number in props says, clicks choose one by the same number."""
    k = F.get_json_object("props", "$.k").cast("int")
    options = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda x: x.cast("string")), lambda x: x.cast("int") <= k % 6)
    rows = events.where("event_type IN ('view', 'click')")
    kind = F.when(F.col("event_type") == "view", "ask").otherwise("choose")
    return rows.select(F.col("user_id").alias("owner"), F.col("event_id").alias("action_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), options.alias("options"), (k % 4 + 1).cast("string").alias("choice"))


@query("C12_clarifications", """WITH RECURSIVE a AS (
  SELECT user_id, event_id, epoch_us(ts) AS at, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events WHERE event_type IN ('view', 'click')),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS outcome,
    CAST([] AS STRUCT(token BIGINT, until BIGINT, options INT)[]) AS waiting, CAST(NULL AS STRUCT(token BIGINT, until BIGINT, options INT)) AS last
  FROM (SELECT DISTINCT user_id FROM a)
  UNION ALL
  SELECT user_id, i, event_id, kind, outcome,
    CASE WHEN kind = 'view' THEN CASE WHEN outcome = 'too_few_options' THEN waiting WHEN outcome = 'waiting' THEN list_append(live, asked) ELSE live END
      WHEN outcome IN ('taken', 'expired') THEN list_filter(waiting, lambda w: w.token <> last.token) ELSE waiting END,
    CASE WHEN outcome = 'waiting' THEN asked ELSE last END
  FROM (
    SELECT a.user_id, a.i, a.event_id, a.kind, s.waiting, s.last, list_filter(s.waiting, lambda w: w.until > a.at) AS live, {'token': a.event_id, 'until': a.at + 432000000000, 'options': a.k % 6} AS asked,
      CASE WHEN a.kind = 'view' THEN CASE WHEN a.k % 6 < 2 THEN 'too_few_options' WHEN len(list_filter(s.waiting, lambda w: w.until > a.at)) >= 2 THEN 'capacity_reached' ELSE 'waiting' END
        WHEN s.last IS NULL OR a.at >= s.last.until + 432000000000 THEN 'not_found' WHEN a.at >= s.last.until THEN 'expired'
        WHEN len(list_filter(s.waiting, lambda w: w.token = s.last.token)) = 0 THEN 'not_found' WHEN a.k % 4 + 1 > s.last.options THEN 'invalid_selection' ELSE 'taken' END AS outcome
    FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1))
SELECT user_id AS owner, event_id AS action_id, CASE kind WHEN 'view' THEN 'ask' ELSE 'choose' END AS kind, outcome FROM s WHERE i > 0""")
def clarified(spark: SparkSession, folder: str) -> DataFrame:
    """Questions wait five days, two of an owner at a time, and are remembered five days longer."""
    out = clarifications.clarified(actions(as_stream(spark, folder, "events")), seconds=5 * DAYS, most=2, remember=5 * DAYS)
    return finished(out, "clarifications").select("owner", "action_id", "kind", "outcome")
