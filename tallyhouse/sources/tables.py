"""Tables of a folder as the engine's logical views, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_sets(spark: SparkSession, folder: str) -> DataFrame:
    """One logical set for each order line: who lifts what in which session."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    parts = read(spark, folder, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return rows.select(
        F.col("l_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), F.col("p_brand").alias("exercise_name"),
        F.col("l_linenumber").alias("set_order"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("set_id"),
        (F.col("l_extendedprice") / 100).alias("weight"), F.col("l_quantity").cast("int").alias("reps"),
        F.lit(0.0).alias("distance"), F.lit(0).alias("seconds"), F.col("l_returnflag").alias("notes"), F.col("l_linestatus").alias("workout_notes"),
    )


#: The same view for the second engine; queries begin with it.
SETS = """
WITH sets AS (
  SELECT l_orderkey AS session_id, o_orderdate AS started_at, p_brand AS exercise_name, l_linenumber AS set_order,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS set_id, l_extendedprice / 100 AS weight, l_quantity::INT AS reps,
    0.0::DOUBLE AS distance, 0 AS seconds, l_returnflag AS notes, l_linestatus AS workout_notes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), flagged AS (
  SELECT *, (weight >= 1000 OR (weight > 0 AND reps = 0 AND distance = 0 AND seconds = 0) OR weight < 0 OR reps < 0 OR distance < 0 OR seconds < 0) AS blocked
  FROM sets
), eligible AS (
  SELECT *, (weight > 0 AND reps > 0 AND NOT blocked) AS in_volume, (weight > 0 AND reps BETWEEN 1 AND 12 AND NOT blocked) AS in_e1rm,
    concat_ws(';', CASE WHEN weight >= 1000 THEN 'extreme_weight_ge_1000' END, CASE WHEN reps >= 25 THEN 'high_reps_ge_25' END,
      CASE WHEN weight > 0 AND reps = 0 AND distance = 0 AND seconds = 0 THEN 'positive_weight_zero_reps' END,
      CASE WHEN weight < 0 OR reps < 0 OR distance < 0 OR seconds < 0 THEN 'negative_numeric_value' END,
      CASE WHEN set_order <= 0 THEN 'non_positive_set_order' END) AS outlier_reason
  FROM flagged
), bests AS (
  SELECT exercise_name, session_id, started_at, max(weight * (1 + reps / 30.0::DOUBLE)) AS best,
    arg_min(set_id, (-(weight * (1 + reps / 30.0::DOUBLE)), set_order, set_id)) AS source_set_id, count(*) AS eligible_sets
  FROM eligible WHERE in_e1rm GROUP BY ALL
)
"""


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (user, time) pairs of the event log: sessions with gaps of hours and days."""
    return read(spark, folder, "events").select("user_id", F.col("ts").alias("started_at")).distinct()


def period_series(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order price for each status and quarter, as a series of session bests."""
    orders = read(spark, folder, "orders")
    start = F.date_trunc("quarter", F.col("o_orderdate")).cast("timestamp_ntz")
    return orders.groupBy(F.col("o_orderstatus").alias("series"), start.alias("started_at")).agg(F.avg(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("value"))


SERIES = """
WITH series AS (
  SELECT o_orderstatus AS series, date_trunc('quarter', o_orderdate)::TIMESTAMP AS started_at, (sum(o_totalprice::DECIMAL(18, 4)) / count(*))::DOUBLE AS value
  FROM orders GROUP BY ALL
)
"""


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.col("lang").alias("section"), "text")
