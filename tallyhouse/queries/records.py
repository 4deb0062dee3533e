"""Queries over the activity log: lookups, metrics and cleaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import cleaning, loading, metrics, records
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import SERIES, SETS, log_sets, period_series, read, user_sessions


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.flagged(log_sets(spark, folder))


def dates_as_text(rows: DataFrame) -> DataFrame:
    """Dates compare as text in any engine's results."""
    return rows.withColumns({c: F.col(c).cast("string") for c, kind in rows.dtypes if kind == "date"})


def r6(*columns: str):
    return {c: F.round(c, 6) for c in columns}


MEDIANS = SETS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at, session_id) AS i,
    row_number() OVER (PARTITION BY exercise_name ORDER BY started_at DESC, session_id DESC) AS j FROM bests
)
SELECT exercise_name, count(*)::BIGINT AS sessions, least(count(*), 5)::BIGINT AS "window", round(median(best) FILTER (i <= 5), 6) AS first_median,
  round(median(best) FILTER (j <= 5), 6) AS last_median, round(100.0::DOUBLE * (median(best) FILTER (j <= 5) / median(best) FILTER (i <= 5) - 1), 6) AS change_pct
FROM ranked GROUP BY exercise_name"""


@query("A5_first_last_medians", MEDIANS)
def first_last_medians(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.first_last_medians(metrics.session_bests(flagged(spark, folder)))
    return rows.withColumns(r6("first_median", "last_median", "change_pct")).withColumn("window", F.col("window").cast("long"))


@query("J1_set_details", SETS + "SELECT session_id, started_at, exercise_name, set_order, set_id, round(weight, 6) AS weight, reps, blocked, in_volume, in_e1rm, outlier_reason FROM eligible")
def set_details(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(spark, folder).select("session_id", "started_at", "exercise_name", "set_order", "set_id", F.round("weight", 6).alias("weight"), "reps", "blocked", "in_volume", "in_e1rm", "outlier_reason")


@query("P1_resolve_name", SETS + "SELECT exercise_name FROM sets WHERE lower(exercise_name) = 'brand#12' GROUP BY 1")
def resolve_name(spark: SparkSession, folder: str) -> DataFrame:
    return records.resolve_name(log_sets(spark, folder), " bRAND#12")


@query("P2_date_range", SETS + "SELECT set_id, started_at FROM sets WHERE started_at >= TIMESTAMP '1996-02-01' AND started_at < TIMESTAMP '1996-04-01'")
def date_range(spark: SparkSession, folder: str) -> DataFrame:
    return log_sets(spark, folder).where(records.in_dates("started_at", dt.date(1996, 2, 1), dt.date(1996, 3, 31))).select("set_id", "started_at")


@query("P6_blocked_sets", SETS + "SELECT blocked, outlier_reason, count(*)::BIGINT AS sets FROM eligible GROUP BY ALL")
def blocked_sets(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(spark, folder).groupBy("blocked", "outlier_reason").agg(F.count("*").alias("sets"))


@query("P8_P9_eligibility", SETS + "SELECT exercise_name, (count(*) FILTER (in_volume))::BIGINT AS volume_sets, (count(*) FILTER (in_e1rm))::BIGINT AS e1rm_sets FROM eligible GROUP BY 1")
def eligibility(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(spark, folder).groupBy("exercise_name").agg(F.count_if("in_volume").alias("volume_sets"), F.count_if("in_e1rm").alias("e1rm_sets"))


@query("A1_list_sessions", SETS + """SELECT session_id, started_at, count(DISTINCT set_id)::BIGINT AS set_count, count(DISTINCT exercise_name)::BIGINT AS exercise_count,
  array_to_string(list_sort(list(DISTINCT exercise_name)), '|') AS exercise_names FROM sets GROUP BY ALL""")
def list_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return records.sessions(log_sets(spark, folder))


@query("A1_sessions_of_one_exercise", SETS + """SELECT session_id, started_at, count(DISTINCT set_id)::BIGINT AS set_count, count(DISTINCT exercise_name)::BIGINT AS exercise_count,
  array_to_string(list_sort(list(DISTINCT exercise_name)), '|') AS exercise_names FROM sets WHERE exercise_name = 'Brand#12' GROUP BY ALL""")
def sessions_of_one(spark: SparkSession, folder: str) -> DataFrame:
    return records.sessions(log_sets(spark, folder).where("exercise_name = 'Brand#12'"))


@query("A2_date_bounds", SETS + "SELECT min(started_at)::DATE::VARCHAR AS first_date, max(started_at)::DATE::VARCHAR AS last_date FROM sets")
def date_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return dates_as_text(records.date_bounds(log_sets(spark, folder)))


@query("W7_first_and_last_sets", SETS + """, r AS (SELECT *, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at, set_order, set_id) AS i,
  row_number() OVER (PARTITION BY exercise_name ORDER BY started_at DESC, set_order DESC, set_id DESC) AS j FROM sets)
SELECT exercise_name, 'first' AS which, started_at, set_order, set_id, weight, reps FROM r WHERE i = 1
UNION ALL SELECT exercise_name, 'last', started_at, set_order, set_id, weight, reps FROM r WHERE j = 1""")
def first_and_last(spark: SparkSession, folder: str) -> DataFrame:
    return records.first_and_last(log_sets(spark, folder))


@query("O1_limited_records", SETS + """SELECT started_at, set_order, set_id, (count(*) OVER ()) >= 500 AS truncated
FROM (SELECT * FROM sets ORDER BY started_at, set_order, set_id LIMIT 500)""")
def limited_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.limited(log_sets(spark, folder), ["started_at", "set_order", "set_id"], 500).select("started_at", "set_order", "set_id", "truncated")


@query("O2_session_sets", SETS + "SELECT session_id, set_id, row_number() OVER (PARTITION BY session_id ORDER BY exercise_name, set_order, set_id)::INT AS nth FROM sets")
def session_sets(spark: SparkSession, folder: str) -> DataFrame:
    return loading.ranked_once(log_sets(spark, folder), ["session_id"], [F.col("exercise_name"), F.col("set_order"), F.col("set_id")], "nth").select("session_id", "set_id", "nth")


@query("U6_group_lookup", SETS + """, g AS (SELECT DISTINCT * FROM sets WHERE exercise_name IN ('Brand#12', 'Brand#34')),
o AS (SELECT count(*) AS n FROM (SELECT 1 FROM g GROUP BY session_id, started_at, set_order, weight, reps, distance, seconds, notes, workout_notes HAVING count(DISTINCT exercise_name) > 1))
SELECT set_id, exercise_name AS stored_name, 'Group' AS exercise_name, round(weight, 6) AS weight, o.n::BIGINT AS overlap FROM g, o""")
def group_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = records.group_lookup(log_sets(spark, folder), "Group", ["Brand#12", "Brand#34"])
    return rows.select("set_id", "stored_name", "exercise_name", F.round("weight", 6).alias("weight"), "overlap")


@query("A3_excluded_reasons", SETS + "SELECT coalesce(nullif(outlier_reason, ''), 'not_eligible') AS reason, count(*)::BIGINT AS sets FROM eligible WHERE NOT in_e1rm GROUP BY 1")
def excluded_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.excluded_reasons(flagged(spark, folder))


@query("A4_session_bests", SETS + "SELECT exercise_name, session_id, started_at, round(best, 6) AS best, source_set_id, eligible_sets::BIGINT AS eligible_sets FROM bests")
def session_bests(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.session_bests(flagged(spark, folder)).withColumns(r6("best"))


@query("A6_weekly_volume", SETS + """SELECT exercise_name, date_trunc('week', started_at)::DATE::VARCHAR AS week, count(*)::BIGINT AS sets, sum(reps)::BIGINT AS reps, round(sum(weight * reps), 4) AS volume
FROM eligible WHERE in_volume GROUP BY ALL""")
def weekly_volume(spark: SparkSession, folder: str) -> DataFrame:
    return dates_as_text(metrics.weekly_volume(flagged(spark, folder))).withColumn("volume", F.round("volume", 4))


@query("A7_weekly_frequency", SETS + "SELECT exercise_name, date_trunc('week', started_at)::DATE::VARCHAR AS week, count(DISTINCT (session_id, started_at))::BIGINT AS sessions FROM sets GROUP BY ALL")
def weekly_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return dates_as_text(metrics.weekly_frequency(log_sets(spark, folder)))


GAPS = """WITH s AS (SELECT DISTINCT user_id, ts AS started_at FROM events), g AS (SELECT *, lag(started_at) OVER (PARTITION BY user_id ORDER BY started_at) AS previous FROM s)
SELECT user_id, previous, started_at, round((epoch_us(started_at) - epoch_us(previous)) / 3600000000::DOUBLE, 6) AS gap_hours,
  ((epoch_us(started_at) - epoch_us(previous)) // 86400000000)::BIGINT AS gap_days, datediff('day', previous, started_at)::BIGINT AS calendar_days FROM g WHERE previous IS NOT NULL"""


@query("W2_training_gaps", GAPS)
def training_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.gaps(user_sessions(spark, folder), "user_id").withColumns(r6("gap_hours"))


WINDOWS = SERIES + """, a AS (SELECT series, list(started_at ORDER BY started_at) AS d, list(value ORDER BY started_at) AS v FROM series GROUP BY 1),
w AS (SELECT series, i, j, d[i] AS start_at, d[j] AS end_at, ((epoch_us(d[j]) - epoch_us(d[i])) // 86400000000)::BIGINT AS days, v[i:j] AS w
  FROM a, unnest(range(1, len(d) + 1)) x(i), unnest(range(1, len(d) + 1)) y(j) WHERE j >= i + 7),
m AS (SELECT *, list_median(w[1:3]) AS start_median, list_median(w[-3:]) AS end_median, list_median(w) AS level FROM w WHERE days >= 42),
q AS (SELECT *, 100.0::DOUBLE * (end_median / start_median - 1) AS change_pct, 100.0::DOUBLE * (list_max(w) - list_min(w)) / level AS range_pct FROM m WHERE start_median > 0 AND level > 0)
SELECT series, i::INT AS i, j::INT AS j, start_at, end_at, days, (j - i + 1)::INT AS sessions, round(start_median, 4) AS start_median, round(end_median, 4) AS end_median,
  round(change_pct, 6) AS change_pct, round(range_pct, 6) AS range_pct FROM q WHERE abs(change_pct) <= 2.5 AND range_pct <= 12"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start_median": F.round("start_median", 4), "end_median": F.round("end_median", 4), **r6("change_pct", "range_pct")}).withColumn("sessions", F.col("sessions").cast("int"))


@query("W6_plateau_windows", WINDOWS)
def plateau_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(metrics.plateau_windows(period_series(spark, folder), "series"))


#: Each series' windows by rank; the first is taken and those that overlap it go, until none is left.
CANDIDATES = WINDOWS.replace("WITH series AS", "WITH RECURSIVE series AS", 1).replace("SELECT series, i::INT AS i", ", found AS (SELECT series, i::INT AS i", 1) + """),
ranked AS (SELECT series, list(struct_pack(i := i, j := j) ORDER BY sessions DESC, days DESC, i) AS w FROM found GROUP BY 1),
taken AS (SELECT series, w[1] AS t, list_filter(w, lambda x: x.j < w[1].i OR x.i > w[1].j) AS rest FROM ranked
  UNION ALL SELECT series, rest[1], list_filter(rest, lambda x: x.j < rest[1].i OR x.i > rest[1].j) FROM taken WHERE len(rest) > 0)
SELECT f.* FROM found f JOIN taken k ON f.series = k.series AND f.i = k.t.i AND f.j = k.t.j"""


@query("W6_plateau_candidates", CANDIDATES)
def plateau_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(metrics.plateau_candidates(period_series(spark, folder), "series"))


@query("X10_integrity_violations", SETS + """SELECT (count(*) FILTER (in_e1rm AND NOT (weight > 0 AND reps BETWEEN 1 AND 12)))::BIGINT AS e1rm_flags,
  (count(*) FILTER (in_volume AND NOT (weight > 0 AND reps > 0)))::BIGINT AS volume_flags, (count(*) FILTER (in_e1rm AND NOT in_volume))::BIGINT AS e1rm_without_volume FROM eligible""")
def integrity(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.integrity_violations(flagged(spark, folder))


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw log rows: the whole row is the raw key, its lower-case text the set."""
    return read(spark, folder, "documents").select((F.col("doc_id") + 2).alias("source_row"), "text", F.lower("text").alias("set_text"))


RAW = """WITH raw AS (SELECT doc_id + 2 AS source_row, text, lower(text) AS set_text FROM documents),
l AS (SELECT *, min(source_row) OVER (PARTITION BY text) AS first_raw, min(source_row) OVER (PARTITION BY set_text) AS representative_row FROM raw),
s AS (SELECT *, CASE WHEN source_row <> first_raw THEN 'excluded_exact_duplicate' WHEN source_row <> representative_row THEN 'excluded_alias_shadow' ELSE 'kept' END AS row_status FROM l)
"""


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.lineage(raw_rows(spark, folder), ["text"], ["set_text"])


@query("W1_lineage", RAW + "SELECT source_row, representative_row, row_status, format('raw_{:06d}', source_row) AS raw_record_id FROM s")
def lineage_rows(spark: SparkSession, folder: str) -> DataFrame:
    return lineage(spark, folder).select("source_row", "representative_row", "row_status", "raw_record_id")


@query("A14_lineage_reconciliation", RAW + "SELECT row_status, count(*)::BIGINT AS n FROM s GROUP BY 1")
def lineage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lineage(spark, folder).groupBy("row_status").agg(F.count("*").alias("n"))


DUPLICATES = RAW + """SELECT representative_row, count(*)::BIGINT AS raw_rows, (count(*) FILTER (row_status = 'excluded_exact_duplicate'))::BIGINT AS exact_duplicates,
  (count(*) FILTER (row_status = 'excluded_alias_shadow'))::BIGINT AS alias_shadows FROM s GROUP BY 1"""


@query("A15_duplicate_counts", DUPLICATES)
def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.duplicate_counts(lineage(spark, folder), ["representative_row"])


@query("X1_reconciliation", RAW + """SELECT count(*)::BIGINT AS raw_rows, (count(*) FILTER (row_status = 'kept'))::BIGINT AS kept, count(DISTINCT set_text)::BIGINT AS sets,
  count(*) FILTER (row_status = 'kept') = count(DISTINCT set_text) AS kept_is_sets, count(*) FILTER (source_row < representative_row) = 0 AS representatives_come_first,
  count(DISTINCT source_row) = count(*) AS rows_are_unique FROM s""")
def reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.count_if(F.col("row_status") == "kept")
    return lineage(spark, folder).agg(
        F.count("*").alias("raw_rows"), kept.alias("kept"), F.count_distinct("set_text").alias("sets"), (kept == F.count_distinct("set_text")).alias("kept_is_sets"),
        (F.count_if(F.col("source_row") < F.col("representative_row")) == 0).alias("representatives_come_first"), (F.count_distinct("source_row") == F.count("*")).alias("rows_are_unique"),
    )


@query("J20_sets_with_lineage", RAW + """SELECT representative_row, '[' || string_agg('{"source_row":' || source_row || ',"row_status":"' || row_status || '"}', ',' ORDER BY source_row) || ']' AS lineage FROM s GROUP BY 1""")
def sets_with_lineage(spark: SparkSession, folder: str) -> DataFrame:
    rows = lineage(spark, folder)
    kept = rows.where("row_status = 'kept'").select("representative_row")
    return records.with_lineage(kept, rows, "representative_row")


@query("U1_exact_distinct", RAW + "SELECT source_row FROM s WHERE row_status <> 'excluded_exact_duplicate'")
def exact_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return lineage(spark, folder).where("row_status <> 'excluded_exact_duplicate'").select("source_row")


COLLISIONS = SETS + """SELECT set_id, at_place::BIGINT AS at_place, at_place > 1 AS has_collision,
  CASE WHEN at_place > 1 THEN left(sha256('[' || session_id || ',"' || exercise_name || '",' || set_order || ']'), 24) END AS collision_id
FROM (SELECT *, count(*) OVER (PARTITION BY session_id, exercise_name, set_order) AS at_place FROM sets)"""


@query("W9_F9_collisions", COLLISIONS)
def collisions(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.collisions(log_sets(spark, folder)).select("set_id", "at_place", "has_collision", "collision_id")


@query("Z1_processed_reasons", SETS + """, c AS (SELECT *, count(*) OVER (PARTITION BY session_id, exercise_name, set_order) AS n FROM eligible)
SELECT set_id, concat_ws(';', nullif(outlier_reason, ''), CASE WHEN n > 1 THEN 'set_order_collision' END) AS validation_reason FROM c""")
def processed_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = cleaning.collisions(flagged(spark, folder)).withColumns({"exact_duplicates": F.lit(0), "alias_shadows": F.lit(0)})
    return rows.select("set_id", cleaning.processed_reason().alias("validation_reason"))


ALIASES = [("brand#12", "Brand#11", "merge"), ("BRAND#34", "Brand#33", "merge"), ("Brand#51", "Brand#50", "defer"), ("Brand#52", "Brand#50", "reject")]


@query("J11_canonical_names", """SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#12' THEN 'Brand#11' WHEN 'brand#34' THEN 'Brand#33' ELSE p_brand END AS canonical_name,
  lower(p_brand) IN ('brand#12', 'brand#34') AS alias_applied FROM part""")
def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "raw_name string, canonical_name string, decision string")
    return cleaning.canonical_names(read(spark, folder, "part").withColumnRenamed("p_brand", "raw_name"), aliases).select("p_partkey", "canonical_name", "alias_applied")


@query("A16_alias_summary", """SELECT p_brand AS raw_name, CASE lower(p_brand) WHEN 'brand#12' THEN 'Brand#11' WHEN 'brand#34' THEN 'Brand#33' ELSE p_brand END AS canonical_name,
  bool_or(p_size > 25) AS any_large, count(*)::BIGINT AS n FROM part GROUP BY ALL""")
def alias_summary(spark: SparkSession, folder: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "raw_name string, canonical_name string, decision string")
    rows = cleaning.canonical_names(read(spark, folder, "part").withColumnRenamed("p_brand", "raw_name"), aliases)
    return rows.groupBy("raw_name", "canonical_name").agg(F.bool_or(F.col("p_size") > 25).alias("any_large"), F.count("*").alias("n"))
