"""Gold recomputed for a table of cases, and gold with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import gold
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import RAW, flagged, lineage
from tallyhouse.sources.shared import written
from tallyhouse.sources.tables import SETS

#: Two years, half a year and a pause that cases ask about, and how far a number may be off.
INTERVAL, HALF, PAUSE, TOLERANCE = ("1995-01-01", "1996-12-31"), ("1996-01-01", "1996-06-30"), ("1996-01-10", "1996-02-10"), 1e-6


def cases(sets: DataFrame) -> DataFrame:
    """Five cases for each exercise and five for the whole log; the number of sessions is the last digit of the exercise's name."""
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    none = {"exercise": F.lit(None).cast("string"), "n": F.lit(None).cast("int"), "start_at": F.lit(None).cast("timestamp_ntz"), "end_at": F.lit(None).cast("timestamp_ntz"), "exercises": F.lit(None).cast("array<string>"), "set_id": F.lit(None).cast("string")}
    one = lambda operation, **given: F.struct(F.lit(operation).alias("operation"), *[given.get(k, v).alias(k) for k, v in none.items()])
    name = F.col("exercise_name")
    each = sets.groupBy("exercise_name").agg(F.max_by("set_id", F.struct("weight", "set_id")).alias("heaviest"))
    each = each.select("exercise_name", F.explode(F.array(
        one("e1rm_window_summary", exercise=name, n=F.right(name, F.lit(1)).cast("int")), one("e1rm_peak_and_latest", exercise=name), one("e1rm_interval_summary", exercise=name, start_at=at(INTERVAL[0]), end_at=at(INTERVAL[1])),
        one("weekly_load_comparison", exercise=name, start_at=at(HALF[0]), end_at=at(HALF[1])), one("outlier_record", set_id=F.col("heaviest")),
    )).alias("x")).select(F.concat_ws("/", "x.operation", "exercise_name").alias("case_id"), "x.*")
    names = F.array_sort(F.collect_set("exercise_name"))  # the catalogue's names
    whole = sets.agg(names.alias("names")).select(F.explode(F.array(
        one("session_summary"), one("longest_training_gap"), one("top_exercise_by_session_count"), one("lineage_reconciliation"), one("gap_e1rm_comparison", start_at=at(PAUSE[0]), end_at=at(PAUSE[1]), exercises=F.col("names")), one("nothing"),
    )).alias("x")).select(F.col("x.operation").alias("case_id"), "x.*")
    return each.union(whole)


CASES = SETS.replace("WITH sets", "WITH RECURSIVE sets", 1) + ", " + RAW.removeprefix("WITH ") + f""", names AS (SELECT DISTINCT exercise_name AS e FROM sets),
t AS (SELECT started_at AS z, lag(started_at) OVER (ORDER BY started_at) AS a FROM (SELECT DISTINCT started_at FROM sets)),
r AS (SELECT exercise_name AS e, best, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at, session_id) AS i, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at DESC, session_id DESC) AS j, count(*) OVER (PARTITION BY exercise_name) AS n FROM bests),
w AS (SELECT e, any_value(n) AS n, median(best) FILTER (i <= right(e, 1)::INT) AS f, median(best) FILTER (j <= right(e, 1)::INT) AS l FROM r GROUP BY 1),
pk AS (SELECT exercise_name AS e, arg_min(struct_pack(b := best, s := started_at), (-best, started_at, session_id)) AS p, arg_max(struct_pack(b := best, s := started_at), (started_at, session_id)) AS l FROM bests GROUP BY 1),
h AS (SELECT exercise_name AS e, best, started_at, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at, session_id) AS i, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at DESC, session_id DESC) AS j
  FROM bests WHERE started_at BETWEEN TIMESTAMP '{INTERVAL[0]}' AND TIMESTAMP '{INTERVAL[1]}'),
iv AS (SELECT e, count(*) AS n, min(started_at) AS a, max(started_at) AS z, median(best) AS m, min(best) AS lo, max(best) AS hi, median(best) FILTER (i <= 3) AS f, median(best) FILTER (j <= 3) AS l FROM h GROUP BY 1 HAVING count(*) >= 3),
weekly AS (SELECT exercise_name AS e, date_trunc('week', started_at)::DATE AS week, count(*) FILTER (in_volume) AS sets, sum(CASE WHEN in_volume THEN (weight * reps)::DECIMAL(18, 6) ELSE 0 END) AS volume, count(DISTINCT session_id) AS sessions FROM eligible GROUP BY ALL),
filled AS (SELECT x.e, x.week, coalesce(y.sets, 0) AS sets, coalesce(y.volume, 0) AS volume, coalesce(y.sessions, 0) AS sessions
  FROM (SELECT e, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS week FROM weekly GROUP BY 1) x LEFT JOIN weekly y USING (e, week)),
parts AS (SELECT *, CASE WHEN week BETWEEN DATE '{HALF[0]}' AND DATE '{HALF[1]}' THEN 1 WHEN week >= DATE '{HALF[0]}' - (DATE '{HALF[1]}' - DATE '{HALF[0]}')::INT AND week < DATE '{HALF[0]}' THEN 0 END AS p FROM filled),
ld AS (SELECT e, count(*) FILTER (p = 0) AS bn, count(*) FILTER (p = 1) AS dn, (sum(volume) FILTER (p = 0))::DOUBLE / count(*) FILTER (p = 0) AS bv, (sum(volume) FILTER (p = 1))::DOUBLE / count(*) FILTER (p = 1) AS dv, avg(sessions) FILTER (p = 0) AS bf, avg(sessions) FILTER (p = 1) AS df,
  avg(sets) FILTER (p = 0) AS bs, avg(sets) FILTER (p = 1) AS ds FROM parts GROUP BY 1),
pre AS (SELECT exercise_name AS e, arg_max(struct_pack(b := best, s := started_at), (started_at, session_id)) AS x FROM bests WHERE started_at <= TIMESTAMP '{PAUSE[0]}' GROUP BY 1),
post AS (SELECT exercise_name AS e, arg_min(struct_pack(b := best, s := started_at), (started_at, session_id)) AS x FROM bests WHERE started_at >= TIMESTAMP '{PAUSE[1]}' GROUP BY 1),
near AS (SELECT e, pre.x AS a, post.x AS z FROM pre JOIN post USING (e) WHERE TIMESTAMP '{PAUSE[0]}' - pre.x.s <= INTERVAL 60 DAYS AND post.x.s - TIMESTAMP '{PAUSE[1]}' <= INTERVAL 60 DAYS),
hv AS (SELECT exercise_name AS e, arg_max(set_id, (weight, set_id)) AS set_id FROM sets GROUP BY 1),
actual AS (
  SELECT 'session_summary' AS case_id, json_object('session_count', count(DISTINCT session_id), 'first_session', strftime(min(started_at), '%Y-%m-%d %H:%M:%S'), 'last_session', strftime(max(started_at), '%Y-%m-%d %H:%M:%S')) AS j FROM sets
  UNION ALL (SELECT 'longest_training_gap', json_object('previous_session', strftime(a, '%Y-%m-%d %H:%M:%S'), 'next_session', strftime(z, '%Y-%m-%d %H:%M:%S'), 'gap_days', (epoch_us(z) - epoch_us(a)) / 86400000000.0::DOUBLE, 'calendar_day_difference', z::DATE - a::DATE) FROM t WHERE a IS NOT NULL ORDER BY z - a DESC, a LIMIT 1)
  UNION ALL (SELECT 'top_exercise_by_session_count', json_object('exercise', exercise_name, 'session_count', count(DISTINCT session_id)) FROM sets GROUP BY exercise_name ORDER BY count(DISTINCT session_id) DESC, exercise_name LIMIT 1)
  UNION ALL SELECT 'lineage_reconciliation', json_object('raw_lineage_rows', count(*), 'processed_rows', count(*) FILTER (row_status = 'kept'), 'excluded_exact_duplicate_rows', count(*) FILTER (row_status = 'excluded_exact_duplicate'), 'excluded_alias_shadow_rows', count(*) FILTER (row_status = 'excluded_alias_shadow')) FROM s
  UNION ALL SELECT 'gap_e1rm_comparison', json_object('gap_start', '{PAUSE[0]} 00:00:00', 'gap_end', '{PAUSE[1]} 00:00:00', 'gap_days', (DATE '{PAUSE[1]}' - DATE '{PAUSE[0]}')::DOUBLE, 'comparisons',
    coalesce((SELECT to_json(list(json_object('exercise', e, 'pre_session', strftime(a.s, '%Y-%m-%d %H:%M:%S'), 'post_session', strftime(z.s, '%Y-%m-%d %H:%M:%S'), 'pre_e1rm', a.b, 'post_e1rm', z.b, 'change_pct', 100 * (z.b / a.b - 1)) ORDER BY e)) FROM near), '[]'::JSON))
  UNION ALL SELECT 'e1rm_window_summary/' || e, json_object('exercise', e, 'eligible_sessions', n, 'window_sessions', right(e, 1)::INT, 'first_window_median_e1rm', f, 'last_window_median_e1rm', l, 'change_pct', 100 * (l / f - 1)) FROM w
  UNION ALL SELECT 'e1rm_peak_and_latest/' || e, json_object('exercise', e, 'peak_e1rm', p.b, 'peak_session', strftime(p.s, '%Y-%m-%d %H:%M:%S'), 'latest_e1rm', l.b, 'latest_session', strftime(l.s, '%Y-%m-%d %H:%M:%S'), 'latest_vs_peak_pct', 100 * (l.b / p.b - 1)) FROM pk
  UNION ALL SELECT 'e1rm_interval_summary/' || e, json_object('exercise', e, 'start', strftime(a, '%Y-%m-%d %H:%M:%S'), 'end', strftime(z, '%Y-%m-%d %H:%M:%S'), 'duration_days', (epoch_us(z) - epoch_us(a)) // 86400000000, 'session_count', n, 'start_3_session_median_e1rm', f, 'end_3_session_median_e1rm', l,
    'change_pct', 100 * (l / f - 1), 'within_period_range_pct', 100 * (hi - lo) / m) FROM iv
  UNION ALL SELECT 'weekly_load_comparison/' || e, json_object('exercise', e, 'before_week_count', bn, 'during_week_count', dn, 'before_weekly_volume_mean', bv, 'during_weekly_volume_mean', dv, 'before_weekly_frequency_mean', bf, 'during_weekly_frequency_mean', df, 'before_weekly_sets_mean', bs, 'during_weekly_sets_mean', ds) FROM ld
  UNION ALL SELECT 'outlier_record/' || hv.e, json_object('set_id', x.set_id, 'exercise', x.exercise_name, 'session', strftime(x.started_at, '%Y-%m-%d %H:%M:%S'), 'weight', x.weight, 'reps', x.reps, 'is_outlier', x.outlier_reason <> '', 'outlier_reason', x.outlier_reason, 'include_in_volume_metrics', x.in_volume, 'include_in_e1rm', x.in_e1rm)
  FROM hv JOIN eligible x ON x.set_id = hv.set_id)
"""


@query("E19_recomputed_gold", CASES + """SELECT a.case_id, replace(f.fullkey, '$', '') AS path, round(CASE WHEN f.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN f.atom::DOUBLE END, 6) AS number, CASE WHEN f.type IN ('VARCHAR', 'BOOLEAN') THEN json_extract_string(f.atom, '$') END AS text
FROM actual a, json_tree(a.j) f WHERE f.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def recomputed(spark: SparkSession, folder: str) -> DataFrame:
    """Every single value of all ten operations' results, all cases planned once."""
    sets = flagged(spark, folder)
    made = gold.recomputed(written(cases(sets), "cases"), sets, lineage(spark, folder))
    leaves = gold.flattened(made.where("error IS NULL"), "case_id", "actual", "").where("kind NOT IN ('object', 'array')")
    plain = F.when(F.col("kind") == "string", F.get_json_object(F.concat(F.lit("["), "text", F.lit("]")), "$[0]")).when(F.col("kind") == "boolean", F.col("text"))
    return leaves.select(F.col("case").alias("case_id"), "path", F.round("number", 6).alias("number"), plain.alias("text"))


@query("E19_F34_gold_problems", CASES + """SELECT a.case_id, p.path, p.problem FROM actual a, (VALUES ('e1rm_window_summary/', '2', 'expected.eligible_sessions', 'value'), ('e1rm_peak_and_latest/', '3', 'expected.unknown', 'missing'),
  ('outlier_record/', '4', 'expected.weight', 'kind'), ('e1rm_interval_summary/', '5', 'expected', 'broken'), ('weekly_load_comparison/', '1', 'expected.exercise', 'value')) p(operation, digit, path, problem)
WHERE starts_with(a.case_id, p.operation) AND right(a.case_id, 1) = p.digit
UNION ALL SELECT 'nothing', 'expected', 'unknown_operation' UNION ALL SELECT 'gap_e1rm_comparison', 'expected.comparisons', 'length'
UNION ALL SELECT 'e1rm_interval_summary/' || e, 'expected', 'not_enough_sessions' FROM names WHERE e NOT IN (SELECT e FROM iv)""")
def gold_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Stored results of which some have another number, one more field, a text for a number, broken JSON, another name or a longer list."""
    sets = flagged(spark, folder)
    rows = written(cases(sets), "cases")
    stored = gold.recomputed(rows, sets, lineage(spark, folder)).select("case_id", "actual")
    said = lambda operation, digit: F.startswith("case_id", F.lit(operation + "/")) & (F.right("case_id", F.lit(1)) == digit)
    changed = (
        F.when(said("e1rm_window_summary", "2"), F.regexp_replace("actual", r'"eligible_sessions":\d+', '"eligible_sessions":-1')).when(said("e1rm_peak_and_latest", "3"), F.concat(F.lit('{"unknown":1,'), F.substring("actual", F.lit(2), F.length("actual"))))
        .when(said("outlier_record", "4"), F.regexp_replace("actual", r'"weight":[^,]+', '"weight":"heavy"')).when(said("e1rm_interval_summary", "5"), F.substring("actual", F.lit(1), F.length("actual") - 1)).when(said("weekly_load_comparison", "1"), F.regexp_replace("actual", r'"exercise":"', '"exercise":"not '))
        .when(F.col("case_id") == "gap_e1rm_comparison", F.regexp_replace("actual", r'"comparisons":\[', '"comparisons":[{},')).otherwise(F.col("actual"))
    )
    gold_ = rows.join(stored.select("case_id", changed.alias("expected")), "case_id").withColumn("tolerance", F.lit(TOLERANCE))
    return gold.gold_problems(gold_, sets, lineage(spark, folder)).select("case_id", "path", "problem")
