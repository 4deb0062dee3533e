"""Queries over time series and summaries of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.operators import metrics, orderstats, timeseries
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import dates_as_text, flagged, r6
from tallyhouse.sources.tables import SETS, log_sets, read, user_sessions

WEEKLY = SETS + """, weekly AS (SELECT exercise_name, date_trunc('week', started_at)::DATE AS week, count(*)::BIGINT AS sets, sum(reps)::BIGINT AS reps FROM eligible WHERE in_volume GROUP BY ALL),
filled AS (SELECT e.exercise_name, e.week, coalesce(w.sets, 0) AS sets, coalesce(w.reps, 0) AS reps
  FROM (SELECT exercise_name, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS week FROM weekly GROUP BY 1) e LEFT JOIN weekly w USING (exercise_name, week))
"""


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.weekly_volume(flagged(spark, folder)).select("exercise_name", "week", "sets", "reps")
    return timeseries.filled_weeks(rows, "exercise_name").na.fill(0, ["sets", "reps"])


@query("A20_W3_filled_weeks", WEEKLY + "SELECT * REPLACE (week::VARCHAR AS week) FROM filled")
def filled_weeks(spark: SparkSession, folder: str) -> DataFrame:
    return dates_as_text(weekly(spark, folder))


@query("W4_rolling_mean", WEEKLY + "SELECT exercise_name, week::VARCHAR AS week, round(avg(sets) OVER (PARTITION BY exercise_name ORDER BY week ROWS 3 PRECEDING), 6) AS mean_sets FROM filled")
def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    return dates_as_text(weekly(spark, folder).select("exercise_name", "week", F.round(timeseries.rolling_mean("sets", "exercise_name", "week"), 6).alias("mean_sets")))


@query("W4_rolling_median", SETS + """SELECT exercise_name, session_id, CASE WHEN count(best) OVER w >= 3 THEN round(median(best) OVER w, 6) END AS rolling_median
FROM bests WINDOW w AS (PARTITION BY exercise_name ORDER BY started_at, session_id ROWS 4 PRECEDING)""")
def rolling_median(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.session_bests(flagged(spark, folder))
    return rows.select("exercise_name", "session_id", F.round(timeseries.rolling_median("best", "exercise_name", ["started_at", "session_id"]), 6).alias("rolling_median"))


@query("W5_robust_outliers", SETS + """, m AS (SELECT *, median(weight) OVER (PARTITION BY exercise_name) AS gm, count(weight) OVER (PARTITION BY exercise_name) AS n FROM sets),
d AS (SELECT *, median(abs(weight - gm)) OVER (PARTITION BY exercise_name) AS mad FROM m), z AS (SELECT *, 0.6745::DOUBLE * (weight - gm) / nullif(mad, 0) AS z, weight / nullif(gm, 0) AS r FROM d)
SELECT set_id, round(gm, 6) AS group_median, round(mad, 6) AS mad, round(z, 6) AS robust_z, round(r, 6) AS median_ratio,
  coalesce(weight >= 1000 OR (n >= 20 AND z > 12 AND r > 2.5), false) AS is_outlier FROM z""")
def robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    rows = timeseries.robust_outliers(log_sets(spark, folder), "exercise_name", "weight")
    return rows.select("set_id", "is_outlier", *[F.round(c, 6).alias(c) for c in ("group_median", "mad", "robust_z", "median_ratio")])


@query("A8_session_summary", SETS + "SELECT count(DISTINCT session_id)::BIGINT AS sessions, min(started_at) AS first_at, max(started_at) AS last_at FROM sets")
def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    return log_sets(spark, folder).agg(F.count_distinct("session_id").alias("sessions"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))


@query("A9_top_exercise", SETS + "SELECT exercise_name, count(DISTINCT session_id)::BIGINT AS sessions FROM sets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def top_exercise(spark: SparkSession, folder: str) -> DataFrame:
    return log_sets(spark, folder).groupBy("exercise_name").agg(F.count_distinct("session_id").alias("sessions")).orderBy(F.desc("sessions"), "exercise_name").limit(1)


@query("A11_peak_and_latest", SETS + """SELECT exercise_name, round(max(best), 6) AS peak, arg_min(started_at, (-best, started_at, session_id)) AS peak_at,
  round(arg_max(best, (started_at, session_id)), 6) AS latest, max(started_at) AS latest_at, round(100.0::DOUBLE * (arg_max(best, (started_at, session_id)) / max(best) - 1), 6) AS latest_vs_peak_pct FROM bests GROUP BY 1""")
def peak_and_latest(spark: SparkSession, folder: str) -> DataFrame:
    return timeseries.peak_and_latest(metrics.session_bests(flagged(spark, folder)), "exercise_name").withColumns(r6("peak", "latest", "latest_vs_peak_pct"))


@query("A12_interval_summary", SETS + """, a AS (SELECT exercise_name, list(best ORDER BY started_at, session_id) AS v, min(started_at) AS a, max(started_at) AS z
  FROM bests WHERE started_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1 HAVING count(*) >= 3)
SELECT exercise_name, len(v)::INT AS sessions, round(list_median(v[1:3]), 6) AS start_median, round(list_median(v[-3:]), 6) AS end_median, round(100.0::DOUBLE * (list_max(v) - list_min(v)) / list_median(v), 6) AS range_pct,
  ((epoch_us(z) - epoch_us(a)) // 86400000000)::BIGINT AS days, round(100.0::DOUBLE * (list_median(v[-3:]) / list_median(v[1:3]) - 1), 6) AS change_pct FROM a""")
def interval_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = timeseries.interval_summary(metrics.session_bests(flagged(spark, folder)), "exercise_name", "1995-01-01 00:00:00", "1996-12-31 00:00:00")
    return rows.withColumns(r6("start_median", "end_median", "range_pct", "change_pct"))


@query("A13_before_and_during", SETS + """, weekly AS (SELECT exercise_name, date_trunc('week', started_at)::DATE AS week, count(*) FILTER (in_volume) AS sets, sum(CASE WHEN in_volume THEN (weight * reps)::DECIMAL(18, 6) ELSE 0 END) AS volume,
  count(DISTINCT session_id) AS sessions FROM eligible GROUP BY ALL),
filled AS (SELECT e.exercise_name, e.week, coalesce(w.sets, 0) AS sets, coalesce(w.volume, 0) AS volume, coalesce(w.sessions, 0) AS sessions
  FROM (SELECT exercise_name, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS week FROM weekly GROUP BY 1) e LEFT JOIN weekly w USING (exercise_name, week)),
p AS (SELECT exercise_name, DATE '1996-01-01' AS start_on, DATE '1996-06-30' AS end_on FROM weekly GROUP BY 1),
parts AS (SELECT f.*, start_on, end_on, CASE WHEN week BETWEEN start_on AND end_on THEN 'during' WHEN week >= start_on - greatest(end_on - start_on, 1)::INT AND week < start_on THEN 'before' END AS part FROM filled f JOIN p USING (exercise_name))
SELECT exercise_name, start_on::VARCHAR AS start_on, end_on::VARCHAR AS end_on, part, count(*)::BIGINT AS weeks, round(avg(sets), 6) AS mean_sets, round((sum(volume) / count(*))::DOUBLE, 2) AS mean_volume, round(avg(sessions), 6) AS mean_sessions FROM parts WHERE part IS NOT NULL GROUP BY ALL""")
def before_and_during(spark: SparkSession, folder: str) -> DataFrame:
    rows = flagged(spark, folder)
    periods = rows.select("exercise_name").distinct().withColumns({"start_on": F.to_date(F.lit("1996-01-01")), "end_on": F.to_date(F.lit("1996-06-30"))})
    found = timeseries.periods_load(rows, periods, "exercise_name")
    return dates_as_text(found).withColumns({**r6("mean_sets", "mean_sessions"), "mean_volume": F.round(F.col("mean_volume").cast("double"), 2)})


ASOF = SETS + """, s AS (SELECT DISTINCT exercise_name, started_at, session_id FROM sets), l AS (SELECT exercise_name, lag(started_at) OVER (PARTITION BY exercise_name ORDER BY started_at, session_id) AS gap_start, started_at AS gap_end FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY exercise_name ORDER BY gap_end - gap_start DESC, gap_start) AS r FROM l WHERE gap_start IS NOT NULL),
d AS (SELECT exercise_name, started_at, max(best) AS best FROM bests GROUP BY ALL)
SELECT g.exercise_name, g.gap_start, g.gap_end,
  (SELECT round(arg_max(best, started_at), 6) FROM d WHERE d.exercise_name = g.exercise_name AND d.started_at <= g.gap_start AND g.gap_start - d.started_at <= INTERVAL 60 DAYS) AS before_value,
  (SELECT round(arg_min(best, started_at), 6) FROM d WHERE d.exercise_name = g.exercise_name AND d.started_at >= g.gap_end AND d.started_at - g.gap_end <= INTERVAL 60 DAYS) AS after_value
FROM g WHERE r <= 10"""


@query("J12_W11_gaps_with_neighbours", ASOF)
def gaps_with_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = log_sets(spark, folder).select("exercise_name", "started_at", "session_id").distinct()
    found = metrics.gaps(rows, "exercise_name", "session_id")
    top = W.Window.partitionBy("exercise_name").orderBy(F.desc("gap_hours"), "previous")
    ten = found.withColumn("r", F.row_number().over(top)).where("r <= 10").select("exercise_name", F.col("previous").alias("gap_start"), F.col("started_at").alias("gap_end"))
    bests = metrics.session_bests(flagged(spark, folder)).groupBy("exercise_name", "started_at").agg(F.max("best").alias("best"))
    out = timeseries.as_of(ten, bests, "exercise_name", "gap_start", "started_at", "best")
    out = timeseries.as_of(out, bests, "exercise_name", "gap_end", "started_at", "best", forward=True)
    return out.select("exercise_name", "gap_start", "gap_end", F.round("before_value", 6).alias("before_value"), F.round("after_value", 6).alias("after_value"))


@query("W12_recent_window", "SELECT event_id FROM events WHERE ts::DATE BETWEEN (SELECT max(ts)::DATE - 6 FROM events) AND (SELECT max(ts)::DATE FROM events)")
def recent_window(spark: SparkSession, folder: str) -> DataFrame:
    return timeseries.recent_window(read(spark, folder, "events"), "ts", weeks=1).select("event_id")


@query("A17_exercise_summary", SETS + """SELECT exercise_name, count(*)::BIGINT AS sets, count(DISTINCT started_at)::BIGINT AS sessions, count(DISTINCT started_at::DATE)::BIGINT AS days, min(started_at) AS first_at, max(started_at) AS last_at,
  (count(*) FILTER (weight > 0))::BIGINT AS positive_weight, (count(*) FILTER (in_e1rm))::BIGINT AS eligible_sets, (count(DISTINCT started_at) FILTER (in_e1rm))::BIGINT AS eligible_sessions, max(weight) AS max_weight, max(reps) AS max_reps,
  datediff('day', min(started_at), max(started_at))::BIGINT AS span_days, round((count(*) FILTER (in_e1rm)) / count(*)::DOUBLE, 6) AS eligible_ratio FROM eligible GROUP BY 1""")
def exercise_summary(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(spark, folder).groupBy("exercise_name").agg(
        F.count("*").alias("sets"), F.count_distinct("started_at").alias("sessions"), F.count_distinct(F.to_date("started_at")).alias("days"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"),
        F.count_if(F.col("weight") > 0).alias("positive_weight"), F.count_if("in_e1rm").alias("eligible_sets"), F.count_distinct(F.when(F.col("in_e1rm"), F.col("started_at"))).alias("eligible_sessions"),
        F.max("weight").alias("max_weight"), F.max("reps").alias("max_reps"), F.datediff(F.to_date(F.max("started_at")), F.to_date(F.min("started_at"))).cast("long").alias("span_days"),
        F.round(F.count_if("in_e1rm") / F.count("*"), 6).alias("eligible_ratio"),
    )


@query("A18_session_sizes", SETS + """, n AS (SELECT session_id, count(*)::DOUBLE AS n FROM sets GROUP BY 1)
SELECT median(n) AS median, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75, max(n)::BIGINT AS largest FROM n""")
def session_sizes(spark: SparkSession, folder: str) -> DataFrame:
    n = log_sets(spark, folder).groupBy("session_id").agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.25)).alias("p25"), F.percentile("n", F.lit(0.75)).alias("p75"), F.max("n").cast("long").alias("largest"))


@query("A19_session_metrics", SETS + """SELECT exercise_name, session_id, count(*)::BIGINT AS sets, sum(greatest(reps, 0))::BIGINT AS reps, round(sum(CASE WHEN in_volume THEN weight * reps ELSE 0 END), 6) AS volume, max(weight) AS top_weight,
  (count(*) FILTER (in_e1rm))::BIGINT AS eligible_sets, round(max(CASE WHEN in_e1rm THEN weight * (1 + reps / 30.0::DOUBLE) END), 6) AS best FROM eligible GROUP BY ALL""")
def session_metrics(spark: SparkSession, folder: str) -> DataFrame:
    from tallyhouse.operators.cleaning import epley

    return flagged(spark, folder).groupBy("exercise_name", "session_id").agg(
        F.count("*").alias("sets"), F.sum(F.greatest(F.col("reps"), F.lit(0)).cast("long")).alias("reps"), F.round(F.sum(F.when(F.col("in_volume"), F.col("weight") * F.col("reps")).otherwise(0.0)), 6).alias("volume"),
        F.max("weight").alias("top_weight"), F.count_if("in_e1rm").alias("eligible_sets"), F.round(F.max(F.when(F.col("in_e1rm"), epley())), 6).alias("best"),
    )


@query("A22_J14_alias_pairs", SETS + """, c AS (SELECT DISTINCT session_id, started_at, set_order, reps, notes, exercise_name FROM sets), n AS (SELECT exercise_name, count(*) AS n FROM sets GROUP BY 1),
p AS (SELECT a.exercise_name AS name_a, b.exercise_name AS name_b, count(*) AS pairs FROM c a JOIN c b USING (session_id, started_at, set_order, reps, notes) WHERE a.exercise_name < b.exercise_name GROUP BY ALL)
SELECT name_a, name_b, pairs::BIGINT AS pairs, round(pairs / least(x.n, y.n)::DOUBLE, 6) AS coverage FROM p JOIN n x ON x.exercise_name = name_a JOIN n y ON y.exercise_name = name_b""")
def alias_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of names that stand on rows which are otherwise alike."""
    rows, same = log_sets(spark, folder), ["session_id", "started_at", "set_order", "reps", "notes"]
    names = rows.groupBy(*same).agg(F.array_sort(F.collect_set("exercise_name")).alias("x")).where(F.size("x") > 1)
    # A group has each name once, so its pairs are bounded by the names that one place can have.
    pairs = names.select(F.explode(F.flatten(F.transform("x", lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct(a.alias("name_a"), b.alias("name_b")))))).alias("p"))
    pairs = pairs.groupBy("p.name_a", "p.name_b").agg(F.count("*").alias("pairs"))
    n = rows.groupBy("exercise_name").agg(F.count("*").alias("n"))
    out = pairs.join(n.select(F.col("exercise_name").alias("name_a"), F.col("n").alias("na")), "name_a").join(n.select(F.col("exercise_name").alias("name_b"), F.col("n").alias("nb")), "name_b")
    return out.select("name_a", "name_b", "pairs", F.round(F.col("pairs") / F.least("na", "nb"), 6).alias("coverage"))


@query("A23_profile", """SELECT count(*)::BIGINT AS n, (count(*) FILTER (l_quantity IS NULL))::BIGINT AS missing, count(DISTINCT l_quantity)::BIGINT AS distinct_values, quantile_cont(l_quantity, 0.01) AS p1, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem""")
def profile(spark: SparkSession, folder: str) -> DataFrame:
    c = "l_quantity"
    p = lambda x: F.percentile(c, F.lit(x))
    return read(spark, folder, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct_values"), p(0.01).alias("p1"), p(0.5).alias("p50"), p(0.99).alias("p99"))


@query("A24_duplicate_counts", """WITH g AS (SELECT text, count(*) AS n FROM documents GROUP BY 1)
SELECT coalesce(sum(n - 1), 0)::BIGINT AS extra, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS members, (count(*) FILTER (n > 1))::BIGINT AS groups FROM g""")
def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    g = read(spark, folder, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return g.agg(F.sum(F.col("n") - 1).alias("extra"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"), F.count_if(F.col("n") > 1).alias("groups"))


@query("A25_several_sessions_a_day", "SELECT user_id, ts::DATE::VARCHAR AS day, count(DISTINCT ts)::BIGINT AS sessions FROM events GROUP BY ALL HAVING count(DISTINCT ts) > 1")
def several_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return user_sessions(spark, folder).groupBy("user_id", F.to_date("started_at").alias("day")).agg(F.count("*").alias("sessions")).where("sessions > 1").withColumn("day", F.col("day").cast("string"))


@query("A26_reason_histogram", SETS + "SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(outlier_reason, ';')) AS reason FROM eligible) WHERE reason <> '' GROUP BY 1")
def reason_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(spark, folder).select(F.explode(F.split("outlier_reason", ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


@query("A34_A35_usage_by_node", """SELECT coalesce(event_type, 'all') AS node, count(*)::BIGINT AS calls, round(sum(value::DECIMAL(18, 6))::DOUBLE, 4) AS total, count(DISTINCT user_id)::BIGINT AS users
FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def usage_by_node(spark: SparkSession, folder: str) -> DataFrame:
    """Totals overall and by node from one pass."""
    rows = read(spark, folder, "events")
    return rows.rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("total"), F.count_distinct("user_id").alias("users")).select(F.coalesce("event_type", F.lit("all")).alias("node"), "calls", "total", "users")


@query("A31_A33_nearest_rank_p95", """SELECT event_type, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95))::INT + 1] AS p95, median(value) AS median FROM events GROUP BY 1""")
def nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The value at place min(n - 1, floor(0.95 n)) of the sorted values, which interpolates nothing, and the median."""
    return orderstats.nearest_ranks(read(spark, folder, "events"), ["event_type"], "value", {"p95": 0.95})


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("A23_all_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n, count(*) FILTER ({c} IS NULL)::BIGINT AS missing, count(DISTINCT {c})::BIGINT AS distinct_values, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, typeof(any_value({c})) IN ('DOUBLE', 'FLOAT') AS real FROM lineitem" for c in NUMBERS))
def all_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Each number column's profile from one pass."""
    rows = read(spark, folder, "lineitem")
    kinds = {f.name: f.dataType.simpleString() in ("double", "float") for f in rows.schema}
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct_values"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.lit(kinds[c]).alias("real"))
    return rows.agg(F.array(*[one(c) for c in NUMBERS]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("A25_time_conflicts", "SELECT ts::VARCHAR AS at, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY ts HAVING count(DISTINCT event_type) > 1")
def time_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Times that more than one kind of session claims."""
    found = read(spark, folder, "events").groupBy("ts").agg(F.count_distinct("event_type").alias("kinds")).where("kinds > 1")
    return found.select(F.col("ts").cast("string").alias("at"), "kinds")


@query("A33_usage_summary", """SELECT 'calls' AS name, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'failures', count(*)::BIGINT FROM events WHERE value < 0.1 UNION ALL SELECT 'fallback:' || event_type, count(*)::BIGINT FROM events WHERE value > 0.9 GROUP BY event_type""")
def usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, failures, and fallbacks by their reason, counted in one pass over names."""
    v = F.col("value")
    names = F.array_compact(F.array(F.lit("calls"), F.when(v < 0.1, "failures"), F.when(v > 0.9, F.concat(F.lit("fallback:"), "event_type"))))
    return read(spark, folder, "events").select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


VIEWS = SETS + """, v AS (SELECT 'raw' AS v, session_id, count(*)::DOUBLE AS n FROM sets GROUP BY 2 UNION ALL SELECT 'distinct', session_id, count(DISTINCT (exercise_name, set_order, weight, reps))::DOUBLE FROM sets GROUP BY 2
UNION ALL SELECT 'adjusted', session_id, count(DISTINCT (left(exercise_name, 7), set_order, weight, reps))::DOUBLE FROM sets GROUP BY 2)
SELECT v AS view, median(n) AS median, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75, max(n)::BIGINT AS largest FROM v GROUP BY 1"""


@query("A18_session_views", VIEWS)
def session_views(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of a session as they are, without repeats, and with names that are joined by their first letters."""
    rows = log_sets(spark, folder)
    distinct = lambda name: F.count_distinct(F.struct(name.alias("a"), "set_order", "weight", "reps")).cast("double")
    sizes = rows.groupBy("session_id").agg(F.count("*").cast("double").alias("raw"), distinct(F.col("exercise_name")).alias("distinct"), distinct(F.left("exercise_name", F.lit(7))).alias("adjusted"))
    long = sizes.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("n")) for v in ("raw", "distinct", "adjusted")])).alias("x")).select("x.*")
    p = lambda x: F.percentile("n", F.lit(x))
    return long.groupBy("view").agg(p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.max("n").cast("long").alias("largest"))


@query("J10_null_safe_collisions", """WITH s AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS a, nullif(l_linestatus, 'O') AS b, l_partkey FROM lineitem), c AS (SELECT l_orderkey, a, b, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1)
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, c.n::BIGINT AS n FROM s JOIN c ON s.l_orderkey = c.l_orderkey AND s.a IS NOT DISTINCT FROM c.a AND s.b IS NOT DISTINCT FROM c.b""")
def null_safe_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose order has others with the same flags, missing flags being values too."""
    s = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("a"), F.nullif("l_linestatus", F.lit("O")).alias("b"), "l_partkey")
    c = s.groupBy("l_orderkey", "a", "b").agg(F.count("*").alias("n")).where("n > 1").toDF("o", "ca", "cb", "n")
    return s.join(c, (s.l_orderkey == c.o) & s.a.eqNullSafe(c.ca) & s.b.eqNullSafe(c.cb)).select("l_orderkey", "l_linenumber", "l_partkey", "n")
