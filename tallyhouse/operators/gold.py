"""Gold results recomputed for a table of cases at once, and nested values compared with a tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.operators import metrics, timeseries
from tallyhouse.operators.metrics import DAY_MICROS, micros, percent_change
from tallyhouse.sources.shared import written

#: The operations that a case may name.
OPERATIONS = (
    "session_summary", "longest_training_gap", "top_exercise_by_session_count", "e1rm_window_summary", "e1rm_peak_and_latest", "lineage_reconciliation", "e1rm_interval_summary", "weekly_load_comparison", "gap_e1rm_comparison", "outlier_record",
)
CASES = "case_id string, operation string, exercise string, n int, start_at timestamp_ntz, end_at timestamp_ntz, exercises array<string>, set_id string"


def flattened(rows: DataFrame, key: str, value: str, root: str = "expected") -> DataFrame:
    """key, path, kind, number, size, text of every value inside a JSON text: path is root, .name and [place]; a text that isn't JSON is of kind broken.

    All texts are taken apart together, one level of nesting after another, until none has a deeper one.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("case"), F.lit(root).alias("path"), F.try_parse_json(value).alias("v"), F.col(value).alias("said"))
    parts = []
    while True:
        schema = F.schema_of_variant("v")
        kind = (
            F.when(F.col("v").isNull(), "broken").when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "array").when(schema == "STRING", "string")
            .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number")
        )
        level = written(level.withColumn("kind", kind), "level")
        number = F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
        size = F.when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>")))
        parts.append(level.select("case", "path", "kind", number.alias("number"), size.alias("size"), F.coalesce(F.to_json("v"), "said").alias("text")))
        inner = level.where(F.col("kind").isin("object", "array")).select("case", "path", "v")
        if not inner.take(1):
            return reduce(lambda a, b: a.union(b), parts)
        step = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = step.select("case", F.concat("path", name).alias("path"), F.col("value").alias("v"), F.lit(None).cast("string").alias("said"))


def differences(pairs: DataFrame, key: str, expected: str, actual: str, tolerance: str) -> DataFrame:
    """key, path, problem, expected, actual: where an actual JSON value isn't what is expected, down to single numbers.

    Everything expected has to be there; what an actual object has besides doesn't matter. Lists have the
    same length. Numbers may differ by the case's tolerance, booleans are no numbers, and all else is
    equal. Of a value that is of another kind, or a list of another length, only that is told. Problems:
    broken, missing, kind, length, value. A null or broken expected text is broken.
    """
    e = flattened(pairs, key, expected).alias("e")
    a = flattened(pairs, key, actual).select("case", "path", *[F.col(c).alias(f"a_{c}") for c in ("kind", "number", "size", "text")])
    near = pairs.select(F.col(key).alias("case"), F.coalesce(F.col(tolerance), F.lit(0.0)).alias("_tolerance"))
    met = e.join(a, ["case", "path"], "left").join(near, "case")
    problem = (
        F.when((F.col("kind") == "broken") | (F.col("a_kind") == "broken"), "broken").when(F.col("a_kind").isNull(), "missing").when(F.col("kind") != F.col("a_kind"), "kind")
        .when((F.col("kind") == "array") & (F.col("size") != F.col("a_size")), "length").when((F.col("kind") == "number") & ~(F.abs(F.col("number") - F.col("a_number")) <= F.col("_tolerance")), "value")
        .when(F.col("kind").isin("string", "boolean") & (F.col("text") != F.col("a_text")), "value")
    )
    found = written(met.select("case", "path", "kind", problem.alias("problem"), F.col("text").alias("expected"), F.col("a_text").alias("actual")).where("problem IS NOT NULL"), "differences")
    # What lies inside a value that is told already is left out; few values are of another kind.
    outer = found.where((F.col("problem") != "value") & F.col("kind").isin("object", "array")).select(F.col("case").alias("_c"), F.col("path").alias("_p"))
    inside = (F.col("case") == F.col("_c")) & (F.startswith("path", F.concat("_p", F.lit("."))) | F.startswith("path", F.concat("_p", F.lit("["))))
    return found.join(outer, inside, "left_anti").select(F.col("case").alias(key), "path", "problem", "expected", "actual")


def _said(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def _first(rows: DataFrame, by: str, n: Column | int, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, at most n of them; `most` is the largest n, at which groups are cut before they are shuffled."""
    placed = rows.withColumn("_i", F.row_number().over(W.Window.partitionBy(by).orderBy(*order))).where(F.col("_i") <= most)
    return placed.where(F.col("_i") <= n)


def recomputed(cases: DataFrame, sets: DataFrame, lineage: DataFrame) -> DataFrame:
    """case_id, operation, actual (JSON), error of each case, every operation planned once for all of its cases.

    cases has the columns of CASES, sets are flagged sets, lineage has row_status. Errors:
    unknown_operation, not_enough_sessions (fewer than three in an interval), not_one_set, no_records.
    """
    of = lambda name: cases.where(F.col("operation") == name)
    sets = written(sets.select("set_id", "session_id", "exercise_name", "started_at", "set_order", "weight", "reps", "blocked", "outlier_reason", "in_volume", "in_e1rm"), "sets")
    bests = written(metrics.session_bests(sets).select("exercise_name", "session_id", "started_at", "best"), "bests")
    early, late = [F.col("started_at"), F.col("session_id")], [F.desc("started_at"), F.desc("session_id")]
    one = lambda rows, name: of(name).select("case_id").crossJoin(F.broadcast(rows))  # noqa: E731  one row
    out = []

    def told(rows: DataFrame, fields: dict[str, Column], error: Column | None = None) -> None:
        value = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
        bad = error if error is not None else F.lit(None).cast("string")
        # Each operation's results are written, as one plan of all ten would be planned anew after each of its many stages.
        out.append(written(rows.select("case_id", F.when(bad.isNull(), value).alias("actual"), bad.alias("error")), "results"))

    summary = sets.agg(F.count_distinct("session_id").alias("n"), F.min("started_at").alias("a"), F.max("started_at").alias("z"))
    told(one(summary, "session_summary"), {"session_count": F.col("n"), "first_session": _said(F.col("a")), "last_session": _said(F.col("z"))})

    # Neighbours within a day, and the last of a day with the first of the next one that has any, so that no task sorts all times.
    times = sets.select("started_at").distinct().withColumn("day", F.to_date("started_at"))
    within = times.withColumn("before", F.lag("started_at").over(W.Window.partitionBy("day").orderBy("started_at"))).select("before", "started_at")
    days = times.groupBy("day").agg(F.min("started_at").alias("first"), F.max("started_at").alias("last"))
    across = days.select(F.lag("last").over(W.Window.orderBy("day")).alias("before"), F.col("first").alias("started_at"))  # a row for each day
    gaps = within.union(across).where("before IS NOT NULL").withColumn("gap", micros("started_at") - micros("before"))
    longest = gaps.agg(F.max_by(F.struct("before", "started_at", "gap"), F.struct("gap", -micros("before"))).alias("g")).select("g.*")
    told(one(longest, "longest_training_gap"), {"previous_session": _said(F.col("before")), "next_session": _said(F.col("started_at")), "gap_days": F.col("gap") / DAY_MICROS, "calendar_day_difference": F.datediff(F.to_date("started_at"), F.to_date("before"))})

    top = sets.groupBy("exercise_name").agg(F.count_distinct("session_id").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("less"), "exercise_name")).alias("t"))
    told(one(top, "top_exercise_by_session_count"), {"exercise": F.col("t.exercise_name"), "session_count": -F.col("t.less")})

    window = of("e1rm_window_summary").select("case_id", F.col("exercise").alias("exercise_name"), F.coalesce("n", F.lit(5)).alias("n"))
    most = window.agg(F.coalesce(F.max("n"), F.lit(1))).collect()[0][0]
    counted = bests.groupBy("exercise_name").agg(F.count("*").alias("sessions"))
    side = lambda order, name: _first(bests, "exercise_name", most, order, most).join(window, "exercise_name").where(F.col("_i") <= F.col("n")).groupBy("case_id").agg(F.median("best").alias(name))
    rows = window.join(counted, "exercise_name", "left").join(side(early, "first"), "case_id", "left").join(side(late, "last"), "case_id", "left")
    fields = {"exercise": F.col("exercise_name"), "eligible_sessions": F.col("sessions"), "window_sessions": F.col("n"), "first_window_median_e1rm": F.col("first"), "last_window_median_e1rm": F.col("last"), "change_pct": percent_change(F.col("first"), F.col("last"))}
    told(rows, fields, F.when(F.col("sessions").isNull(), "no_records"))

    peaks = timeseries.peak_and_latest(bests, "exercise_name")
    rows = of("e1rm_peak_and_latest").select("case_id", F.col("exercise").alias("exercise_name")).join(peaks, "exercise_name", "left")
    fields = {"exercise": F.col("exercise_name"), "peak_e1rm": F.col("peak"), "peak_session": _said(F.col("peak_at")), "latest_e1rm": F.col("latest"), "latest_session": _said(F.col("latest_at")), "latest_vs_peak_pct": F.col("latest_vs_peak_pct")}
    told(rows, fields, F.when(F.col("peak").isNull(), "no_records"))

    status = lambda s: F.count_if(F.col("row_status") == s)
    lines = lineage.agg(F.count("*").alias("n"), status("kept").alias("k"), status("excluded_exact_duplicate").alias("d"), status("excluded_alias_shadow").alias("s"))
    told(one(lines, "lineage_reconciliation"), {"raw_lineage_rows": F.col("n"), "processed_rows": F.col("k"), "excluded_exact_duplicate_rows": F.col("d"), "excluded_alias_shadow_rows": F.col("s")})

    spans = of("e1rm_interval_summary").select("case_id", F.col("exercise").alias("exercise_name"), "start_at", "end_at")
    held = written(spans.join(bests, "exercise_name").where(F.col("started_at").between(F.col("start_at"), F.col("end_at"))), "held")
    totals = held.groupBy("case_id").agg(F.count("*").alias("sessions"), F.min("started_at").alias("a"), F.max("started_at").alias("z"), F.median("best").alias("level"), F.min("best").alias("low"), F.max("best").alias("high"))
    three = lambda order, name: _first(held, "case_id", 3, order, 3).groupBy("case_id").agg(F.median("best").alias(name))
    rows = spans.join(totals, "case_id", "left").join(three(early, "first"), "case_id", "left").join(three(late, "last"), "case_id", "left")
    fields = {
        "exercise": F.col("exercise_name"), "start": _said(F.col("a")), "end": _said(F.col("z")), "duration_days": F.floor((micros("z") - micros("a")) / DAY_MICROS), "session_count": F.col("sessions"), "start_3_session_median_e1rm": F.col("first"),
        "end_3_session_median_e1rm": F.col("last"), "change_pct": percent_change(F.col("first"), F.col("last")), "within_period_range_pct": 100 * (F.col("high") - F.col("low")) / F.col("level"),
    }
    told(rows, fields, F.when(F.coalesce("sessions", F.lit(0)) < 3, "not_enough_sessions"))

    weeks = of("weekly_load_comparison").select("case_id", F.col("exercise").alias("exercise_name"), F.to_date("start_at").alias("start_on"), F.to_date("end_at").alias("end_on"))
    loads = timeseries.periods_load(sets, weeks.select("exercise_name", "start_on", "end_on").distinct(), "exercise_name")
    part = lambda name, c: F.max(F.when(F.col("part") == name, F.col(c))).alias(f"{name}_{c}")
    wide = loads.groupBy("exercise_name", "start_on", "end_on").agg(*[part(p, c) for p in ("before", "during") for c in ("weeks", "mean_sets", "mean_volume", "mean_sessions")])
    rows = weeks.join(wide, ["exercise_name", "start_on", "end_on"], "left")
    fields = {"exercise": F.col("exercise_name")} | {f"{p}_{said}": F.coalesce(F.col(f"{p}_{c}"), F.lit(0)) if c == "weeks" else F.col(f"{p}_{c}").cast("double") for c, said in (("weeks", "week_count"), ("mean_volume", "weekly_volume_mean"), ("mean_sessions", "weekly_frequency_mean"), ("mean_sets", "weekly_sets_mean")) for p in ("before", "during")}
    told(rows, fields, F.when(F.col("during_weeks").isNull() & F.col("before_weeks").isNull(), "no_records"))

    pauses = of("gap_e1rm_comparison").select("case_id", "start_at", "end_at", F.coalesce("exercises", F.array().cast("array<string>")).alias("exercises"))
    asked = pauses.select("case_id", "start_at", "end_at", F.posexplode("exercises").alias("place", "exercise_name")).join(bests, "exercise_name")
    nearest = asked.groupBy("case_id", "start_at", "end_at", "place", "exercise_name").agg(
        F.max(F.when(F.col("started_at") <= F.col("start_at"), F.struct("started_at", "session_id", "best"))).alias("pre"), F.min(F.when(F.col("started_at") >= F.col("end_at"), F.struct("started_at", "session_id", "best"))).alias("post")
    )
    close = (micros("start_at") - micros(F.col("pre.started_at")) <= 60 * DAY_MICROS) & (micros(F.col("post.started_at")) - micros("end_at") <= 60 * DAY_MICROS)
    item = F.struct(F.col("exercise_name").alias("exercise"), _said(F.col("pre.started_at")).alias("pre_session"), _said(F.col("post.started_at")).alias("post_session"), F.col("pre.best").alias("pre_e1rm"), F.col("post.best").alias("post_e1rm"), percent_change(F.col("pre.best"), F.col("post.best")).alias("change_pct"))
    listed = nearest.where(close).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", item.alias("x")))).alias("l")).select("case_id", F.transform("l", lambda y: y["x"]).alias("l"))
    rows = pauses.join(listed, "case_id", "left").withColumn("l", F.coalesce("l", F.array().cast(listed.schema["l"].dataType)))
    told(rows, {"gap_start": _said(F.col("start_at")), "gap_end": _said(F.col("end_at")), "gap_days": (micros("end_at") - micros("start_at")) / DAY_MICROS, "comparisons": F.col("l")})

    wanted = of("outlier_record").select("case_id", "set_id")
    found = wanted.join(sets, "set_id", "left").groupBy("case_id").agg(F.count("started_at").alias("rows"), *[F.first(c).alias(c) for c in ("set_id", "exercise_name", "started_at", "weight", "reps", "blocked", "outlier_reason", "in_volume", "in_e1rm")])
    fields = {"set_id": F.col("set_id"), "exercise": F.col("exercise_name"), "session": _said(F.col("started_at")), "weight": F.col("weight"), "reps": F.col("reps"), "is_outlier": F.col("outlier_reason") != "", "outlier_reason": F.col("outlier_reason"), "include_in_volume_metrics": F.col("in_volume"), "include_in_e1rm": F.col("in_e1rm")}
    told(found, fields, F.when(F.col("rows") != 1, "not_one_set"))

    unknown = cases.where(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False))).select("case_id", F.lit(None).cast("string").alias("actual"), F.lit("unknown_operation").alias("error"))
    return cases.select("case_id", "operation").join(reduce(lambda x, y: x.union(y), out).union(unknown), "case_id")


def gold_problems(cases: DataFrame, sets: DataFrame, lineage: DataFrame) -> DataFrame:
    """case_id, operation, path, problem, expected, actual of cases (with expected, JSON, and tolerance) whose recomputed result is another one or an error."""
    cases = written(cases, "cases")
    made = written(recomputed(cases, sets, lineage).join(cases.select("case_id", "expected", "tolerance"), "case_id"), "recomputed")
    failed = made.where("error IS NOT NULL").select("case_id", "operation", F.lit("expected").alias("path"), F.col("error").alias("problem"), "expected", F.lit(None).cast("string").alias("actual"))
    return failed.union(differences(made.where("error IS NULL"), "case_id", "expected", "actual", "tolerance").join(made.select("case_id", "operation"), "case_id").select("case_id", "operation", "path", "problem", "expected", "actual"))
