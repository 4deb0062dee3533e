"""Series over calendar time: filled weeks, rolling values, outliers, neighbours in time, comparisons of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.operators.intervals import held_days
from tallyhouse.operators.metrics import DAY_MICROS, micros, percent_change, week_of


def filled_weeks(rows: DataFrame, by: str, week: str = "week", step: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Every week (or month) from a group's first to its last, with the group's values or null."""
    span = rows.groupBy(by).agg(F.min(week).alias("a"), F.max(week).alias("z"))
    every = span.select(by, F.explode(F.expr(f"sequence(a, z, {step})")).alias(week))
    return every.join(rows, [by, week], "left")


def weekly_metrics(sets: DataFrame, by: str) -> DataFrame:
    """by, week, sets, reps, volume (summed exactly, as decimals), sessions: eligible sets of each week from a group's first to its last, weeks without any as zero."""
    rows = sets.where("in_volume").groupBy(by, week_of("started_at").alias("week")).agg(F.count("*").alias("sets"), F.sum(F.col("reps").cast("long")).alias("reps"), F.sum((F.col("weight") * F.col("reps")).cast("decimal(18,6)")).alias("volume"), F.count_distinct("session_id").alias("sessions"))
    filled = filled_weeks(rows, by)
    zero = lambda c: F.coalesce(c, F.lit(0).cast(filled.schema[c].dataType)).alias(c)
    return filled.select(by, "week", *[zero(c) for c in ("sets", "reps", "volume", "sessions")])


def rolling_mean(value: str, by: str, order: str, rows: int = 4) -> Column:
    """Mean of a row and the rows - 1 before it, however few there are."""
    return F.avg(value).over(W.Window.partitionBy(by).orderBy(order).rowsBetween(1 - rows, 0))


def rolling_median(value: str, by: str, order: list[str], rows: int = 5, least: int = 3) -> Column:
    """Median of the last rows that have a value, null with fewer than `least`; percentile takes an ordered frame, median doesn't."""
    frame = W.Window.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) >= least, F.percentile(value, F.lit(0.5)).over(frame))


def robust_outliers(rows: DataFrame, by: str, value: str, least: int = 20, z: float = 12.0, ratio: float = 2.5, absolute: float = 1000.0) -> DataFrame:
    """Median and absolute deviation of a group, each row's robust z and ratio, and whether it is an outlier.

    Two aggregations and joins on the group's key instead of windows, so that a large group isn't one task.
    """
    middle = rows.groupBy(by).agg(F.median(value).alias("group_median"), F.count(value).alias("group_rows"))
    near = rows.join(middle, by)
    spread = near.groupBy(by).agg(F.median(F.abs(F.col(value) - F.col("group_median"))).alias("mad"))
    out = near.join(spread, by)
    out = out.withColumn("robust_z", F.try_divide(F.lit(0.6745) * (F.col(value) - F.col("group_median")), F.nullif(F.col("mad"), F.lit(0.0))))
    out = out.withColumn("median_ratio", F.try_divide(F.col(value), F.nullif(F.col("group_median"), F.lit(0.0))))
    far = (F.col("group_rows") >= least) & (F.col("robust_z") > z) & (F.col("median_ratio") > ratio)
    return out.withColumn("is_outlier", F.coalesce((F.col(value) >= absolute) | far, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, time: str, value: str, forward: bool = False, within_days: int = 60) -> DataFrame:
    """Each left row with the right row of its group that is nearest at or before `at` (or at or after it), if near enough.

    Both sides are laid into one sorted stream of a group and the last right row is carried along:
    one shuffle on the group and no pairs.
    """
    a = left.select(F.col(by).alias("_by"), (micros(at) * (-1 if forward else 1)).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(None).cast("long").alias("_rt"))
    b = right.select(F.col(by).alias("_by"), (micros(time) * (-1 if forward else 1)).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), micros(time).alias("_rt"))
    frame = W.Window.partitionBy("_by").orderBy("_t", "_side", F.desc("_v")).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_found", F.last(F.when(F.col("_side") == 0, F.struct("_rt", "_v")), ignorenulls=True).over(frame)).where("_side = 1")
    near = F.abs(F.col("_found._rt") - micros("_l." + at)) <= F.lit(within_days * DAY_MICROS)
    prefix = "after" if forward else "before"
    return rows.select("_l.*", F.when(near, F.timestamp_micros("_found._rt").cast("timestamp_ntz")).alias(f"{prefix}_at"), F.when(near, F.col("_found._v")).alias(f"{prefix}_value"))


def periods_load(sets: DataFrame, periods: DataFrame, by: str) -> DataFrame:
    """Mean weekly sets, volume and sessions before and during each period, weeks without any counting as zero.

    Volumes are summed exactly, as decimals. A period's own weeks are those that its start and end lie in, both included; the weeks before
    are as many days earlier and leave out the start. Weeks meet the periods that hold them by bins of time, however many there are.
    """
    weekly = sets.groupBy(by, week_of("started_at").alias("week")).agg(F.count_if("in_volume").alias("sets"), F.sum(F.when(F.col("in_volume"), (F.col("weight") * F.col("reps")).cast("decimal(18,6)")).otherwise(F.lit(0).cast("decimal(18,6)"))).alias("volume"), F.count_distinct("session_id").alias("sessions"))
    weekly = filled_weeks(weekly, by).na.fill(0, ["sets", "volume", "sessions"])
    days = F.greatest(F.datediff("end_on", "start_on"), F.lit(1))
    part = lambda name, first, last: F.struct(F.lit(name).alias("part"), F.expr(first).alias("first_on"), F.expr(last).alias("last_on"))
    spans = periods.select(by, "start_on", "end_on", F.date_sub("start_on", days).alias("before_on"))
    spans = spans.select(by, "start_on", "end_on", F.explode(F.array(part("during", "start_on", "end_on"), part("before", "before_on", "date_sub(start_on, 1)"))).alias("x")).select(by, "start_on", "end_on", "x.*")
    rows = held_days(weekly, spans, by, "week", "first_on", "last_on")
    return rows.groupBy(by, "start_on", "end_on", "part").agg(F.count("*").alias("weeks"), F.avg("sets").alias("mean_sets"), F.avg("volume").alias("mean_volume"), F.avg("sessions").alias("mean_sessions"))


def peak_and_latest(bests: DataFrame, by: str) -> DataFrame:
    """The first session of the largest best, the latest session, and how far the latest lies from the peak."""
    at = lambda value: F.struct(value, F.col("started_at"), F.col("session_id"))
    out = bests.groupBy(by).agg(F.min(at((-F.col("best")).alias("less"))).alias("p"), F.max(F.struct("started_at", "session_id", "best")).alias("l"))
    out = out.select(by, (-F.col("p.less")).alias("peak"), F.col("p.started_at").alias("peak_at"), F.col("l.best").alias("latest"), F.col("l.started_at").alias("latest_at"))
    return out.withColumn("latest_vs_peak_pct", percent_change(F.col("peak"), F.col("latest")))


def interval_summary(bests: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Sessions between two times: medians of the first and last three, change, range and whole days; fewer than three give none."""
    rows = bests.where(F.col("started_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    s = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("started_at", "session_id", "best"))).alias("_s")).where(F.size("_s") >= 3)
    v = F.transform("_s", lambda x: x["best"])
    sorted_ = F.array_sort(v)
    n = F.size(v)
    median = (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, F.floor(n / 2).cast("int") + 1)) / 2.0
    middle = lambda k: F.element_at(F.array_sort(F.slice(v, k, 3)), 2)
    out = s.select(by, n.alias("sessions"), middle(1).alias("start_median"), middle(-3).alias("end_median"), (100.0 * (F.array_max(v) - F.array_min(v)) / median).alias("range_pct"),
                   F.floor((micros(F.element_at("_s", -1)["started_at"]) - micros(F.element_at("_s", 1)["started_at"])) / DAY_MICROS).cast("long").alias("days"))
    return out.withColumn("change_pct", percent_change(F.col("start_median"), F.col("end_median")))


def recent_window(rows: DataFrame, time: str, weeks: int = 8) -> DataFrame:
    """Rows of the last weeks up to the last stored date, which the window is anchored at."""
    last = rows.agg(F.to_date(F.max(time)).alias("_last"))
    return rows.join(F.broadcast(last), (F.to_date(time) >= F.date_sub("_last", weeks * 7 - 1)) & (F.to_date(time) <= F.col("_last"))).drop("_last")  # one row
