"""Metrics of a training log: estimated maxima, weeks, gaps and plateaus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.operators.cleaning import epley
from tallyhouse.sources.shared import written

DAY_MICROS = 86_400_000_000
PLATEAU_SESSIONS, PLATEAU_DAYS, PLATEAU_CHANGE, PLATEAU_RANGE = 8, 42, 2.5, 12.0


def micros(time: str | Column) -> Column:
    """Microseconds of a time without zone; sessions run in UTC."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def percent_change(start: Column, end: Column) -> Column:
    return 100.0 * (end / start - 1.0)


def week_of(time: str) -> Column:
    """Monday of a time's week, as a date."""
    return F.to_date(F.date_trunc("week", F.col(time)))


def session_bests(sets: DataFrame, by: str = "exercise_name") -> DataFrame:
    """Each session's best estimated maximum; of equal ones the first set by place and id."""
    rows = sets.where("in_e1rm").withColumn("e1rm", epley())
    first = F.min(F.struct((-F.col("e1rm")).alias("less"), "set_order", "set_id"))
    out = rows.groupBy(by, "session_id", "started_at").agg(first.alias("b"), F.count("*").alias("eligible_sets"))
    return out.select(by, "session_id", "started_at", (-F.col("b.less")).alias("best"), F.col("b.set_id").alias("source_set_id"), "eligible_sets")


def excluded_reasons(sets: DataFrame, eligible: str = "in_e1rm", otherwise: str = "not_eligible") -> DataFrame:
    """How many sets a metric leaves out, by their reason or a constant where they have none."""
    reason = F.coalesce(F.nullif(F.col("outlier_reason"), F.lit("")), F.lit(otherwise))
    return sets.where(~F.col(eligible)).groupBy(reason.alias("reason")).agg(F.count("*").alias("sets"))


def first_last_medians(bests: DataFrame, n: int = 5, by: str = "exercise_name") -> DataFrame:
    """Medians of the first and the last n sessions (which may overlap) and the change between them."""
    if not 1 <= n <= 50:
        raise ValueError("invalid_session_count")
    order = ["started_at", "session_id"]
    bests = written(bests.select(by, *order, "best"), "bests")  # looked at three times

    def side(name: str, *by_time: Column) -> DataFrame:
        # Ranked apart and cut at once, so that no task sorts more than n rows of each of its groups' parts.
        placed = bests.withColumn("_i", F.row_number().over(W.Window.partitionBy(by).orderBy(*by_time))).where(F.col("_i") <= n)
        return placed.groupBy(by).agg(F.median("best").alias(name))

    counted = bests.groupBy(by).agg(F.count("*").alias("sessions"))
    out = counted.join(side("first_median", *[F.col(c) for c in order]), by).join(side("last_median", *[F.desc(c) for c in order]), by)
    return out.withColumn("window", F.least(F.col("sessions"), F.lit(n))).withColumn("change_pct", percent_change(F.col("first_median"), F.col("last_median")))


def weekly_volume(sets: DataFrame, by: str = "exercise_name") -> DataFrame:
    """Weeks that have eligible sets: sets, reps and weight times reps. Weeks without any aren't filled in."""
    rows = sets.where("in_volume")
    return rows.groupBy(by, week_of("started_at").alias("week")).agg(F.count("*").alias("sets"), F.sum(F.col("reps").cast("long")).alias("reps"), F.sum(F.col("weight") * F.col("reps")).alias("volume"))


def weekly_frequency(sets: DataFrame, by: str = "exercise_name") -> DataFrame:
    return sets.groupBy(by, week_of("started_at").alias("week")).agg(F.count_distinct(F.struct("session_id", "started_at")).alias("sessions"))


def gaps(sessions: DataFrame, by: str, session: str | None = None) -> DataFrame:
    """Time between neighbouring sessions of a group: hours, whole days of 24 hours, and calendar days."""
    order = ["started_at", *([session] if session else [])]
    rows = sessions.select(by, *order).distinct().withColumn("previous", F.lag("started_at").over(W.Window.partitionBy(by).orderBy(*order))).where("previous IS NOT NULL")
    delta = micros("started_at") - micros("previous")
    return rows.select(by, "previous", "started_at", (delta / 3_600_000_000).alias("gap_hours"), F.floor(delta / DAY_MICROS).cast("long").alias("gap_days"), F.datediff(F.to_date("started_at"), F.to_date("previous")).cast("long").alias("calendar_days"))


def plateau_windows(series: DataFrame, by: str, value: str = "value") -> DataFrame:
    """All qualifying windows of neighbouring sessions: long enough, level enough, narrow enough.

    A window is a pair of sessions of one series. From each session on, one pass finds how far a
    window can reach: its span over its largest value is a lower bound of its range, and only
    grows. Rows carry that reach and not the series, and windows beyond it are never made.
    """
    whole = series.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("started_at", F.col(value).alias("v")))).alias("_s"))
    n = F.size("_s")
    starts = whole.where(n >= PLATEAU_SESSIONS).select(by, "_s", F.explode(F.sequence(F.lit(1), n - PLATEAU_SESSIONS + 1)).alias("i"))
    none = F.lit(None).cast("double")
    begin = F.struct(none.alias("top"), none.alias("low"), F.lit(0).alias("reach"), F.lit(True).alias("on"))

    def widen(a: Column, x: Column) -> Column:
        v = x["v"].cast("double")
        top, low = F.greatest(a["top"], v), F.least(a["low"], v)
        on = a["on"] & F.coalesce((top > 0) & (100.0 * (top - low) <= (PLATEAU_RANGE + 1e-6) * top), F.lit(False))
        return F.struct(top.alias("top"), low.alias("low"), (a["reach"] + on.cast("int")).alias("reach"), on.alias("on"))

    rest = F.slice("_s", F.col("i"), n - F.col("i") + 1)
    starts = starts.select(by, "i", F.slice("_s", F.col("i"), F.aggregate(rest, begin, widen)["reach"]).alias("_r")).where(F.size("_r") >= PLATEAU_SESSIONS)
    windows = starts.withColumn("_n", F.explode(F.sequence(F.lit(PLATEAU_SESSIONS), F.size("_r")))).withColumn("j", F.col("i") + F.col("_n") - 1)
    at = lambda k: F.element_at("_r", k - F.col("i") + 1)["started_at"]
    windows = windows.withColumn("days", F.floor((micros(at(F.col("j"))) - micros(at(F.col("i")))) / DAY_MICROS).cast("long")).where(F.col("days") >= PLATEAU_DAYS)
    windows = windows.withColumn("_w", F.transform(F.slice("_r", F.lit(1), F.col("_n")), lambda x: x["v"]))
    middle = lambda a: (F.element_at(F.array_sort(a), F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(F.array_sort(a), F.floor(F.size(a) / 2).cast("int") + 1)) / 2.0
    windows = windows.withColumns({"start_median": middle(F.slice("_w", 1, 3)), "end_median": middle(F.slice("_w", -3, 3)), "level": middle(F.col("_w"))})
    windows = windows.where("start_median > 0 AND level > 0")
    windows = windows.withColumns({"change_pct": percent_change(F.col("start_median"), F.col("end_median")), "range_pct": 100.0 * (F.array_max("_w") - F.array_min("_w")) / F.col("level")})
    windows = windows.where((F.abs("change_pct") <= PLATEAU_CHANGE) & (F.col("range_pct") <= PLATEAU_RANGE))
    return windows.select(by, "i", "j", at(F.col("i")).alias("start_at"), at(F.col("j")).alias("end_at"), "days", (F.col("j") - F.col("i") + 1).alias("sessions"), "start_median", "end_median", "change_pct", "range_pct")


def plateau_candidates(series: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Qualifying windows that don't overlap, longest first; the choice depends on earlier choices, so a series is one task."""
    windows = plateau_windows(series, by, value)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sessions", "days", "i"], ascending=[False, False, True])
        taken: list[tuple[int, int]] = []

        def fits(i: int, j: int) -> bool:
            return all(j < a or i > b for a, b in taken)

        keep = []
        for i, j in zip(rows["i"], rows["j"], strict=True):
            keep.append(fits(i, j))
            if keep[-1]:
                taken.append((i, j))
        return rows[keep]

    return windows.groupBy(by).applyInPandas(choose, windows.schema)


def integrity_violations(sets: DataFrame) -> DataFrame:
    """Sets whose stored flags contradict their values; they are reported and never mended."""
    e1rm = F.col("in_e1rm") & ~((F.col("weight") > 0) & F.col("reps").between(1, 12))
    volume = F.col("in_volume") & ~((F.col("weight") > 0) & (F.col("reps") > 0))
    return sets.agg(F.count_if(e1rm).alias("e1rm_flags"), F.count_if(volume).alias("volume_flags"), F.count_if(F.col("in_e1rm") & ~F.col("in_volume")).alias("e1rm_without_volume"))
