"""Joining days with the intervals of days that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_days(days: DataFrame, intervals: DataFrame, by: str, day: str, start: str, end: str) -> DataFrame:
    """Each row of days with each interval of its group that holds its day, both ends included; columns of both.

    An interval belongs to the level whose bins are the shortest power of two that it fits in, so it
    meets at most two of them; a day falls into one bin of every level that there is. Bins meet by
    equality, and the exact condition then drops what only shares a bin. Rows grow with what the
    intervals hold, not with days times intervals, and a group is as many keys as it has bins. Rows with
    null days or ends, and intervals that end before they start, hold nothing. Columns of the two sides
    other than `by` have different names.
    """
    level = F.ceil(F.log2(F.greatest(F.datediff(end, start) + 1, F.lit(1)).cast("double"))).cast("int")
    bins = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    # One row for each power of two that an interval is as long as, at most some thirty.
    levels = [r[0] for r in bins.select("_level").distinct().collect()]
    if not levels:
        return days.join(intervals.drop(by), F.lit(False))
    shift = lambda c: F.expr(f"shiftright({c}, _level)")
    bins = bins.withColumns({"_first": F.unix_date(start), "_last": F.unix_date(end)}).withColumn("_bin", F.explode(F.sequence(shift("_first"), shift("_last")))).drop("_first", "_last")
    placed = days.where(F.col(day).isNotNull()).withColumns({"_day": F.unix_date(day), "_level": F.explode(F.array(*[F.lit(k) for k in sorted(levels)]))}).withColumn("_bin", shift("_day")).drop("_day")
    met = placed.join(bins, [by, "_level", "_bin"])
    return met.where((F.col(day) >= F.col(start)) & (F.col(day) <= F.col(end))).drop("_level", "_bin")
