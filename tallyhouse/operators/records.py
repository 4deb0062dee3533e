"""Looking up records: joins, ranges, sessions, first and last sets, groups of names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

LIMITS = (1, 5000)


def in_dates(column: str, start: dt.date | None = None, end: dt.date | None = None) -> Column:
    """Inclusive dates as a half-open range of times, which reaches the Parquet scan."""
    if start and end and start > end:
        raise ValueError("invalid_date_range")
    out = F.lit(True)
    if start:
        out &= F.col(column) >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")
    if end:
        out &= F.col(column) < F.lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
    return out


def resolve_name(names: DataFrame, wanted: str, column: str = "exercise_name") -> DataFrame:
    """The stored name that equals the wanted one but for case, if there is exactly one."""
    found = names.select(column).distinct().where(F.lower(column) == wanted.strip().lower())
    return found.withColumn("n", F.count("*").over(W.Window.partitionBy(F.lit(1)))).where("n = 1").drop("n")


def sessions(sets: DataFrame) -> DataFrame:
    """A row for each session of the sets given; a filter on exercises belongs before it and changes the counts.

    Sets are known by their ids. A session's names are gathered once, as few as its exercises, and counted from that.
    """
    rows = sets.groupBy("session_id", "started_at").agg(F.count_distinct("set_id").alias("set_count"), F.array_sort(F.collect_set("exercise_name")).alias("names"))
    return rows.select("session_id", "started_at", "set_count", F.size("names").cast("long").alias("exercise_count"), F.array_join("names", "|").alias("exercise_names"))


def limited(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in order with truncated: whether as many as the limit were there."""
    if not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError("invalid_limit")
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("truncated", F.count("*").over(W.Window.partitionBy(F.lit(1))) >= limit)


def date_bounds(sets: DataFrame) -> DataFrame:
    return sets.agg(F.to_date(F.min("started_at")).alias("first_date"), F.to_date(F.max("started_at")).alias("last_date"))


def first_and_last(sets: DataFrame, by: str = "exercise_name") -> DataFrame:
    """Each group's first and last set by time, place and id; one aggregation, no sort of the group."""
    key = F.struct("started_at", "set_order", "set_id")
    best = sets.groupBy(by).agg(F.min(F.struct(key.alias("k"), "weight", "reps")).alias("a"), F.max(F.struct(key.alias("k"), "weight", "reps")).alias("z"))
    each = best.select(by, F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("a").alias("r")), F.struct(F.lit("last").alias("which"), F.col("z").alias("r")))).alias("x"))
    return each.select(by, "x.which", "x.r.k.started_at", "x.r.k.set_order", "x.r.k.set_id", "x.r.weight", "x.r.reps")


def with_lineage(sets: DataFrame, lineage: DataFrame, key: str) -> DataFrame:
    """Sets with their raw rows as JSON in order; [] where there are none. Unselected, the join isn't run."""
    rows = lineage.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_row", "row_status"))).alias("rows"))
    return sets.join(rows, key, "left").withColumn("lineage", F.coalesce(F.to_json("rows"), F.lit("[]"))).drop("rows")


def group_lookup(sets: DataFrame, label: str, members: list[str]) -> DataFrame:
    """Sets of several names as one, each with its stored name; a set id once.

    overlap counts how many records stand under more than one name with the same values; metrics
    must not be computed while it isn't 0. Two contents of one set id are an error.
    """
    rows = sets.where(F.col("exercise_name").isin(members))
    values = ["session_id", "started_at", "set_order", "weight", "reps", "distance", "seconds", "notes", "workout_notes"]
    contents = F.struct("exercise_name", *values)
    once = rows.groupBy("set_id").agg(F.min(contents).alias("r"), F.count_distinct(contents).alias("n"))
    once = once.withColumn("set_id", F.when(F.col("n") > 1, F.raise_error(F.lit("one set id with two contents")).cast("string")).otherwise(F.col("set_id"))).select("set_id", "r.*")
    shared = once.groupBy(*values).agg(F.count_distinct("exercise_name").alias("names")).agg(F.count_if(F.col("names") > 1).alias("overlap"))
    return once.withColumn("stored_name", F.col("exercise_name")).withColumn("exercise_name", F.lit(label)).crossJoin(F.broadcast(shared))  # one row


def of_version(rows: DataFrame, version: str, column: str = "preprocessing_version") -> DataFrame:
    """Rows that one version of the preprocessing made; a condition on a stored column, so a scan skips other versions' files. A null version is none."""
    return rows.where(F.col(column) == F.lit(version))


def group_union(sets: DataFrame, members: list[str], by: str = "exercise_name") -> DataFrame:
    """The members' sets, each once, with place: its number in the order of time, session, place in it and id.

    What a group of exercises has within the rows given is one ordered answer, as long as the filter
    before it makes it.
    """
    rows = sets.where(F.col(by).isin(*members)).dropDuplicates(["set_id"])
    return rows.withColumn("place", F.row_number().over(W.Window.orderBy("started_at", "session_id", "set_order", "set_id")))
