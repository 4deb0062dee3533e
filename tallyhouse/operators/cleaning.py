"""Cleaning a raw log: flags, identities, representatives, lineage and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.numbers import json_scalar

EXTREME_WEIGHT, HIGH_REPS, E1RM_REPS = 1000, 25, (1, 12)


def any_negative() -> Column:
    return (F.col("weight") < 0) | (F.col("reps") < 0) | (F.col("distance") < 0) | (F.col("seconds") < 0)


def no_work_done() -> Column:
    return (F.col("weight") > 0) & (F.col("reps") == 0) & (F.col("distance") == 0) & (F.col("seconds") == 0)


def metric_blocked() -> Column:
    return (F.col("weight") >= EXTREME_WEIGHT) | no_work_done() | any_negative()


def outlier_reason() -> Column:
    """The rules that a set breaks, in a fixed order; high reps are told but don't block a metric."""
    rules = (
        (F.col("weight") >= EXTREME_WEIGHT, "extreme_weight_ge_1000"), (F.col("reps") >= HIGH_REPS, "high_reps_ge_25"),
        (no_work_done(), "positive_weight_zero_reps"), (any_negative(), "negative_numeric_value"), (F.col("set_order") <= 0, "non_positive_set_order"),
    )
    return F.concat_ws(";", *[F.when(broken, F.lit(name)) for broken, name in rules])


def in_volume() -> Column:
    return (F.col("weight") > 0) & (F.col("reps") > 0) & ~metric_blocked()


def in_e1rm() -> Column:
    return (F.col("weight") > 0) & F.col("reps").between(*E1RM_REPS) & ~metric_blocked()


def epley() -> Column:
    return F.col("weight") * (1 + F.col("reps") / 30.0)


def flagged(sets: DataFrame) -> DataFrame:
    return sets.withColumns({"blocked": metric_blocked(), "outlier_reason": outlier_reason(), "in_volume": in_volume(), "in_e1rm": in_e1rm()})


def digest(rows: DataFrame, *columns: str, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of a JSON array of the columns' values, without spaces, each as its type is written in JSON."""
    scalars = [json_scalar(F.col(c), rows.schema[c].dataType) for c in columns]
    return F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *scalars), F.lit("]")), 256), F.lit(length))


def lineage(raw: DataFrame, raw_key: list[str], set_key: list[str], row: str = "source_row") -> DataFrame:
    """Each raw row with its set's representative and what became of it.

    An exact duplicate repeats all raw columns of an earlier row; an alias shadow has another raw
    form of a set that an earlier row has; exact duplication is settled first. First rows are taken
    by partial aggregates over hashes of the keys and joined back, so that a row with a third of
    all copies is no task of its own: the join is split where it is skewed.
    """
    key = lambda columns: F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    rows = raw.withColumns({"_raw": key(raw_key), "_set": key(set_key)})
    first = lambda by, name: rows.groupBy(by).agg(F.min(row).alias(name))
    rows = rows.join(first("_raw", "first_raw"), "_raw").join(first("_set", "representative_row"), "_set")
    exact = F.col(row) != F.col("first_raw")
    status = F.when(exact, "excluded_exact_duplicate").when(F.col(row) != F.col("representative_row"), "excluded_alias_shadow").otherwise("kept")
    rows = rows.select(*raw.columns, "first_raw", "representative_row").withColumn("row_status", status)
    return rows.withColumn("raw_record_id", F.format_string("raw_%06d", F.col(row).cast("long"))).drop("first_raw")


def duplicate_counts(rows: DataFrame, set_key: list[str]) -> DataFrame:
    """For each set: raw rows, exact duplicates and alias shadows."""
    count = lambda s: F.count_if(F.col("row_status") == s)
    return rows.groupBy(*set_key).agg(F.count("*").alias("raw_rows"), count("excluded_exact_duplicate").alias("exact_duplicates"), count("excluded_alias_shadow").alias("alias_shadows"))


def collisions(sets: DataFrame) -> DataFrame:
    """Sets with how many of their session and exercise have the same place, and an id of such a group."""
    same = W.Window.partitionBy("session_id", "exercise_name", "set_order")
    rows = sets.withColumn("at_place", F.count("*").over(same))
    return rows.withColumn("has_collision", F.col("at_place") > 1).withColumn("collision_id", F.when(F.col("at_place") > 1, digest(sets, "session_id", "exercise_name", "set_order")))


def processed_reason() -> Column:
    """What a set's row says of its cleaning, each reason once."""
    told = F.concat(
        F.when(F.col("exact_duplicates") > 0, F.array(F.concat(F.lit("collapsed_exact_duplicates:"), F.col("exact_duplicates")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("alias_shadows") > 0, F.array(F.concat(F.lit("collapsed_alias_shadows:"), F.col("alias_shadows")))).otherwise(F.array().cast("array<string>")),
        F.filter(F.split("outlier_reason", ";"), lambda x: x != ""),
        F.when(F.col("has_collision"), F.array(F.lit("set_order_collision"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(F.array_distinct(told), ";")


def canonical_names(rows: DataFrame, aliases: DataFrame, name: str = "raw_name") -> DataFrame:
    """Rows with canonical_name: the target of a merge decision on the normalised name, or the name itself.

    Deferred and rejected decisions change nothing. Two targets of one name are an error.
    """
    merges = aliases.where(F.lower(F.trim("decision")) == "merge").groupBy(F.lower(F.trim("raw_name")).alias("_key")).agg(F.min("canonical_name").alias("_to"), F.count_distinct("canonical_name").alias("_n"))
    target = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("conflicting alias: "), F.col("_key"))).cast("string")).otherwise(F.col("_to"))
    joined = rows.join(merges, F.lower(F.trim(rows[name])) == merges["_key"], "left")
    return joined.withColumn("canonical_name", F.coalesce(target, F.col(name))).withColumn("alias_applied", F.col("_to").isNotNull()).drop("_key", "_to", "_n")


def alias_evidence(rows: DataFrame, name: str, same: list[str], least: int = 10, coverage: float = 0.5, high: float = 0.8) -> DataFrame:
    """name_a, name_b, pairs, coverage, high: pairs of names that stand on rows which are otherwise alike, nulls included.

    pairs counts the different rows that both have, coverage is their share of the rarer name's rows;
    pairs below `least` or `coverage` are left out. A row's names are gathered once each, so pairs are
    bounded by the names that one row can have.
    """
    names = rows.groupBy(*same).agg(F.array_sort(F.collect_set(name)).alias("x")).where(F.size("x") > 1)
    both = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct(a.alias("name_a"), b.alias("name_b")))))
    pairs = names.select(F.explode(both).alias("p")).groupBy("p.name_a", "p.name_b").agg(F.count("*").alias("pairs"))
    n = rows.groupBy(name).agg(F.count("*").alias("n"))
    out = pairs.join(n.select(F.col(name).alias("name_a"), F.col("n").alias("na")), "name_a").join(n.select(F.col(name).alias("name_b"), F.col("n").alias("nb")), "name_b")
    out = out.withColumn("coverage", F.col("pairs") / F.least("na", "nb")).where((F.col("pairs") >= least) & (F.col("coverage") >= coverage))
    return out.select("name_a", "name_b", "pairs", "coverage", (F.col("coverage") >= high).alias("high"))
