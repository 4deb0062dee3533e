"""Log operators on rows written out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tallyhouse.queries  # noqa: F401
from tallyhouse.operators import cleaning, metrics, records, timeseries
from tallyhouse.plans.engine import Engine
from tallyhouse.plans.registry import QUERIES

DAY = dt.datetime(2024, 1, 1, 10)
KIND = "session_id string, started_at timestamp_ntz, exercise_name string, set_order int, set_id string, weight double, reps int, distance double, seconds int, notes string, workout_notes string"


def sets(spark, rows):
    """rows: (days after the first, name, place, weight, reps)."""
    out = [(f"s{d}", DAY + dt.timedelta(days=d), n, o, f"{d}-{o}-{n}", float(w), r, 0.0, 0, None, None) for d, n, o, w, r in rows]
    return cleaning.flagged(spark.createDataFrame(out, KIND))


def test_epley_and_exclusions(spark):
    rows = sets(spark, [(0, "a", 1, 100, 5), (0, "a", 2, 1000, 3), (0, "a", 3, 80, 0)])
    best = metrics.session_bests(rows).collect()
    assert len(best) == 1 and best[0].best == pytest.approx(116.6667, abs=1e-4) and best[0].eligible_sets == 1
    assert {r.reason: r.sets for r in metrics.excluded_reasons(rows).collect()} == {"extreme_weight_ge_1000": 1, "positive_weight_zero_reps": 1}


def test_many_reps_keep_volume(spark):
    row = sets(spark, [(0, "a", 1, 20, 30)]).collect()[0]
    assert row.outlier_reason == "high_reps_ge_25" and row.in_volume and not row.in_e1rm


def test_first_of_equal_bests(spark):
    assert metrics.session_bests(sets(spark, [(0, "a", 2, 100, 5), (0, "a", 1, 100, 5)])).collect()[0].source_set_id == "0-1-a"


def test_weeks_and_gaps(spark):
    rows = sets(spark, [(7 * k, "a", 1, 100, 5) for k in range(6)])
    assert metrics.weekly_volume(rows).count() == 6
    assert {r.sessions for r in metrics.weekly_frequency(rows).collect()} == {1}
    found = metrics.gaps(rows, "exercise_name", "session_id").collect()
    assert len(found) == 5 and {(r.gap_days, r.calendar_days, r.gap_hours) for r in found} == {(7, 7, 168.0)}


def test_days_differ_from_calendar_days(spark):
    times = [(1, dt.datetime(2024, 1, 1, 23)), (1, dt.datetime(2024, 1, 2, 1))]
    row = metrics.gaps(spark.createDataFrame(times, "u int, started_at timestamp_ntz"), "u").collect()[0]
    assert (row.gap_days, row.calendar_days) == (0, 1)


def test_flat_series_is_one_plateau(spark):
    rows = metrics.session_bests(sets(spark, [(7 * k, "a", 1, 100, 5) for k in range(8)]))
    found = metrics.plateau_candidates(rows, "exercise_name", "best").collect()
    assert len(found) == 1 and found[0].days == 49 and found[0].sessions == 8


def test_plateaus_against_brute_force(spark):
    import statistics

    values = [100 + (k * 37 % 11) for k in range(30)]
    series = [("x", DAY + dt.timedelta(days=6 * k), float(v)) for k, v in enumerate(values)]
    got = {(r.i - 1, r.j - 1) for r in metrics.plateau_windows(spark.createDataFrame(series, "s string, started_at timestamp_ntz, value double"), "s").collect()}
    want = set()
    for i in range(30):
        for j in range(i + 7, 30):
            w = values[i : j + 1]
            a, z, m = statistics.median(w[:3]), statistics.median(w[-3:]), statistics.median(w)
            if 6 * (j - i) >= 42 and abs(100 * (z / a - 1)) <= 2.5 and 100 * (max(w) - min(w)) / m <= 12:
                want.add((i, j))
    assert got == want and want


def test_windows_may_overlap(spark):
    row = metrics.first_last_medians(metrics.session_bests(sets(spark, [(k, "a", 1, 100 + k, 1) for k in range(3)])), 5).collect()[0]
    assert row.first_median == row.last_median and row.window == 3
    with pytest.raises(ValueError):
        metrics.first_last_medians(sets(spark, []), 0)


def test_lineage_settles_exact_copies_first(spark):
    raw = spark.createDataFrame([(2, "A", "a"), (3, "A", "a"), (4, "a", "a"), (5, "b", "b")], "source_row long, raw string, name string")
    rows = {r.source_row: (r.row_status, r.representative_row) for r in cleaning.lineage(raw, ["raw"], ["name"]).collect()}
    assert rows == {2: ("kept", 2), 3: ("excluded_exact_duplicate", 2), 4: ("excluded_alias_shadow", 2), 5: ("kept", 5)}


def test_conflicting_aliases_fail(spark):
    names = spark.createDataFrame([("x",)], "raw_name string")
    aliases = spark.createDataFrame([("x", "a", "merge"), ("X", "b", "merge")], "raw_name string, canonical_name string, decision string")
    with pytest.raises(Exception, match="conflicting alias"):
        cleaning.canonical_names(names, aliases).collect()


def test_group_overlap_is_told(spark):
    rows = records.group_lookup(sets(spark, [(0, "a", 1, 50, 5), (0, "b", 1, 50, 5), (1, "b", 1, 60, 5)]), "ab", ["a", "b"]).collect()
    assert len(rows) == 3 and {r.overlap for r in rows} == {1}


def test_rolling_median_needs_three(spark):
    rows = spark.createDataFrame([("x", k, v) for k, v in enumerate([1.0, None, 3.0, 5.0])], "g string, k int, v double")
    got = [r.m for r in rows.select("k", timeseries.rolling_median("v", "g", ["k"]).alias("m")).orderBy("k").collect()]
    assert got == [None, None, None, 3.0]


def test_as_of_both_ways(spark):
    at = lambda d: DAY + dt.timedelta(days=d)
    left = spark.createDataFrame([("x", at(10)), ("x", at(200))], "g string, t timestamp_ntz")
    right = spark.createDataFrame([("x", at(9), 1.0), ("x", at(10), 2.0), ("x", at(12), 3.0)], "g string, t timestamp_ntz, v double")
    back = {r.t: r.before_value for r in timeseries.as_of(left, right, "g", "t", "t", "v").collect()}
    ahead = {r.t: r.after_value for r in timeseries.as_of(left, right, "g", "t", "t", "v", forward=True).collect()}
    assert back == {at(10): 2.0, at(200): None} and ahead == {at(10): 2.0, at(200): None}


def test_engine(spark):
    e = Engine(spark, sets(spark, [(k, "Press", 1, 100, 5) for k in range(3)]))
    assert e.run("weekly_volume", "press").status == "ok"
    assert e.run("weekly_volume", "press", start=dt.date(2030, 1, 1)).status == "empty"
    assert e.run("weekly_volume", start=dt.date(2024, 2, 1), end=dt.date(2024, 1, 1)).error == "invalid_date_range"
    assert e.run("nothing").error == "unknown_operation" and e.run("exercise_records", "none").error == "unknown_exercise"
    assert e.run("exercise_records", limit=2).rows.select(F.max("truncated")).collect()[0][0]


def test_months_of_all_orders_are_filled(spark, tmp_path):
    rows = [(1, 7, "2024-01-31"), (2, 7, "2024-01-02"), (3, 7, "2024-04-01"), (97, 8, "2023-12-05"), (98, 8, "2024-01-05")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "timestamp(d) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["W3_filled_customer_months"](spark, str(tmp_path)).select("g", "month", "n").collect())
    assert got == [(7, "2024-01-01", 2), (7, "2024-02-01", 0), (7, "2024-03-01", 0), (7, "2024-04-01", 1), (8, "2023-12-01", 1), (8, "2024-01-01", 1)]
