"""Nested values compared with a tolerance, against the plain definition, and errors of recomputed cases."""

import json
import random

from pyspark.sql import functions as F

from tallyhouse.operators import cleaning, gold


def brute(expected, actual, tolerance, path="expected"):
    kind = lambda x: "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "object" if isinstance(x, dict) else "array"
    if kind(expected) != kind(actual):
        return {(path, "kind")}
    if isinstance(expected, dict):
        out = set()
        for k, v in expected.items():
            out |= brute(v, actual[k], tolerance, f"{path}.{k}") if k in actual else {(f"{path}.{k}", "missing")}
        return out
    if isinstance(expected, list):
        if len(expected) != len(actual):
            return {(path, "length")}
        return set().union(*(brute(a, b, tolerance, f"{path}[{k}]") for k, (a, b) in enumerate(zip(expected, actual, strict=True))))
    if kind(expected) == "number":
        return set() if abs(expected - actual) <= tolerance else {(path, "value")}
    return set() if expected == actual else {(path, "value")}


def some(rng, depth):
    pick = rng.random()
    if depth and pick < 0.35:
        return {rng.choice("abcd"): some(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and pick < 0.6:
        return [some(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([0, 1, 1.0, 1.0005, 2.5, -3, True, False, None, "x", "é\"", "1", ""])


def changed(rng, x):
    if rng.random() < 0.15:
        return some(rng, 2)
    if isinstance(x, dict):
        return {k: changed(rng, v) for k, v in x.items() if rng.random() > 0.1} | ({"more": 1} if rng.random() < 0.2 else {})
    return [changed(rng, v) for v in x] if isinstance(x, list) else x


def test_differences_against_the_definition(spark):
    rng = random.Random(12)
    rows = []
    for k in range(300):
        e = some(rng, 4)
        rows.append((k, e, changed(rng, e), rng.choice([0.0, 0.001])))
    frame = spark.createDataFrame([(k, json.dumps(e), json.dumps(a), t) for k, e, a, t in rows] + [(900, "{", "{}", 0.0), (901, "{}", "nope", 0.0), (902, None, "1", 0.0), (903, "1", "1.1", None)], "k long, e string, a string, t double")
    got = {}
    for r in gold.differences(frame, "k", "e", "a", "t").collect():
        got.setdefault(r.k, set()).add((r.path, r.problem))
    want = {k: brute(e, a, t) for k, e, a, t in rows} | {k: {("expected", "broken")} for k in (900, 901, 902)} | {903: {("expected", "value")}}
    assert got == {k: v for k, v in want.items() if v} and sum(map(len, got.values())) > 100


def test_cases_that_cannot_be_recomputed(spark):
    kind = "set_id string, session_id long, exercise_name string, started_at timestamp_ntz, set_order int, weight double, reps int, distance double, seconds int"
    sets = spark.createDataFrame([(f"s{k}", k, "Row", None, 1, 50.0 + k, 5, 0.0, 0) for k in range(2)], kind).withColumn("started_at", F.expr("timestamp_ntz '2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(session_id as int) * 3)"))
    lineage = spark.createDataFrame([("kept",), ("kept",), ("excluded_exact_duplicate",)], "row_status string")
    rows = [("a", "e1rm_interval_summary", "Row", None, "2024-01-01 00:00:00", "2024-02-01 00:00:00", None, None, "{}"), ("b", "outlier_record", None, None, None, None, None, "none", "{}"), ("c", "what", None, None, None, None, None, None, "{}")]
    rows += [("d", "e1rm_window_summary", "Squat", 3, None, None, None, None, "{}"), ("e", "e1rm_window_summary", "Row", 1, None, None, None, None, '{"eligible_sessions": 2, "change_pct": 2.0}'), ("f", "session_summary", None, None, None, None, None, None, '{"session_count": 2, "last_session": "2024-01-04 10:00:00"}')]
    rows += [("g", "longest_training_gap", None, None, None, None, None, None, '{"gap_days": 3, "calendar_day_difference": 3}'), ("h", "lineage_reconciliation", None, None, None, None, None, None, '{"raw_lineage_rows": 3, "processed_rows": 1}'), ("i", "gap_e1rm_comparison", None, None, "2024-01-02 00:00:00", "2024-01-03 00:00:00", ["Row", "Squat"], None, '{"comparisons": [{"exercise": "Row"}]}')]
    frame = spark.createDataFrame(rows, "case_id string, operation string, exercise string, n int, s string, z string, exercises array<string>, set_id string, expected string")
    frame = frame.select("case_id", "operation", "exercise", "n", F.col("s").cast("timestamp_ntz").alias("start_at"), F.col("z").cast("timestamp_ntz").alias("end_at"), "exercises", "set_id", "expected", F.lit(0.05).alias("tolerance"))
    got = {(r.case_id, r.path, r.problem) for r in gold.gold_problems(frame, cleaning.flagged(sets), lineage).collect()}
    assert got == {("a", "expected", "not_enough_sessions"), ("b", "expected", "not_one_set"), ("c", "expected", "unknown_operation"), ("d", "expected", "no_records"), ("h", "expected.processed_rows", "value")}
