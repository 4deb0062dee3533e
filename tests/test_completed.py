"""Weekly metrics, versions, group unions, alias evidence and grades on rows written out by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tallyhouse.operators import cleaning, records, timeseries
from tallyhouse.plans import grading


def test_weeks_of_a_group_and_none_between(spark):
    at = lambda day: dt.datetime(2024, 1, day, 9)
    rows = [("a", 1, at(1), 10.0, 5, True), ("a", 1, at(1), 20.0, 5, True), ("a", 2, at(3), 1.0, 1, True), ("a", 3, at(24), 2.0, 2, True), ("b", 4, at(9), 3.0, 3, True), ("a", 5, at(30), 9.0, 9, False)]
    frame = spark.createDataFrame(rows, "exercise_name string, session_id long, started_at timestamp_ntz, weight double, reps int, in_volume boolean")
    got = sorted((r.exercise_name, r.week.day, r.sets, r.reps, float(r.volume), r.sessions) for r in timeseries.weekly_metrics(frame, "exercise_name").collect())
    assert got == [("a", 1, 3, 11, 151.0, 2), ("a", 8, 0, 0, 0.0, 0), ("a", 15, 0, 0, 0.0, 0), ("a", 22, 1, 2, 4.0, 1), ("b", 8, 1, 3, 9.0, 1)]


def test_a_version_is_read_by_its_folder(spark, tmp_path):
    spark.createDataFrame([(1, "v1"), (2, "v2"), (3, "v2"), (4, None)], "id int, preprocessing_version string").write.partitionBy("preprocessing_version").parquet(f"{tmp_path}/t")
    rows = records.of_version(spark.read.parquet(f"{tmp_path}/t"), "v2")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in rows.collect()) == [2, 3] and "PartitionFilters: [isnotnull(preprocessing_version" in plan


def test_members_sets_come_once_and_in_order(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    rows = [("s1", 2, at(2), "A", 1), ("s2", 1, at(1), "B", 2), ("s3", 1, at(1), "A", 1), ("s3", 1, at(1), "A", 1), ("s4", 9, at(1), "C", 1), ("s0", 1, at(1), "B", 2)]
    frame = spark.createDataFrame(rows, "set_id string, session_id long, started_at timestamp_ntz, exercise_name string, set_order int")
    assert [(r.place, r.set_id) for r in records.group_union(frame, ["A", "B"]).orderBy("place").collect()] == [(1, "s3"), (2, "s0"), (3, "s2"), (4, "s1")]


def test_alias_evidence_counts_nulls_as_alike(spark):
    rows = [("x", k, None) for k in range(20)] + [("y", k, None) for k in range(5, 17)] + [("z", k, "n") for k in range(20)] + [("y", 5, None)]
    frame = spark.createDataFrame(rows, "name string, place int, note string")
    assert [tuple(r) for r in cleaning.alias_evidence(frame, "name", ["place", "note"]).collect()] == [("x", "y", 12, 12 / 13, True)]
    assert cleaning.alias_evidence(frame, "name", ["place"], least=13).where("name_a = 'x' AND name_b = 'z'").collect()[0].pairs == 20
    assert cleaning.alias_evidence(frame, "name", ["place", "note"], least=13).count() == 0


def test_grades_fail_closed(spark):
    told = lambda *c: json.dumps({"components": [{"component_id": i, "status": s, "anchors": a} for i, s, a in c]})
    rows = [
        (1, ["a", "b"], ["1", "2"], None, told(("a", "supported", ["1", "1", "9"]), ("b", "supported", ["2"]))), (2, ["a", "b"], ["1"], None, told(("a", "supported", ["1"]), ("b", "supported", ["7"]))),
        (3, ["a"], ["1"], "timeout", told(("a", "supported", ["1"]))), (4, ["a"], ["1"], None, None), (5, ["a"], ["1"], None, "{"), (6, ["a"], ["1"], None, "[]"), (7, ["a"], ["1"], None, told(("a", "sure", ["1"]))),
        (8, ["a", "b"], ["1"], None, told(("a", "supported", ["1"]))), (9, ["a"], ["1"], None, told(("a", "supported", ["1"]), ("a", "supported", ["1"]))), (10, ["a"], ["1"], None, told(("c", "supported", ["1"]))),
        (11, [], ["1"], None, told()), (12, None, None, None, told()), (13, ["a"], None, None, told(("a", "missing", None))), (14, ["a"], ["1"], None, '{"components": [null]}'), (15, ["a"], ["1"], None, '{"components": "x"}'),
    ]
    frame = spark.createDataFrame(rows, "case_id long, required array<string>, supplied array<string>, provider_error string, output string")
    components, grades = grading.graded(frame)
    got = {r.case_id: (r.sufficient, r.missing, r.error) for r in grades.collect()}
    assert got == {
        1: (True, 0, None), 2: (False, 1, None), 3: (False, 1, "provider_failure"), 4: (False, 1, "provider_failure"), 5: (False, 1, "schema_failure"), 6: (False, 1, "schema_failure"), 7: (False, 1, "schema_failure"),
        8: (False, 2, "component_failure"), 9: (False, 1, "component_failure"), 10: (False, 1, "component_failure"), 11: (False, 0, None), 12: (False, 0, None), 13: (False, 1, None), 14: (False, 1, "schema_failure"), 15: (False, 1, "schema_failure"),
    }
    first = {r.component_id: (r.status, r.supporting_ids, r.rejected_ids) for r in components.where(F.col("case_id") == 1).collect()}
    assert first == {"a": ("supported", ["1"], ["9"]), "b": ("supported", ["2"], [])}
    assert all(r.status == "missing" and not r.supporting_ids for r in components.where("case_id IN (3, 4, 5, 8, 9, 10)").collect())
