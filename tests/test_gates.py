"""Gates and views on inputs written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import gates


def test_settings_that_contradict_each_other():
    s = gates.RetrievalSettings
    assert s().wrong() == [] and s(mode="lexical", dense_weight=0).wrong() == [] and s(unit="child", child_depth=80).wrong() == []
    assert s(depth=5).wrong() == ["child_depth", "depth"] and s(unit="child").wrong() == ["child_depth"] and s(mode="x", top_k=0, policy="y").wrong() == ["mode", "policy", "top_k"] and s(dense_weight=0).wrong() == ["dense_weight"]


def test_files_are_hashed_inside_their_folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("x")
    (tmp_path / "b").write_text("y")
    (tmp_path / "in/link").symlink_to(tmp_path / "b")
    good = gates.file_hash(str(tmp_path / "in"), "a")
    assert gates.changed_files(str(tmp_path / "in"), {"a": good}) == [] and gates.changed_files(str(tmp_path / "in"), {"a": "0", "none": good}) == ["a", "none"]
    for name in ("../b", "link", "/etc/hostname"):
        with pytest.raises(ValueError, match="leaves"):
            gates.file_hash(str(tmp_path / "in"), name)


def test_nested_differences():
    a = {"x": [1, 2.0, {"y": True}], "z": None}
    assert list(gates.differences(a, {"x": [1, 2.0 + 1e-12, {"y": True}], "z": None})) == []
    assert list(gates.differences(a, {"x": [1, 2.1, {"y": 1}], "w": 0})) == ["$.w", "$.x[1]", "$.x[2].y", "$.z"] and list(gates.differences([1], [1, 2])) == ["$[]"]


@pytest.mark.parametrize(
    ("body", "want"),
    [({"output_text": " a "}, "a"), ({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}, "ab"), ({"choices": [{"message": {"content": "```json\n{}\n```"}}]}, "{}"), ({"candidates": [{"content": {"parts": [{"text": "c"}]}}]}, "c"), ({"other": "x"}, None), ([], None)],
)
def test_texts_of_responses(body, want):
    assert gates.response_text(json.dumps(body)) == want and gates.response_text("bad {") is None and gates.response_text(None) is None


def test_quantities_of_two_languages(spark):
    rows = spark.createDataFrame([("3 sets of 5 reps at 82.5kg, 70 % 1RM", "1RM 70% 82.5 킬로그램 5회 3세트"), ("2 weeks", "2 days"), ("v2 and 3xyz", "3xyz v2"), (None, "")], "a string, b string")
    got = rows.select(gates.quantities(F.col("a")).alias("q"), gates.lost_in_translation(F.col("a"), F.col("b")).alias("lost")).collect()
    assert got[0].q == ["1 rm", "3 sets", "5 reps", "70 percent", "82.5 kg"] and [r.lost for r in got] == [[], ["unit_preservation"], [], []]


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, 1.5)], "b int, a string, c double").withColumn("d", F.col("c").cast("decimal(9,2)"))
    gates.write_json_lines(rows, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":null,"b":2,"c":1.5,"d":1.5}']
    with pytest.raises(Exception, match="(?i)already exists"):
        gates.write_json_lines(rows, str(tmp_path / "out"))


def test_quantities_of_two_languages(spark):
    """The same amounts, however a unit is joined, and other ones told apart."""
    same = [("a 12-week plan", "12주 계획"), ("3 sets of 5 reps", "5회 3세트"), ("1.5 m/s over 20 metres", "1.5m/s, 20미터"), ("25 kg/m² and 30 kg", "30킬로그램 25 kg/m²"), ("on 2024-03-05 he lifted 80 kilos", "2024년 3월 5일 80kg"), ("90 % of 1RM", "1RM의 90퍼센트"), ("6 m^2", "6 m²"), ("4 days in 2 months", "2개월에 4일"), (None, "")]
    other = [("12-week", "12일", "unit_preservation"), ("6 m^2", "6 m", "unit_preservation"), ("80 kg", "81 kg", "number_preservation,unit_preservation"), ("RPE 8", "RIR 8", "acronym_preservation")]
    rows = spark.createDataFrame([(a, b, "") for a, b in same] + other, "a string, b string, lost string")
    got = rows.select("a", "lost", F.array_join(gates.lost_in_translation(F.col("a"), F.col("b")), ",").alias("told")).collect()
    assert [(r.a, r.told) for r in got] == [(r.a, r.lost) for r in got]
