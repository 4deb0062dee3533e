"""Questions read by rules, plans and their execution, loads and corpus builds on inputs written out by hand."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators import corpus, loading, metrics
from tallyhouse.plans import answers, language, workflow

MEDIANS = "first_last_n_session_median_e1rm"


@pytest.mark.parametrize("said", ["내 데드리프트의 처음 3세션과 최근 3세션의 median e1RM을 비교해줘.", "나의 데드리프트에서 처음 ３세션과 최근 ３세션의 median e1RM을 비교해줘.", "내 기록에서 Deadlift의 처음 3-session과 최근 3-session median e1RM을 비교해줘."])
def test_wordings_of_one_question(said):
    assert language.plain_question(said) == language.Plain(MEDIANS, "Deadlift (Barbell)", 3)


@pytest.mark.parametrize(
    ("said", "want"),
    [("내 벤치프레스의 주간훈련량을 계산해줘.", ("weekly_volume", "Bench Press (Barbell)", None, None)), ("제 스쿼트의 주간 빈도를 보여줘.", ("weekly_frequency", "Squat (Barbell)", None, None)),
     ("내 Deadlift (Barbell)의 2018-01-01부터 2018-03-31까지 weekly volume을 계산해줘.", ("weekly_volume", "Deadlift (Barbell)", "2018-01-01", "2018-03-31")), ("내 Deadlift (Barbell)의 기록을 조회해줘.", ("exercise_records", "Deadlift (Barbell)", None, None)),
     ("내 Deadlift (Barbell)의 weekly volume과 수면을 계산해줘.", None), ("데드리프트 기록을 보여줘.", None), ("내 기록을 보여줘.", None), ("", None), (None, None)],
)
def test_plain_questions(said, want):
    got = language.plain_question(said)
    assert want == (got and (got.operation, got.exercise, got.first_date, got.last_date))


@pytest.mark.parametrize(("said", "error"), [("내 루마니안 데드리프트의 빈도", "unsupported_exercise"), ("내 Deadlift (Dumbbell) 기록", "unsupported_exercise"), ("내 스쿼트와 데드리프트 기록", "several_exercises"), ("스쿼트 처음 3세션과 최근 4세션", "several_session_counts"), ("인클라인 벤치프레스 기록", None), ("데드리프트왕 기록", None)])
def test_wordings_that_have_no_one_meaning(said, error):
    got = language.worded(said)
    assert got.error == error and (error or got.exercise == ("Incline Bench Press (Barbell)" if said.startswith("인") else None))


def test_wording_as_columns(spark):
    rows = spark.createDataFrame([("내 벤치프레스의 주간 볼륨을 계산해줘.",), ("?",), (None,)], "q string").select(language.plain("q").alias("p"), language.wording("q").alias("w")).collect()
    assert [r.p.operation for r in rows] == ["weekly_volume", None, None] and rows[0].w.text == "내 Bench Press (Barbell)의 weekly volume을 계산해줘."


def test_steps_read_the_records_before_them(spark):
    log = lambda operation, n: spark.range(n)
    total = lambda operation, records: records.groupBy().sum("id")
    steps = [workflow.Step(workflow.LOG, "exercise_records", {"n": 4}), workflow.Step(workflow.METRIC, "sum"), workflow.Step(workflow.LITERATURE, "search")]
    tools = {workflow.LOG: log, workflow.METRIC: total}
    done = workflow.execute(steps, tools, limit=5)
    assert [(d.status, d.error) for d in done] == [("ok", None), ("ok", None), ("configuration_error", "tool_not_configured")] and done[1].rows.collect()[0][0] == 6
    assert workflow.execute(steps, tools, limit=4)[1].error == "ValueError: truncated_records"
    assert workflow.execute(steps[1:2], tools)[0].status == "dependency_error"


def test_guards(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "g int, rank int")
    assert [r.g for r in loading.broken_ranks(rows, ["g"]).collect()] == [2]
    assert loading.exactly_one(rows.where("rank = 3"), "rank").g == 2
    for where in ("rank = 1", "rank = 9"):
        with pytest.raises(ValueError, match="rank: "):
            loading.exactly_one(rows.where(where), "rank")
    registry = spark.createDataFrame([("a", "m1", 64)], "run string, model string, size int")
    assert loading.registered(registry, {"run": "b", "model": "m1", "size": 1}, "run") == "new" and loading.registered(registry, {"run": "a", "model": "m1", "size": 64}, "run") == "same"
    with pytest.raises(ValueError, match="other values of size"):
        loading.registered(registry, {"run": "a", "model": "m1", "size": 65}, "run")
    with pytest.raises(Exception, match="no details: 2"):
        loading.with_details(rows, rows.where("g = 1").select("g", F.col("rank").alias("d")), "g", ["d"]).collect()
    checks = spark.createDataFrame([("x", True), ("z", False), ("y", False)], "check string, ok boolean")
    loading.required(checks.where("ok"))
    with pytest.raises(ValueError, match="failed: y, z"):
        loading.required(checks)


def test_typed_text(spark):
    kinds = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("on", T.BooleanType()), T.StructField("t", T.StringType())])
    staged = spark.createDataFrame([(" 1 ", "TRUE", ""), ("", "no", "x"), (None, None, None)], "n string, on string, t string")
    assert [tuple(r) for r in loading.typed(staged, kinds).collect()] == [(1, True, ""), (None, False, "x"), (None, None, None)]
    with pytest.raises(Exception, match="n: one"):
        loading.typed(staged.union(spark.createDataFrame([("one", "", "")], staged.schema)), kinds).collect()


def test_a_corpus_is_built(spark):
    rows = [("p", [("One", ["a  b", " "]), ("Two", ["c d e"])]), ("q", [])]
    made = corpus.build(spark.createDataFrame(rows, "paper_id string, sections array<struct<title:string,paragraphs:array<string>>>"))
    assert {(r.paper_id, r.sections, r.paragraphs, r.words, r.status) for r in made.papers.collect()} == {("p", 2, 2, 5, "built"), ("q", 0, 0, 0, "no_text")}
    assert sorted((r.section, r.text) for r in made.paragraphs.collect()) == [(0, "a b"), (1, "c d e")] and {r.chunk_id for r in made.chunks.collect()} == {"p::00::0000", "p::01::0000"}


def test_runs_compared(spark):
    run = lambda **k: spark.createDataFrame(list(k.items()), "case string, m double")
    changes = corpus.compared(run(a=1.0, b=1.0, c=1.0), run(a=2.0, b=0.5, c=1.0, d=1.0), "case", "m")
    assert {r.case: r.change for r in changes.collect()} == {"a": "improved", "b": "worsened", "c": "unchanged", "d": "only_second"}
    assert not corpus.adopted_share(changes).collect()[0].adopt


def test_plateaus_of_a_made_series(spark):
    """A level stretch of ten weekly sessions between a rise and a fall is the one plateau."""
    level = [60, 70, 85] + [100, 101, 100, 99, 100, 101, 100, 100, 99, 100] + [130, 150]
    rows = [("s", k, float(v)) for k, v in enumerate(level)]
    series = spark.createDataFrame(rows, "series string, week int, value double").withColumn("started_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(week * 7)"))
    got = metrics.plateau_candidates(series.drop("week"), "series").collect()
    assert [(r.i, r.j, r.sessions) for r in got] == [(4, 13, 10)]
    every = {(i, j) for i in range(15) for j in range(i + 7, 15) if 100 * (max(level[i : j + 1]) - min(level[i : j + 1])) / sorted(level[i : j + 1])[(j - i + 1) // 2] <= 12}
    assert {(r.i - 1, r.j - 1) for r in metrics.plateau_windows(series.drop("week"), "series").collect()} <= every


def test_bounded_groups(spark):
    rows = spark.createDataFrame([(g, k) for g, n in ((1, 3), (2, 20), (3, 50)) for k in range(n)], "g int, k int")
    got = {r.g: (r.kept, r.omitted) for r in answers.bounded_rows(rows, "g", ["k"], "k").collect()}
    assert got == {1: ([0, 1, 2], 0), 2: (list(range(20)), 0), 3: ([*range(10), *range(40, 50)], 30)}


def test_matrices_come_back(spark, tmp_path):
    from tallyhouse.sources import files

    rows = spark.createDataFrame([(k, [float(k), k / 2]) for k in range(40)], "id long, v array<double>").repartition(3)
    assert files.write_matrix(rows, "id", "v", str(tmp_path / "m")) == 40
    assert {(r.key, tuple(r.vector)) for r in files.read_matrix(spark, str(tmp_path / "m")).collect()} == {(k, (float(k), k / 2)) for k in range(40)}


def test_lines_that_do_not_fit_stop_the_load(spark):
    from tallyhouse.sources import files

    made = files.relational(spark.createDataFrame([('{"a":1,"b":["x","y"]}',), ('{"a":2}',)], "value string"), "a int, b array<string>", "a", ["b"])
    assert sorted(r.a for r in made["rows"].collect()) == [1, 2] and [tuple(r) for r in made["b"].collect()] == [(1, 0, "x"), (1, 1, "y")]
    for bad in ("{", '{"b":[]}'):
        with pytest.raises(Exception, match="not of the schema"):
            files.relational(spark.createDataFrame([(bad,)], "value string"), "a int, b array<string>", "a", ["b"])["rows"].collect()


def test_children_by_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from tallyhouse.operators import passages

    text = "Short one. " + "antidisestablishmentarianism " * 40 + ". End here."
    rows = passages.token_children(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id", public.path("byte_bpe_50k.json"), most=24).orderBy("start").collect()
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert "".join("".join(text[r.start : r.end].split()) for r in rows) == "".join(text.split()) and all(len(made.encode(text[r.start : r.end], add_special_tokens=False).ids) <= 22 for r in rows) and len(rows) > 5


def test_evidence_that_is_needed(spark):
    rows = spark.createDataFrame([(True, False, "optional", False, False), (False, False, "none", False, False), (True, True, "required", True, False), (None, None, None, None, True)], "own boolean, read boolean, asked string, out boolean, open boolean")
    got = rows.select(workflow.evidence_need(*[F.col(c) for c in rows.columns]).alias("n")).select("n.*").collect()
    assert [(r.required, r.optional, r.status) for r in got] == [(["training_records"], ["literature"], "resolved"), ([], [], "clarification_required"), ([], [], "resolved"), ([], [], "clarification_required")]
