"""The recovery loop with a made-up search: budget, stop rules, closed cases, failures."""

from pyspark.sql import functions as F

from tallyhouse.plans import recovery


def run(spark, questions, good_at, failing=(), ungraded=(), silent=(), repeating=(), budget=2):
    """A case's evidence suffices from the round in good_at on; searches are told by the text's number."""
    seen = []

    def search(open_):
        seen.append(sorted(r.query_id for r in open_.collect()))
        n = F.regexp_extract("text", "([0-9]+)$", 1).cast("long")
        return open_.where("query_id <> 'nothing'").select("query_id", F.explode(F.array(n * 100 + 1, F.lit(7).cast("long"))).alias("chunk_id")).withColumn("rank", F.when(F.col("chunk_id") == 7, 2).otherwise(1))

    def grade(evidence, open_):
        at = F.create_map(*[F.lit(x) for kv in good_at.items() for x in kv])
        n = F.regexp_extract("text", "([0-9]+)$", 1).cast("int")
        return open_.where(~F.col("query_id").isin(*ungraded, "-")).select("query_id", F.coalesce(n >= F.element_at(at, F.col("query_id")), F.lit(False)).alias("sufficient"), F.col("query_id").isin(*failing, "-").alias("failed"))

    def again(open_, evidence):
        n = F.regexp_extract("text", "([0-9]+)$", 1).cast("int") + 1
        text = F.when(F.col("query_id").isin(*repeating, "-"), F.lit("q0")).otherwise(F.concat(F.lit("q"), n.cast("string")))
        return open_.where(~F.col("query_id").isin(*silent, "-")).select("query_id", text.alias("text"))

    frame = spark.createDataFrame(questions, "query_id string, text string")
    outcomes, evidence, searches = recovery.recovery_loop(frame, search, grade, again, budget, k=3)
    ends = {r.query_id: (r.status, r.reason, r.retries) for r in outcomes.collect()}
    held = {}
    for r in sorted(evidence.collect(), key=lambda r: r.rank):
        held.setdefault(r.query_id, []).append((r.chunk_id, r.first_round))
    return ends, held, seen, sorted((r.query_id, r.round, r.text) for r in searches.collect())


def test_every_way_that_a_case_ends(spark):
    questions = [(q, "q0") for q in ("first", "second", "third", "never", "fails", "lost", "silent", "same", "nothing")] + [("blank", " "), ("null", None)]
    ends, held, seen, searches = run(spark, questions, {"first": 0, "second": 1, "third": 2, "fails": 0, "nothing": 9}, failing=("fails",), ungraded=("lost",), silent=("silent",), repeating=("same",))
    assert ends == {
        "first": ("answer_ready", "sufficient", 0), "second": ("answer_ready", "sufficient", 1), "third": ("answer_ready", "sufficient", 2), "never": ("abstain_ready", "budget", 2), "fails": ("execution_failure", "grade_failed", 0),
        "lost": ("execution_failure", "not_graded", 0), "silent": ("abstain_ready", "no_next_query", 0), "same": ("abstain_ready", "repeated_query", 0), "nothing": ("abstain_ready", "budget", 2),
        "blank": ("execution_failure", "no_query", 0), "null": ("execution_failure", "no_query", 0),
    }
    # A closed case isn't searched again.
    assert seen == [["fails", "first", "lost", "never", "nothing", "same", "second", "silent", "third"], ["never", "nothing", "second", "third"], ["never", "nothing", "third"]]
    assert [(q, r) for q, r, _ in searches if q == "third"] == [("third", 0), ("third", 1), ("third", 2)] and not any(q in ("blank", "null") for q, *_ in searches)
    # What both searches found comes first, and evidence tells the round that found it.
    assert held["first"] == [(1, 0), (7, 0)] and held["second"] == [(7, 0), (1, 0), (101, 1)] and {c for c, _ in held["third"]} <= {1, 7, 101, 201} and len(held["third"]) == 3 and "nothing" not in held


def test_no_budget_and_no_questions(spark):
    ends, _, seen, _ = run(spark, [("a", "q0"), ("b", "q0")], {"a": 0, "b": 1}, budget=0)
    assert ends == {"a": ("answer_ready", "sufficient", 0), "b": ("abstain_ready", "budget", 0)} and len(seen) == 1
    ends, held, _, searches = run(spark, [], {"a": 0})
    assert ends == {} and held == {} and searches == []
