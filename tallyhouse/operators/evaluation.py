"""Measuring retrieval, routing, grading and whole answers against gold labels; rankings never see the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.functions.text import safe_rate

TOOLS = ("query_training_log", "compute_metrics", "search_literature")


def group_coverage(groups: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Each evidence group (query_id, group_id, match, required, chunk_ids) with covered: any or all of its chunks in the first k."""
    gold = groups.select("query_id", "group_id", "match", "required", F.explode("chunk_ids").alias("chunk_id")).distinct()
    found = hits.where(F.col("rank") <= k).select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    counted = gold.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id", "group_id", "match", "required").agg(F.count("*").alias("gold"), F.count("hit").alias("hits"))
    return counted.withColumn("covered", F.when(F.col("match") == "any", F.col("hits") > 0).otherwise(F.col("hits") == F.col("gold")))


def retrieval_metrics(groups: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """For each query with required groups: share of them covered, whether all are, chunk recall and reciprocal rank."""
    required = groups.where("required")
    covered = group_coverage(required, hits, k).groupBy("query_id").agg(F.avg(F.col("covered").cast("double")).alias("group_recall"), F.bool_and("covered").cast("double").alias("complete"))
    gold = required.select("query_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    ranked = gold.join(hits.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    chunk = ranked.groupBy("query_id").agg((F.count_if(F.col("rank") <= k) / F.count("*")).alias("chunk_recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    return covered.join(chunk, "query_id")


def macro(rows: DataFrame) -> DataFrame:
    """Unweighted means over queries."""
    return rows.agg(F.count("*").alias("cases"), *[F.avg(c).alias(c) for c in ("group_recall", "complete", "chunk_recall", "reciprocal_rank")])


def metric_changes(before: DataFrame, after: DataFrame, metric: str, tolerance: float = 1e-12) -> DataFrame:
    """How many queries a metric improves, worsens or leaves; both sides must have the same queries."""
    both = before.select("query_id", F.col(metric).alias("a")).join(after.select("query_id", F.col(metric).alias("b")), "query_id", "full_outer")
    both = both.withColumn("d", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("queries differ")).cast("double")).otherwise(F.col("b") - F.col("a")))
    return both.groupBy(F.when(F.abs("d") <= tolerance, "unchanged").when(F.col("d") > 0, "improved").otherwise("worsened").alias("change")).agg(F.count("*").alias("cases"))


def rankings_differ(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows in which two rankings differ in place, passage or, beyond the tolerance, score."""
    x = a.select("query_id", "rank", F.col("chunk_id").alias("chunk_a"), F.col("score").alias("score_a"))
    y = b.select("query_id", "rank", F.col("chunk_id").alias("chunk_b"), F.col("score").alias("score_b"))
    same = F.col("chunk_a").eqNullSafe(F.col("chunk_b")) & (F.abs(F.col("score_a") - F.col("score_b")) <= tolerance)
    return x.join(y, ["query_id", "rank"], "full_outer").where(~F.coalesce(same, F.lit(False)))


def routing_counts(cases: DataFrame) -> DataFrame:
    """Per tool tp, fp, fn, tn with precision, recall and F1, from arrays required and selected of each case."""
    rows = cases.select("required", "selected", F.explode(F.array(*[F.lit(t) for t in TOOLS])).alias("tool"))
    rows = rows.withColumns({"e": F.array_contains("required", F.col("tool")), "p": F.array_contains("selected", F.col("tool"))})
    out = rows.groupBy("tool").agg(F.count_if(F.col("e") & F.col("p")).alias("tp"), F.count_if(~F.col("e") & F.col("p")).alias("fp"), F.count_if(F.col("e") & ~F.col("p")).alias("fn"), F.count_if(~F.col("e") & ~F.col("p")).alias("tn"))
    out = out.withColumns({"precision": safe_rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_rate(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", safe_rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def routing_summary(cases: DataFrame, by: str = "category") -> DataFrame:
    """Overall and by category: exact tool sets, right task types, missing and unnecessary tools and their rates."""
    rows = cases.withColumns({
        "exact": F.array_sort("required") == F.array_sort("selected"), "right_type": F.col("expected_type") == F.col("task_type"),
        "missing": F.size(F.array_except("required", "selected")), "unnecessary": F.size(F.array_except("selected", "required")), "n_required": F.size("required"), "n_selected": F.size("selected"),
    })
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    out = rows.rollup(by).agg(F.count("*").alias("cases"), rate("exact"), rate("right_type"), F.sum("missing").alias("missing"), F.sum("unnecessary").alias("unnecessary"), F.sum("n_required").alias("r"), F.sum("n_selected").alias("s"))
    out = out.withColumns({"missing_rate": safe_rate(F.col("missing"), F.col("r")), "unnecessary_rate": safe_rate(F.col("unnecessary"), F.col("s"))})
    return out.withColumn(by, F.coalesce(by, F.lit("all"))).drop("r", "s")


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of sufficient and insufficient verdicts with accuracy, precision, recall and false rates, from 0/1 columns."""
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    out = rows.agg(F.count("*").alias("cases"), F.count_if(g & p).alias("true_sufficient"), F.count_if(~g & p).alias("false_sufficient"), F.count_if(~g & ~p).alias("true_insufficient"), F.count_if(g & ~p).alias("false_insufficient"))
    ts, fs, ti, fi = (F.col(c) for c in ("true_sufficient", "false_sufficient", "true_insufficient", "false_insufficient"))
    return out.withColumns({
        "accuracy": safe_rate(ts + ti, F.col("cases")), "precision": safe_rate(ts, ts + fs), "recall": safe_rate(ts, ts + fi),
        "false_sufficient_rate": safe_rate(fs, fs + ti), "false_insufficient_rate": safe_rate(fi, fi + ts),
    })


def by_label(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """A metric's mean by each value of each label column, from one pass over unpivoted labels."""
    long = rows.select(value, F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("is")) for c in labels])).alias("x"))
    return long.groupBy("x.label", "x.is").agg(F.count("*").alias("cases"), F.avg(value).alias("mean"))


def end_to_end(cases: DataFrame) -> DataFrame:
    """Each case's outcome from its gold and its run: unsafe or needlessly abstaining answers, recovery, and one failure label.

    Columns: answerable, answered, grade_sufficient, gold_covered, recovery_ran, recovered, failed_run.
    """
    c = F.col
    failure = (
        F.when(c("failed_run"), "execution_failure").when(~c("answerable") & c("answered"), "unsafe_answer").when(c("answerable") & c("answered") & ~c("gold_covered"), "unsupported_answer")
        .when(c("answerable") & ~c("answered") & c("gold_covered") & ~c("grade_sufficient"), "grader_false_insufficient").when(c("answerable") & ~c("answered") & c("gold_covered"), "unnecessary_abstention")
        .when(c("answerable") & ~c("answered") & c("recovery_ran"), "recovery_failure").when(c("answerable") & ~c("answered"), "retrieval_failure").otherwise("none")
    )
    return cases.withColumns({
        "unsafe": c("answered") & (~c("answerable") | ~c("gold_covered")), "unnecessary_abstention": c("answerable") & ~c("answered") & c("gold_covered"),
        "recovery_success": c("recovery_ran") & c("recovered"), "unnecessary_recovery": c("recovery_ran") & c("grade_sufficient"), "failure": failure,
    })


def end_to_end_summary(cases: DataFrame, by: str = "category") -> DataFrame:
    """Rates overall and by category of end_to_end()'s rows."""
    out = cases.rollup(by).agg(F.count("*").alias("cases"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in ("answered", "unsafe", "unnecessary_abstention", "recovery_ran")], safe_rate(F.count_if("recovery_success"), F.count_if("recovery_ran")).alias("recovery_success_rate"))
    return out.withColumn(by, F.coalesce(by, F.lit("all")))


def grounding(answers: DataFrame) -> DataFrame:
    """Which used ids of an answer were available, which weren't, and whether all were."""
    bad = F.array_except("used_ids", "available_ids")
    return answers.withColumns({"unknown_ids": bad, "grounded": F.size(bad) == 0, "used": F.size(F.array_intersect("used_ids", "available_ids"))})


def adopted(configs: DataFrame) -> DataFrame:
    """The configuration of the highest complete share, then group recall, then lowest depth and name."""
    order = [F.desc("complete"), F.desc("group_recall"), F.col("depth"), F.col("config")]
    return configs.withColumn("r", F.row_number().over(W.Window.partitionBy(F.lit(1)).orderBy(*order))).where("r = 1").drop("r")
