"""The recovery loop over a batch of questions: search, grade, ask again, fuse, for as many rounds as the budget has."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import retrieval
from tallyhouse.plans.workflow import MOST_RETRIES
from tallyhouse.sources.shared import written

#: search(query_id, text) gives query_id, chunk_id, rank; grade(evidence, open) gives query_id, sufficient, failed;
#: again(open, evidence) gives query_id, text of the next query.
Search = Callable[[DataFrame], DataFrame]
Grade = Callable[[DataFrame, DataFrame], DataFrame]
Again = Callable[[DataFrame, DataFrame], DataFrame]


def recovery_loop(questions: DataFrame, search: Search, grade: Grade, again: Again, budget: int = MOST_RETRIES, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes (query_id, status, reason, retries), evidence (query_id, chunk_id, rank, first_round) and searches (query_id, round, text).

    A round searches for the open cases alone, fuses what it finds with the evidence they have, and
    grades them all together; what it decides is written before the next one, so that a closed case
    takes no part in later rounds. `answer_ready`: the evidence is sufficient. `execution_failure`: the
    grade failed or is missing, as an ungraded case isn't sufficient. `abstain_ready`: the budget is used
    up, or there is no next query, or it is the same as one asked before. A null or blank question isn't
    searched for: it fails as no_query. There are at most `budget` + 1 rounds, each a fixed number of jobs.
    """
    spark = questions.sparkSession
    asked = written(questions.select("query_id", F.col("text").alias("text")), "asked")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    open_ = asked.where(~blank)
    ended = [asked.where(blank).select("query_id", F.lit("execution_failure").alias("status"), F.lit("no_query").alias("reason"), F.lit(0).alias("retries"))]
    searches, closed_evidence, evidence = [], [], None
    for round_ in range(budget + 1):
        searches.append(open_.select("query_id", F.lit(round_).alias("round"), "text"))
        hits = written(search(open_).select("query_id", "chunk_id", "rank"), "hits")
        if evidence is None:
            found = hits.where(F.col("rank") <= k).withColumn("first_round", F.lit(0))
        else:
            mine = evidence.join(open_.select("query_id"), "query_id", "left_semi")
            fused = retrieval.recovery_fusion(mine, hits, k).select("query_id", "chunk_id", "rank")
            found = fused.join(mine.select("query_id", "chunk_id", "first_round"), ["query_id", "chunk_id"], "left").withColumn("first_round", F.coalesce("first_round", F.lit(round_)))
        evidence = written(found.select("query_id", "chunk_id", "rank", "first_round"), "evidence")
        graded = open_.join(grade(evidence, open_).groupBy("query_id").agg(F.bool_and("sufficient").alias("sufficient"), F.bool_or("failed").alias("failed")), "query_id", "left")
        bad = F.col("sufficient").isNull() | F.coalesce("failed", F.lit(False))
        status = F.when(bad, "execution_failure").when(F.col("sufficient"), "answer_ready")
        reason = F.when(F.col("sufficient").isNull(), "not_graded").when(bad, "grade_failed").when(F.col("sufficient"), "sufficient")
        if round_ == budget:
            status, reason = F.coalesce(status, F.lit("abstain_ready")), F.coalesce(reason, F.lit("budget"))
            ended.append(written(graded.select("query_id", status.alias("status"), reason.alias("reason"), F.lit(round_).alias("retries")), "ended"))
            closed_evidence.append(evidence)
            break
        nexts = again(open_, evidence).groupBy("query_id").agg(F.min("text").alias("next"))
        before = reduce(lambda a, b: a.union(b), [s.select("query_id", F.col("text").alias("next"), F.lit(True).alias("known")) for s in searches]).distinct()
        graded = graded.join(nexts, "query_id", "left").join(before, ["query_id", "next"], "left")
        stuck = F.coalesce(F.trim("next"), F.lit("")) == ""
        status = status.when(stuck | F.col("known"), "abstain_ready")
        reason = reason.when(stuck, "no_next_query").when(F.col("known"), "repeated_query")
        told = written(graded.select("query_id", "next", status.alias("status"), reason.alias("reason"), F.lit(round_).alias("retries")), "told")
        ended.append(told.where("status IS NOT NULL").select("query_id", "status", "reason", "retries"))
        open_ = told.where("status IS NULL").select("query_id", F.col("next").alias("text"))
        closed_evidence.append(evidence.join(open_.select("query_id"), "query_id", "left_anti"))
        if not open_.take(1):
            break
    union = lambda parts: reduce(lambda a, b: a.union(b), parts)
    return union(ended), union(closed_evidence), spark.createDataFrame([], searches[0].schema).union(union(searches))
