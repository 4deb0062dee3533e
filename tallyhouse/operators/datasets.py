"""Checks of evaluation data sets as a whole: how many cases of what kind, whether their gold exists, and whether it can be found at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.shared import written


def least_chunks(groups: DataFrame, case: str, k: int) -> DataFrame:
    """case, least: the fewest chunks that meet all of a case's groups at once, null if more than k are needed or a group has none.

    groups: case, match (`all`: every chunk; `any`: one of them), chunk_ids. What `all` groups need is
    taken at once. Then every round branches on the chunks of each state's smallest group that isn't met,
    for all cases together: a state is a set of chunks of one size, so the round that first meets all
    groups of a case gives its least number, and its other states end there. Equal sets are one state.
    The work follows the number of chunks needed, at most k rounds; the search is exhaustive.
    """
    ids = F.array_sort(F.array_distinct(F.array_compact("chunk_ids")))
    rows = groups.select(F.col(case).alias("case"), "match", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    per = rows.groupBy("case").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("match") == "all", F.col("ids")))))).alias("chosen"), F.collect_set(F.when(F.col("match") != "all", F.col("ids"))).alias("open"),
        F.bool_or(F.size("ids") == 0).alias("empty"),
    )
    unmet = lambda open_, chosen: F.filter(open_, lambda g: ~F.arrays_overlap(g, chosen))
    per = written(per.where(~F.col("empty")).select("case", "chosen", unmet("open", F.col("chosen")).alias("open")).where(F.size("chosen") <= k), "cases")
    done = [per.where(F.size("open") == 0).select("case", F.size("chosen").alias("least"))]
    states = per.where(F.size("open") > 0)
    for _ in range(k):
        smallest = F.array_sort("open", lambda a, b: F.size(a) - F.size(b))
        grown = states.where(F.size("chosen") < k).select("case", "chosen", "open", F.explode(F.get(smallest, 0)).alias("one"))
        chosen = F.array_sort(F.concat("chosen", F.array("one")))
        grown = grown.select("case", chosen.alias("chosen"), F.filter("open", lambda g: ~F.array_contains(g, F.col("one"))).alias("open"))
        grown = written(grown.groupBy("case", "chosen").agg(F.first("open").alias("open")), "states")
        met = written(grown.where(F.size("open") == 0).groupBy("case").agg(F.min(F.size("chosen")).alias("least")), "met")
        done.append(met)
        states = grown.join(met, "case", "left_anti")
        if not states.take(1):
            break
    found = reduce(lambda a, b: a.union(b), done).groupBy("case").agg(F.min("least").alias("least"))
    return rows.select("case").distinct().join(found, "case", "left").withColumnRenamed("case", case)


def dataset_checks(cases: DataFrame, groups: DataFrame, chunks: DataFrame, expected: dict[str, int], k: int, case: str = "case_id") -> DataFrame:
    """check, wrong, ok: named checks of cases (case, category), groups (case, group_id, match, chunk_ids) and the corpus (chunk_id).

    repeated_cases and repeated_groups count ids beyond the first, cases_of_category how far each kind's
    number is from `expected` in all, unknown_match groups that are neither `any` nor `all`, groups_of_no_case
    and cases_without_groups what lacks the other side, unknown_chunks gold that the corpus hasn't, and
    infeasible cases whose gold can't all stand in k places.
    """
    number = lambda df, name: df.agg(F.count("*").alias("wrong")).select(F.lit(name).alias("check"), "wrong")
    beyond = lambda df, by, name: df.groupBy(*by).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wrong")).select(F.lit(name).alias("check"), "wrong")
    wanted = cases.sparkSession.createDataFrame(list(expected.items()), "category string, wanted long")
    kinds = cases.groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(wanted), "category", "full_outer")  # a row for each category
    kinds = kinds.agg(F.coalesce(F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("wanted", F.lit(0)))), F.lit(0)).alias("wrong")).select(F.lit("cases_of_category").alias("check"), "wrong")
    named = groups.select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    checks = [
        beyond(cases, [case], "repeated_cases"), beyond(groups, [case, "group_id"], "repeated_groups"), kinds, number(groups.where(~F.coalesce(F.col("match").isin("any", "all"), F.lit(False))), "unknown_match"),
        number(groups.select(case).distinct().join(cases, case, "left_anti"), "groups_of_no_case"), number(cases.join(groups, case, "left_anti"), "cases_without_groups"),
        number(named.join(chunks, "chunk_id", "left_anti"), "unknown_chunks"), number(least_chunks(groups, case, k).where("least IS NULL"), "infeasible"),
    ]
    return reduce(lambda a, b: a.union(b), checks).withColumn("ok", F.col("wrong") == 0)
