"""Deterministic checks around model outputs: grades, recovery queries, citations and bounded payloads.

What a model proposes is an input table; whether it stands is computed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def finalised(components: DataFrame) -> DataFrame:
    """Components (model_status, proposed_ids, supplied_ids) with the anchors that stand, those that don't, repeats and the final status.

    Only a component that the model calls supported and that keeps an anchor is supported.
    """
    once = F.array_distinct("proposed_ids")
    claimed = F.col("model_status") == "supported"
    valid = F.filter(once, lambda x: F.array_contains("supplied_ids", x))
    final = F.when(claimed, valid).otherwise(F.array().cast("array<bigint>"))
    return components.withColumns({
        "supporting_ids": final, "rejected_ids": F.filter(once, lambda x: ~F.array_contains("supplied_ids", x)), "duplicate_anchors": F.size("proposed_ids") - F.size(once),
        "status": F.when(claimed & (F.size(final) > 0), "supported").otherwise("missing"),
    })


def grades(components: DataFrame, case: str = "case_id") -> DataFrame:
    """A case is sufficient if none of its components is missing."""
    return finalised(components).groupBy(case).agg((F.count_if(F.col("status") == "missing") == 0).alias("sufficient"), F.count_if(F.col("status") == "missing").alias("missing"), F.sum("duplicate_anchors").alias("duplicate_anchors"))


def plain(text: Column) -> Column:
    """A query as it is compared: lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def recovery_checked(drafts: DataFrame) -> DataFrame:
    """Drafts (target_ids, missing_ids, query, prior_queries, preserved_terms) with the first error that stops them, or null."""
    asked = plain(F.col("query"))
    lost = F.filter(F.filter("preserved_terms", lambda t: plain(t) != ""), lambda t: ~F.contains(asked, plain(t)))
    error = (
        F.when((F.size("target_ids") == 0) | (F.size(F.array_except("target_ids", "missing_ids")) > 0), "invalid_target_component").when(asked == "", "empty_query")
        .when(F.exists("prior_queries", lambda p: plain(p) == asked), "duplicate_query").when(F.size(lost) > 0, "preserved_term_missing")
    )
    return drafts.withColumn("error", error).withColumn("target_ids", F.array_distinct("target_ids")).withColumn("normalized_query", asked)


def citations_checked(answers: DataFrame) -> DataFrame:
    """Answers (cited_ids, evidence_ids) with unknown citations and whether the draft is valid; repeats count once."""
    once = F.array_distinct("cited_ids")
    bad = F.array_except(once, "evidence_ids")
    return answers.withColumns({"cited": once, "unknown": bad, "valid": (F.size(bad) == 0) & (F.size(once) > 0)})


def bounded(values: Column, most: int = 20, ends: int = 10) -> Column:
    """A long list's first and last values with how many were left out between them."""
    long = F.size(values) > most
    kept = F.when(long, F.concat(F.slice(values, 1, ends), F.slice(values, -ends, ends))).otherwise(values)
    return F.struct(kept.alias("kept"), F.when(long, F.size(values) - 2 * ends).otherwise(0).alias("omitted"))


def bounded_rows(rows: DataFrame, by: str, order: list[str], value: str, most: int = 20) -> DataFrame:
    """by, kept, omitted: like bounded() for a table's groups, of any size: each end is ranked apart and cut at once."""
    half = most // 2
    end = lambda *cols: rows.select(by, F.struct(*dict.fromkeys([*order, value])).alias("_v"), F.row_number().over(W.Window.partitionBy(by).orderBy(*cols)).alias("_i")).where(F.col("_i") <= half)
    counted = rows.groupBy(by).agg(F.count("*").alias("_n"))
    first, last = end(*order).withColumn("_at", F.col("_i")), end(*[F.desc(c) for c in order]).join(counted, by)
    last = last.withColumn("_at", F.col("_n") - F.col("_i") + 1).where(F.col("_at") > half).drop("_n")
    kept = first.unionByName(last).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_x"))
    return counted.join(kept, by).select(by, F.transform("_x", lambda x: x["_v"][value]).alias("kept"), F.greatest(F.col("_n") - most, F.lit(0)).cast("int").alias("omitted"))


def argument_status(statuses: Column) -> Column:
    """The worst of several arguments' states."""
    order = ["conflicting", "ambiguous", "missing", "resolved"]
    out = F.lit("resolved")
    for s in reversed(order[:-1]):
        out = F.when(F.array_contains(statuses, s), s).otherwise(out)
    return out
