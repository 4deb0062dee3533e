"""Queries over the remaining predicates, trends, question arguments and small functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import evaluation, metrics, passages, retrieval, timeseries
from tallyhouse.plans import questions
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import dates_as_text, flagged, r6

from tallyhouse.sources.tables import SETS, log_sets, read


@query("P4_exercise_or_names", """WITH s AS (SELECT l_orderkey, list(DISTINCT p_brand) AS names, min(p_brand) AS one FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey FROM s WHERE CASE WHEN l_orderkey % 2 = 0 THEN one = 'Brand#12' ELSE list_contains(names, 'Brand#12') END""")
def exercise_or_names(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an exercise: by their name, or where they have none by the names in them."""
    rows = log_sets(spark, folder).groupBy(F.col("session_id").alias("l_orderkey")).agg(F.collect_set("exercise_name").alias("names"), F.min("exercise_name").alias("one"))
    name = F.when(F.col("l_orderkey") % 2 == 0, F.col("one"))
    return rows.where(F.coalesce(name == "Brand#12", F.array_contains("names", "Brand#12"))).select("l_orderkey")


@query("P10_P11_outlier_candidates", SETS + """, m AS (SELECT *, median(weight) OVER (PARTITION BY exercise_name) AS gm, count(weight) OVER (PARTITION BY exercise_name) AS n FROM sets),
d AS (SELECT *, median(abs(weight - gm)) OVER (PARTITION BY exercise_name) AS mad FROM m), z AS (SELECT *, coalesce(weight >= 1000 OR (n >= 20 AND 0.6745::DOUBLE * (weight - gm) / nullif(mad, 0) > 12 AND weight / nullif(gm, 0) > 2.5), false) AS far FROM d),
r AS (SELECT set_id, concat_ws('; ', CASE WHEN weight < 0 THEN 'negative_weight' END, CASE WHEN reps < 0 THEN 'negative_reps' END, CASE WHEN set_order <= 0 THEN 'non_positive_set_order' END, CASE WHEN far THEN CASE WHEN weight >= 1000 THEN 'weight_ge_1000' ELSE 'within_exercise_weight_spike' END END,
  CASE WHEN reps >= 25 THEN 'reps_ge_25' END, CASE WHEN reps = 0 AND weight > 0 AND seconds = 0 AND distance = 0 THEN 'positive_weight_with_zero_reps' END) AS reason FROM z)
SELECT * FROM r WHERE reason <> ''""")
def outlier_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows, c = timeseries.robust_outliers(log_sets(spark, folder), "exercise_name", "weight"), F.col
    told = [
        (c("started_at").isNull(), F.lit("unparseable_date")), (c("weight") < 0, F.lit("negative_weight")), (c("reps") < 0, F.lit("negative_reps")), (c("set_order") <= 0, F.lit("non_positive_set_order")),
        (c("is_outlier"), F.when(c("weight") >= 1000, "weight_ge_1000").otherwise("within_exercise_weight_spike")), (c("reps") >= 25, F.lit("reps_ge_25")),
        ((c("reps") == 0) & (c("weight") > 0) & (c("seconds") == 0) & (c("distance") == 0), F.lit("positive_weight_with_zero_reps")),
    ]
    return rows.select("set_id", F.concat_ws("; ", *[F.when(when, what) for when, what in told]).alias("reason")).where("reason <> ''")


@query("P14_excluded_sections", "SELECT doc_id FROM documents WHERE NOT (contains(lower(source), 'src1') OR contains(lower(source), 'src20'))")
def excluded_sections(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array(F.lit("SRC1"), F.lit("src20"))
    return read(spark, folder, "documents").where(~F.exists(words, lambda w: F.contains(F.lower("source"), F.lower(w)))).select("doc_id")


@query("W3_filled_customer_months", """WITH m AS (SELECT o_custkey AS g, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT e.g, e.m::VARCHAR AS month, coalesce(n, 0)::BIGINT AS n FROM (SELECT g, unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM m GROUP BY 1) e LEFT JOIN m USING (g, m)""")
def filled_customer_months(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each customer in each month from the first to the last, over all orders; most customers have months without any."""
    rows = read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("g"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count("*").alias("n"))
    return dates_as_text(timeseries.filled_weeks(rows, "g", "month", "INTERVAL 1 MONTH").na.fill(0, ["n"]))


@query("A21_trend_summary", SETS + """, r AS (SELECT *, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at, session_id) AS i, row_number() OVER (PARTITION BY exercise_name ORDER BY started_at DESC, session_id DESC) AS j FROM bests)
SELECT exercise_name, count(*)::BIGINT AS sessions, round(median(best) FILTER (i <= 5), 6) AS first_median, round(median(best) FILTER (j <= 5), 6) AS last_median, round(max(best), 6) AS peak, round(arg_max(best, (started_at, session_id)), 6) AS latest,
  round(100.0::DOUBLE * (arg_max(best, (started_at, session_id)) / max(best) - 1), 6) AS latest_vs_peak_pct FROM r GROUP BY 1""")
def trend_summary(spark: SparkSession, folder: str) -> DataFrame:
    bests = metrics.session_bests(flagged(spark, folder))
    rows = metrics.first_last_medians(bests).join(timeseries.peak_and_latest(bests, "exercise_name"), "exercise_name")
    return rows.select("exercise_name", "sessions", "first_median", "last_median", "peak", "latest", "latest_vs_peak_pct").withColumns(r6("first_median", "last_median", "peak", "latest", "latest_vs_peak_pct"))


@query("E8_ranking_equality", """WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000) * 1000 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) AS r FROM orders)
SELECT a.o_custkey AS query_id, a.r::INT AS rank, a.o_orderkey AS chunk_a, b.o_orderkey AS chunk_b FROM a JOIN b USING (o_custkey, r) WHERE r <= 10 AND (a.o_orderkey <> b.o_orderkey OR abs(a.s - b.s) > 500)""")
def ranking_equality(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' orders by price against the same by whole thousands, where they differ by more than five hundred."""
    o = read(spark, folder, "orders")
    ranked = lambda score: retrieval.top(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), score.alias("score")), "query_id", [F.desc("score"), F.col("chunk_id")], 10)
    price = F.col("o_totalprice").cast("double")
    return evaluation.rankings_differ(ranked(price), ranked(F.floor(price / 1000) * 1000.0), 500.0).select("query_id", "rank", "chunk_a", "chunk_b")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """Questions about stored names with or without a metric, a period and a number of sessions."""
    i = F.col("p_partkey")
    metric = F.when(i % 5 == 0, "weekly volume").when(i % 5 == 1, "training gap").when(i % 5 == 2, "first and last 4-session e1RM").when(i % 5 == 3, "estimated 1RM").otherwise("records")
    said = F.concat_ws(" ", F.lit("my"), metric, F.when(i % 3 != 0, F.concat(F.lit("of "), F.lower("p_brand"))), F.when(i % 2 == 0, F.lit("from 2024-01-05 - 2024-02-01")))
    return read(spark, folder, "part").select("p_partkey", "p_brand", said.alias("text"))


@query("C4_C5_F8_arguments", """WITH q AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'weekly_volume' WHEN 1 THEN 'training_gap' WHEN 2 THEN 'first_last_n_session_median_e1rm' WHEN 3 THEN 'estimated_1rm' ELSE 'none' END AS operation, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE 'none' END AS exercise FROM part)
SELECT p_partkey, operation, exercise, (CASE WHEN p_partkey % 5 = 2 THEN 4 ELSE 5 END)::INT AS n, CASE WHEN p_partkey % 2 = 0 THEN '2024-02-01' ELSE 'none' END AS last_date,
  CASE WHEN operation = 'none' THEN 'missing_operation' WHEN operation <> 'training_gap' AND exercise = 'none' THEN 'missing_exercise' ELSE 'none' END AS error FROM q""")
def arguments(spark: SparkSession, folder: str) -> DataFrame:
    rows = asked(spark, folder)
    aliases = rows.select(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("canonical_name")).distinct()
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return questions.arguments(rows.select("p_partkey", "text"), aliases, "p_partkey").select("p_partkey", none("operation"), none("exercise"), "n", none("last_date"), none("error"))


@query("F29_candidate_scores", "SELECT p_partkey, (4 * (p_size % 2) + 2 * (p_size % 3 = 0)::INT + 2 * (p_size % 5 = 0)::INT + least(p_size % 7, 3) + (p_size > 40)::INT)::INT AS score FROM part")
def candidate_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A study's weight: full text 4, identifier 2, review 2, up to 3 topics, trained subjects 1."""
    s, flag = F.col("p_size"), lambda c: c.cast("int")
    return read(spark, folder, "part").select("p_partkey", (4 * (s % 2) + 2 * flag(s % 3 == 0) + 2 * flag(s % 5 == 0) + F.least(s % 7, F.lit(3)) + flag(s > 40)).alias("score"))


@query("J19_A29_membership", """WITH t AS (SELECT doc_id, source, unnest([source, lang]) AS topic FROM documents) SELECT topic, count(DISTINCT doc_id)::BIGINT AS docs FROM t GROUP BY 1""")
def membership(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.explode(F.array("source", "lang")).alias("topic")).groupBy("topic").agg(F.count_distinct("doc_id").alias("docs"))


@query("R15_R16_covers")
def covers(spark: SparkSession, folder: str) -> DataFrame:
    """For each passage: children that cover its middle, and the fewest chunks that meet three groups of gold."""

    @F.pandas_udf("cover int, hitting int")
    def both(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            spans = [(a, b) for a, b, _ in passages.children(t or "", 40)]
            n = len(t or "")
            groups = [("any", ["a", "b"]), ("any", ["b", "c"]), ("all", ["d"] if n % 2 else ["b"])]
            out.append((len(passages.covering(spans, n // 3, n // 2)), len(passages.least_hitting_set(groups))))
        return pd.DataFrame(out, columns=["cover", "hitting"])

    return read(spark, folder, "benchmark").select("item_id", both("text").alias("x")).select("item_id", "x.*")
