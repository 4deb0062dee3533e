"""Queries that measure, route and check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import evaluation
from tallyhouse.plans import answers, router
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import r6
from tallyhouse.queries.retrieval import COSINE, FUSED, INDEX, hybrid, lexical
from tallyhouse.sources.tables import read

# Gold of a query: passages of the same place in the table, in two groups of which one needs all.
GROUPS = """g AS (SELECT item_id AS query_id, 'a' AS group_id, 'any' AS match, [item_id * 3, item_id * 3 + 1, item_id] AS chunk_ids FROM benchmark
  UNION ALL SELECT item_id, 'b', 'all', [item_id] FROM benchmark WHERE item_id % 2 = 0),
"""
METRICS = """e AS (SELECT DISTINCT query_id, group_id, match, unnest(chunk_ids) AS chunk_id FROM g),
c AS (SELECT e.query_id, group_id, match, count(*) AS gold, count(h.chunk_id) AS hits FROM e LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h ON h.query_id = e.query_id AND h.chunk_id = e.chunk_id GROUP BY ALL),
v AS (SELECT query_id, avg((CASE WHEN match = 'any' THEN hits > 0 ELSE hits = gold END)::INT) AS group_recall, bool_and(CASE WHEN match = 'any' THEN hits > 0 ELSE hits = gold END)::INT::DOUBLE AS complete FROM c GROUP BY 1),
k AS (SELECT e.query_id, (count(*) FILTER (rank <= 10)) / count(*)::DOUBLE AS chunk_recall, coalesce(1.0::DOUBLE / min(rank), 0) AS reciprocal_rank FROM (SELECT DISTINCT query_id, chunk_id FROM e) e LEFT JOIN hits h ON h.query_id = e.query_id AND h.chunk_id = e.chunk_id GROUP BY 1),
m AS (SELECT * FROM v JOIN k USING (query_id))
"""


def gold_groups(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("item_id")
    both = F.array(F.struct(F.lit("a").alias("group_id"), F.lit("any").alias("match"), F.array(i * 3, i * 3 + 1, i).alias("chunk_ids"), (i >= 0).alias("on")), F.struct(F.lit("b").alias("group_id"), F.lit("all").alias("match"), F.array(i).alias("chunk_ids"), (i % 2 == 0).alias("on")))
    rows = read(spark, folder, "benchmark").select(i.alias("query_id"), F.explode(both).alias("x")).where("x.on")
    return rows.select("query_id", "x.group_id", "x.match", "x.chunk_ids").withColumn("required", F.lit(True))


@query("E1_E5_retrieval_metrics", INDEX + ", " + COSINE + ", " + FUSED + ", " + GROUPS + "hits AS (SELECT query_id, chunk_id, rank FROM fused), " + METRICS + "SELECT query_id, round(group_recall, 6) AS group_recall, complete, round(chunk_recall, 6) AS chunk_recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM m")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.retrieval_metrics(gold_groups(spark, folder), hybrid(spark, folder), 10).withColumns(r6("group_recall", "chunk_recall", "reciprocal_rank"))


@query("E6_macro_metrics", INDEX + ", " + GROUPS + "hits AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 10), " + METRICS + "SELECT count(*)::BIGINT AS cases, round(avg(group_recall), 6) AS group_recall, round(avg(complete), 6) AS complete, round(avg(chunk_recall), 6) AS chunk_recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM m")
def macro(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluation.macro(evaluation.retrieval_metrics(gold_groups(spark, folder), lexical(spark, folder, 10), 10))
    return rows.withColumns(r6("group_recall", "complete", "chunk_recall", "reciprocal_rank"))


@query("E12_confusion", """WITH p AS (SELECT quality AS g, (length(text) >= 1000)::INT AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) AS cases, count(*) FILTER (g = 1 AND p = 1) AS ts, count(*) FILTER (g <> 1 AND p = 1) AS fs, count(*) FILTER (g <> 1 AND p <> 1) AS ti, count(*) FILTER (g = 1 AND p <> 1) AS fi FROM p)
SELECT cases::BIGINT AS cases, ts::BIGINT AS true_sufficient, fs::BIGINT AS false_sufficient, ti::BIGINT AS true_insufficient, fi::BIGINT AS false_insufficient, round((ts + ti) / cases::DOUBLE, 6) AS accuracy,
  round(coalesce(ts / nullif(ts + fs, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(ts / nullif(ts + fi, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(fs / nullif(fs + ti, 0)::DOUBLE, 0), 6) AS false_sufficient_rate, round(coalesce(fi / nullif(fi + ts, 0)::DOUBLE, 0), 6) AS false_insufficient_rate FROM c""")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "labels").join(read(spark, folder, "documents").select("doc_id", F.length("text").alias("n")), "doc_id").withColumn("predicted", (F.col("n") >= 1000).cast("int"))
    return evaluation.confusion(rows, "quality", "predicted").withColumns(r6("accuracy", "precision", "recall", "false_sufficient_rate", "false_insufficient_rate"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns, each given some of the signals by its number, so that every route is taken."""
    words = ["training log", "weekly volume", "meta-analysis", "injury", "hypertrophy", "First  Session"]
    rows = read(spark, folder, "conversations").where("role = 'user'")
    n = F.col("conv_id") * 7 + F.col("turn")
    said = F.concat_ws(" ", F.lit("q"), *[F.when(F.shiftright(n, k) % 2 == 1, F.lit(w)) for k, w in enumerate(words)])
    return rows.select("conv_id", "turn", F.when(n % 64 == 0, F.lit(" ")).otherwise(said).alias("text"))


SIGNALS_SQL = """WITH q AS (SELECT conv_id, turn, conv_id * 7 + turn AS n FROM conversations WHERE role = 'user'),
s AS (SELECT *, (n >> 3) % 2 = 1 AS u, (n % 2 = 1 OR (n >> 5) % 2 = 1) AS l, (n >> 1) % 2 = 1 AS m, (n >> 2) % 2 = 1 AS e, (n >> 4) % 2 = 1 AS c FROM q),
r AS (SELECT *, CASE WHEN n % 64 = 0 THEN 'R-INVALID-BLANK' WHEN u AND NOT (e OR c) THEN 'R-UNSUPPORTED-MISSING-DATA' WHEN l AND (e OR c) AND m THEN 'R-HYBRID-WITH-METRIC' WHEN l AND (e OR c) THEN 'R-HYBRID-LOOKUP-LITERATURE'
  WHEN l AND m THEN 'R-LOG-METRIC' WHEN l THEN 'R-LOG-LOOKUP' WHEN e OR c THEN 'R-LITERATURE-ONLY' ELSE 'R-AMBIGUOUS' END AS rule FROM s)
"""


@query("C1_routing", SIGNALS_SQL + """SELECT conv_id, turn, rule, CASE rule WHEN 'R-INVALID-BLANK' THEN 'invalid' WHEN 'R-UNSUPPORTED-MISSING-DATA' THEN 'unsupported' WHEN 'R-HYBRID-WITH-METRIC' THEN 'hybrid' WHEN 'R-HYBRID-LOOKUP-LITERATURE' THEN 'hybrid'
  WHEN 'R-LOG-METRIC' THEN 'log_metric' WHEN 'R-LOG-LOOKUP' THEN 'log_lookup' WHEN 'R-LITERATURE-ONLY' THEN 'literature_only' ELSE 'ambiguous' END AS task_type,
  CASE rule WHEN 'R-HYBRID-WITH-METRIC' THEN 'query_training_log,compute_metrics,search_literature' WHEN 'R-HYBRID-LOOKUP-LITERATURE' THEN 'query_training_log,search_literature' WHEN 'R-LOG-METRIC' THEN 'query_training_log,compute_metrics'
  WHEN 'R-LOG-LOOKUP' THEN 'query_training_log' WHEN 'R-LITERATURE-ONLY' THEN 'search_literature' ELSE '' END AS tools,
  (CASE rule WHEN 'R-UNSUPPORTED-MISSING-DATA' THEN 1.0 WHEN 'R-HYBRID-WITH-METRIC' THEN 0.95 WHEN 'R-HYBRID-LOOKUP-LITERATURE' THEN 0.95 WHEN 'R-LOG-METRIC' THEN 0.95 WHEN 'R-LOG-LOOKUP' THEN 0.9
  WHEN 'R-LITERATURE-ONLY' THEN CASE WHEN e THEN 0.95 ELSE 0.85 END ELSE 0 END)::DOUBLE AS confidence FROM r""")
def routing(spark: SparkSession, folder: str) -> DataFrame:
    return router.routed(questions(spark, folder)).select("conv_id", "turn", "rule", "task_type", F.array_join("tools", ",").alias("tools"), "confidence")


def routing_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Routes against a gold that wants every log question to have its metric."""
    rows = router.routed(questions(spark, folder)).withColumnRenamed("tools", "selected")
    wanted = F.when(F.array_contains("selected", "query_training_log"), F.array_union("selected", F.array(F.lit("compute_metrics")))).otherwise(F.col("selected"))
    return rows.select("selected", wanted.alias("required"), "task_type", F.when(F.col("task_type") == "log_lookup", "log_metric").otherwise(F.col("task_type")).alias("expected_type"), F.col("task_type").alias("category"))


ROUTED_SQL = SIGNALS_SQL + """, t AS (SELECT *, rule IN ('R-HYBRID-WITH-METRIC', 'R-HYBRID-LOOKUP-LITERATURE', 'R-LOG-METRIC', 'R-LOG-LOOKUP') AS sl, rule IN ('R-HYBRID-WITH-METRIC', 'R-LOG-METRIC') AS sm, rule IN ('R-HYBRID-WITH-METRIC', 'R-HYBRID-LOOKUP-LITERATURE', 'R-LITERATURE-ONLY') AS sx FROM r)
"""


@query("E11_routing_by_tool", ROUTED_SQL + """, x AS (SELECT 'query_training_log' AS tool, sl AS e, sl AS p FROM t UNION ALL SELECT 'compute_metrics', sm OR sl, sm FROM t UNION ALL SELECT 'search_literature', sx, sx FROM t),
c AS (SELECT tool, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM x GROUP BY 1),
d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS a, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS b FROM c)
SELECT tool, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(a, 6) AS "precision", round(b, 6) AS recall, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS f1 FROM d""")
def routing_by_tool(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.routing_counts(routing_cases(spark, folder)).withColumns(r6("precision", "recall", "f1"))


@query("E11_routing_summary", ROUTED_SQL + """, y AS (SELECT CASE WHEN rule LIKE 'R-HYBRID%' THEN 'hybrid' WHEN rule = 'R-LOG-METRIC' THEN 'log_metric' WHEN rule = 'R-LOG-LOOKUP' THEN 'log_lookup' WHEN rule = 'R-LITERATURE-ONLY' THEN 'literature_only' WHEN rule = 'R-AMBIGUOUS' THEN 'ambiguous'
  WHEN rule = 'R-INVALID-BLANK' THEN 'invalid' ELSE 'unsupported' END AS category, (sl AND NOT sm)::INT AS miss, sl::INT + sm::INT + sx::INT AS s FROM t)
SELECT coalesce(category, 'all') AS category, count(*)::BIGINT AS cases, round(avg((miss = 0)::INT), 6) AS exact_rate, round(avg((category <> 'log_lookup')::INT), 6) AS right_type_rate, sum(miss)::BIGINT AS missing, 0::BIGINT AS unnecessary,
  round(coalesce(sum(miss) / nullif(sum(s + miss), 0)::DOUBLE, 0), 6) AS missing_rate, 0.0::DOUBLE AS unnecessary_rate FROM y GROUP BY GROUPING SETS ((), (category))""")
def routing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.routing_summary(routing_cases(spark, folder)).withColumns(r6("exact_rate", "right_type_rate", "missing_rate", "unnecessary_rate"))


@query("E7_metric_changes", INDEX + ", " + COSINE + ", " + FUSED + ", " + GROUPS + """e AS (SELECT DISTINCT query_id, unnest(chunk_ids) AS chunk_id FROM g),
a AS (SELECT e.query_id, coalesce(1.0::DOUBLE / min(rank), 0) AS v FROM e LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) h USING (query_id, chunk_id) GROUP BY 1), b AS (SELECT e.query_id, coalesce(1.0::DOUBLE / min(rank), 0) AS v FROM e LEFT JOIN fused h USING (query_id, chunk_id) GROUP BY 1)
SELECT CASE WHEN abs(b.v - a.v) <= 1e-12 THEN 'unchanged' WHEN b.v > a.v THEN 'improved' ELSE 'worsened' END AS change, count(*)::BIGINT AS cases FROM a JOIN b USING (query_id) GROUP BY 1""")
def metric_changes(spark: SparkSession, folder: str) -> DataFrame:
    gold = gold_groups(spark, folder)
    found = lexical(spark, folder)
    a, b = (evaluation.retrieval_metrics(gold, hits, 10) for hits in (found.where(F.col("rank") <= 10), hybrid(spark, folder, found)))
    return evaluation.metric_changes(a, b, "reciprocal_rank")


E2E_SQL = """WITH d AS (SELECT doc_id, lang AS category, doc_id % 3 <> 0 AS answerable, doc_id % 5 < 3 AS answered, doc_id % 7 < 4 AS grade_sufficient, doc_id % 11 < 8 AS gold_covered, doc_id % 4 = 1 AS recovery_ran, doc_id % 8 = 1 AS recovered, doc_id % 50 = 49 AS failed_run FROM documents),
e AS (SELECT *, answered AND (NOT answerable OR NOT gold_covered) AS unsafe, answerable AND NOT answered AND gold_covered AS ua, recovery_ran AND recovered AS rs,
  CASE WHEN failed_run THEN 'execution_failure' WHEN NOT answerable AND answered THEN 'unsafe_answer' WHEN answerable AND answered AND NOT gold_covered THEN 'unsupported_answer' WHEN answerable AND NOT answered AND gold_covered AND NOT grade_sufficient THEN 'grader_false_insufficient'
  WHEN answerable AND NOT answered AND gold_covered THEN 'unnecessary_abstention' WHEN answerable AND NOT answered AND recovery_ran THEN 'recovery_failure' WHEN answerable AND NOT answered THEN 'retrieval_failure' ELSE 'none' END AS failure FROM d)
"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, folder, "documents").select(i, F.col("lang").alias("category"), (i % 3 != 0).alias("answerable"), (i % 5 < 3).alias("answered"), (i % 7 < 4).alias("grade_sufficient"), (i % 11 < 8).alias("gold_covered"), (i % 4 == 1).alias("recovery_ran"), (i % 8 == 1).alias("recovered"), (i % 50 == 49).alias("failed_run"))


@query("E13_failures", E2E_SQL + "SELECT failure, count(*)::BIGINT AS cases, (count(*) FILTER (unsafe))::BIGINT AS unsafe FROM e GROUP BY 1")
def failures(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.end_to_end(runs(spark, folder)).groupBy("failure").agg(F.count("*").alias("cases"), F.count_if("unsafe").alias("unsafe"))


@query("E14_A35_end_to_end", E2E_SQL + """SELECT coalesce(category, 'all') AS category, count(*)::BIGINT AS cases, round(avg(answered::INT), 6) AS answered_rate, round(avg(unsafe::INT), 6) AS unsafe_rate, round(avg(ua::INT), 6) AS unnecessary_abstention_rate, round(avg(recovery_ran::INT), 6) AS recovery_ran_rate,
  round(coalesce((count(*) FILTER (rs)) / nullif(count(*) FILTER (recovery_ran), 0)::DOUBLE, 0), 6) AS recovery_success_rate FROM e GROUP BY GROUPING SETS ((), (category))""")
def end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluation.end_to_end_summary(evaluation.end_to_end(runs(spark, folder)))
    return rows.withColumns(r6(*[c for c in rows.columns if c.endswith("_rate")]))


@query("A36_by_label", "SELECT 'quality' AS label, quality::VARCHAR AS \"is\", count(*)::BIGINT AS cases, round(avg(doc_id % 10), 6) AS mean FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', toxic::VARCHAR, count(*)::BIGINT, round(avg(doc_id % 10), 6) FROM labels GROUP BY ALL")
def by_label(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.by_label(read(spark, folder, "labels").withColumn("v", F.col("doc_id") % 10), ["quality", "toxic"], "v").withColumns(r6("mean"))


@query("C16_grades", """WITH k AS (SELECT doc_id // 3 AS case_id, doc_id % 4 <> 3 AS claimed, [doc_id % 5, doc_id % 5, doc_id % 7] AS proposed FROM documents),
f AS (SELECT case_id, claimed AND len(list_filter(list_distinct(proposed), lambda x: x IN (0, 1, 2, 3))) > 0 AS ok, 3 - len(list_distinct(proposed)) AS dup FROM k)
SELECT case_id, bool_and(ok) AS sufficient, (count(*) FILTER (NOT ok))::BIGINT AS missing, sum(dup)::BIGINT AS duplicate_anchors FROM f GROUP BY 1""")
def grades(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    rows = read(spark, folder, "documents").select(F.floor(i / 3).alias("case_id"), F.when(i % 4 != 3, "supported").otherwise("missing").alias("model_status"), F.array(i % 5, i % 5, i % 7).alias("proposed_ids"), F.array(*[F.lit(k).cast("long") for k in range(4)]).alias("supplied_ids"))
    return answers.grades(rows)


@query("C17_recovery_queries", """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'invalid_target_component' WHEN doc_id % 6 = 1 THEN 'empty_query' WHEN doc_id % 6 = 2 THEN 'duplicate_query' WHEN doc_id % 6 = 3 THEN 'preserved_term_missing' ELSE 'none' END AS error FROM documents""")
def recovery_queries(spark: SparkSession, folder: str) -> DataFrame:
    i, s = F.col("doc_id") % 6, F.array(F.lit("Load"))
    rows = read(spark, folder, "documents").select(
        "doc_id", F.when(i == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("a"), F.lit("a"))).alias("target_ids"), F.array(F.lit("a"), F.lit("b")).alias("missing_ids"), F.when(i == 1, "  ").otherwise("New  LOAD query").alias("query"),
        F.when(i == 2, F.array(F.lit("new load  Query"))).otherwise(F.array(F.lit("old"))).alias("prior_queries"), F.when(i == 3, F.array(F.lit("volume"))).otherwise(s).alias("preserved_terms"),
    )
    return answers.recovery_checked(rows).select("doc_id", F.coalesce("error", F.lit("none")).alias("error"))


@query("C18_E15_citations", "SELECT doc_id, doc_id % 4 <> 0 AS valid, (doc_id % 4 = 0)::INT AS unknown FROM documents")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    rows = read(spark, folder, "documents").select(i, F.array(i % 3, i % 3, F.when(i % 4 == 0, F.lit(9).cast("long")).otherwise(i % 3)).alias("cited_ids"), F.array(*[F.lit(k).cast("long") for k in range(3)]).alias("evidence_ids"))
    return answers.citations_checked(rows).select("doc_id", "valid", F.size("unknown").alias("unknown"))


@query("P17_bounded_lists", """WITH l AS (SELECT l_orderkey % 100 AS k, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1)
SELECT k, (CASE WHEN len(v) > 20 THEN len(v) - 20 ELSE 0 END)::INT AS omitted, array_to_string(CASE WHEN len(v) > 20 THEN v[1:10] || v[-10:] ELSE v END, ',') AS kept FROM l""")
def bounded_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), "l_linenumber", "l_partkey")
    found = answers.bounded_rows(rows, "k", ["l_linenumber", "l_partkey"], "l_linenumber")
    return found.select("k", "omitted", F.array_join("kept", ",").alias("kept"))
