"""Plans, outcomes, corpus builds and their statistics, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import corpus
from tallyhouse.plans import workflow
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import read


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("personal"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("analyses"), (F.col("o_totalprice") > 150000).alias("literature"), (F.col("o_custkey") % 10 == 0).alias("clarification"))


FLAGS = """WITH o AS (SELECT *, o_orderstatus = 'F' AS own, left(o_orderpriority, 1)::INT > 0 AS metric, o_totalprice > 150000 AS lit, o_custkey % 10 = 0 AS open FROM orders),
r AS (SELECT o_orderkey, CASE WHEN open THEN 'ambiguous' WHEN own AND lit THEN 'hybrid' WHEN own AND metric THEN 'log_metric' WHEN own THEN 'log_lookup' WHEN lit THEN 'literature_only' ELSE 'unsupported' END AS task_type,
  CASE WHEN open THEN '' ELSE concat_ws(',', CASE WHEN own THEN 'query_training_log' END, CASE WHEN own AND metric THEN 'compute_metrics' END, CASE WHEN lit THEN 'search_literature' END) END AS tools FROM o)
"""


@query("C3_channels_routed", FLAGS + "SELECT * FROM r")
def channels_routed(spark: SparkSession, folder: str) -> DataFrame:
    return workflow.channels_routed(_flags(spark, folder)).select("o_orderkey", "task_type", F.array_join("tools", ",").alias("tools"))


@query("C13_plan_errors", """WITH p AS (SELECT l_orderkey, list(CASE l_linenumber % 4 WHEN 0 THEN 'query_training_log' WHEN 1 THEN 'search_literature' WHEN 2 THEN 'compute_metrics' ELSE 'query_training_log' END ORDER BY l_linenumber DESC) AS tools, bool_or(l_returnflag = 'R') AS refused FROM lineitem GROUP BY 1),
q AS (SELECT *, list_transform(tools, lambda t: list_position(['query_training_log', 'compute_metrics', 'search_literature'], t)) AS places, array_to_string(tools, ',') AS joined, CASE WHEN refused THEN 'unsupported' WHEN len(tools) = 1 THEN 'literature_only' WHEN len(tools) = 2 THEN 'log_metric' ELSE 'hybrid' END AS task FROM p)
SELECT l_orderkey, coalesce(CASE WHEN len(list_distinct(tools)) < len(tools) THEN 'repeated_tool' WHEN list_sort(places) <> places THEN 'tool_order' WHEN list_contains(tools, 'compute_metrics') AND NOT list_contains(tools, 'query_training_log') THEN 'metric_without_records'
  WHEN NOT ((task = 'literature_only' AND joined = 'search_literature') OR (task = 'log_metric' AND joined = 'query_training_log,compute_metrics') OR (task = 'hybrid' AND joined IN ('query_training_log,search_literature', 'query_training_log,compute_metrics,search_literature'))) THEN 'tools_of_another_task' END, 'none') AS error FROM q""")
def plan_errors(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    tool = F.when(k == 1, workflow.LITERATURE).when(k == 2, workflow.METRIC).otherwise(workflow.LOG)
    rows = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", tool.alias("t"))), asc=False).alias("x"), F.bool_or(F.col("l_returnflag") == "R").alias("refused"))
    rows = rows.withColumn("tools", F.transform("x", lambda v: v["t"]))
    n = F.size("tools")
    task = F.when(F.col("refused"), "unsupported").when(n == 1, "literature_only").when(n == 2, "log_metric").otherwise("hybrid")
    error = workflow.plan_error(task, F.col("tools"), F.col("refused"), F.when(F.col("refused"), F.lit("no data")))
    return rows.select("l_orderkey", F.coalesce(error, F.lit("none")).alias("error"))


@query("C15_outcomes", """WITH a AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS good, min(l_linenumber) FILTER (l_quantity > 45) AS bad, max(l_linenumber) AS last FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
SELECT l_orderkey, CASE WHEN bad IS NOT NULL AND (good IS NULL OR bad <= good) THEN 'execution_failure' WHEN good IS NOT NULL THEN 'answer_ready' ELSE 'abstain_ready' END AS status,
  (CASE WHEN bad IS NOT NULL AND (good IS NULL OR bad <= good) THEN bad WHEN good IS NOT NULL THEN good ELSE last END - 1)::INT AS retries FROM a""")
def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "R").alias("sufficient"), (F.col("l_quantity") > 45).alias("failed"))
    return workflow.outcomes(rows, "l_orderkey").withColumn("retries", F.col("retries").cast("int"))


@query("C8_ungrounded", """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS said, string_split(coalesce(text, ''), ' ')[2] AS w, doc_id % 9 AS n FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN w IS NOT NULL AND NOT contains(said, lower(w || CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END)) THEN 'exercise' END, CASE WHEN NOT regexp_matches(said, '(^|[^0-9])' || n || '([^0-9]|$)') THEN 'n_sessions' END,
  CASE WHEN w IS NOT NULL AND doc_id % 2 = 0 AND (trim(w) = '' OR NOT contains(said, lower(w))) THEN 'requested_analyses' END) AS issues FROM d""")
def ungrounded(spark: SparkSession, folder: str) -> DataFrame:
    """Second words of documents, every third one altered, as mentions of what the document asks."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    word = F.get(F.split(text, " "), F.lit(1))
    spans = F.when((i % 2 == 0) & word.isNotNull(), F.array(word))
    issues = workflow.ungrounded(text, F.concat(word, F.when(i % 3 == 0, "#").otherwise("")), F.lit(None).cast("array<string>"), i % 9, spans)
    return read(spark, folder, "documents").select("doc_id", F.array_join(issues, ",").alias("issues"))


@query("C19_abstention", """SELECT o_orderkey, sha256(concat_ws(chr(10) || chr(10), CASE WHEN o_orderstatus <> 'O' THEN '현재 확인 가능한 내용: 개인 운동 기록' || CASE WHEN o_orderstatus = 'P' THEN ', 계산된 지표' ELSE '' END || ' 결과는 확보되어 있습니다.' END,
  CASE WHEN o_custkey % 4 > 0 THEN '현재 확인 가능한 내용: 검색된 문헌 근거 ' || o_custkey % 4 || '개를 확인했습니다.' END, CASE WHEN o_custkey % 3 = 0 THEN '부족한 근거: 현재 데이터와 문헌 근거로 답할 수 있는 범위를 확인하지 못했습니다.' ELSE '부족한 문헌 근거: ' || trim(o_orderpriority) END,
  CASE WHEN o_custkey % 5 > 0 THEN '초기 검색 후 문헌 추가 검색을 ' || o_custkey % 5 || '회 수행했지만 필요한 근거가 충분하지 않았습니다.' WHEN o_custkey % 4 > 0 THEN '현재 문헌 검색 결과만으로는 필요한 근거가 충분하지 않았습니다.' END,
  '따라서 현재 근거만으로는 다음 주장에 답을 확정할 수 없습니다: ' || o_orderkey)) AS text_sha256 FROM orders""")
def abstentions(spark: SparkSession, folder: str) -> DataFrame:
    c, status = F.col("o_custkey"), F.col("o_orderstatus")
    tools = F.when(status == "O", F.array().cast("array<string>")).when(status == "P", F.array(F.lit(workflow.LOG), F.lit(workflow.METRIC))).otherwise(F.array(F.lit(workflow.LOG)))
    needs = F.when(c % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.col("o_orderpriority"), F.col("o_orderpriority")))
    text = workflow.abstention(tools, c % 4, needs, F.lit(None).cast("string"), c % 5, F.col("o_orderkey").cast("string"))
    return read(spark, folder, "orders").select("o_orderkey", F.sha2(text, 256).alias("text_sha256"))


@query("Z21_personal_signals", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'record_operation' END, CASE WHEN o_custkey % 3 > 0 THEN 'requested_analyses' END, CASE WHEN o_totalprice > 200000 THEN 'explicit_personal_request' END,
  CASE WHEN o_custkey % 2 = 0 THEN 'exercise_session_context' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'evidence_need' END) AS signals FROM orders""")
def personal_signals(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("o_custkey")
    found = workflow.personal_signals(F.when(F.col("o_orderstatus") == "F", F.lit("exercise_records")), c % 3, F.col("o_totalprice") > 200000, F.when(c % 2 == 0, F.lit("x")), c, F.when(F.startswith("o_orderpriority", F.lit("1")), F.array(F.lit("training_records"))))
    return read(spark, folder, "orders").select("o_orderkey", F.array_join(found, ",").alias("signals"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as papers of one section whose paragraphs are their lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return read(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), F.array(F.struct(F.col("lang").alias("title"), lines.alias("paragraphs"))).alias("sections"))


LINES = r"""WITH l AS (SELECT doc_id AS paper_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS paragraph, unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM documents),
q AS (SELECT paper_id, paragraph, trim(regexp_replace(p, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM l), k AS (SELECT * FROM q WHERE text <> '')
"""


@query("R13_paragraphs", LINES + "SELECT paper_id, paragraph::INT AS paragraph, len(string_split(text, ' '))::INT AS words, sha256(text) AS text_sha256 FROM k")
def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.build(articles(spark, folder)).paragraphs.select("paper_id", "paragraph", "words", "text_sha256")


@query("R13_papers", LINES + """SELECT doc_id AS paper_id, count(k.paragraph)::BIGINT AS paragraphs, coalesce(sum(len(string_split(k.text, ' '))), 0)::BIGINT AS words, CASE WHEN count(k.paragraph) > 0 THEN 'built' ELSE 'no_text' END AS status
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN k ON k.paper_id = d.doc_id GROUP BY 1""")
def papers(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.build(articles(spark, folder)).papers.select("paper_id", "paragraphs", "words", "status")


@query("A30_build_statistics", """WITH c AS (SELECT source, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL)
SELECT count(DISTINCT source)::BIGINT AS papers, count(*)::BIGINT AS chunks, (count(*) - count(DISTINCT text))::BIGINT AS duplicate_texts, round(count(*) / count(DISTINCT source), 6) AS mean_chunks, round(sum(w) / count(*), 6) AS mean_words FROM c""")
def build_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = corpus.build_statistics(read(spark, folder, "documents").where("text IS NOT NULL"), "source")
    return found.withColumns({"mean_chunks": F.round("mean_chunks", 6), "mean_words": F.round("mean_words", 6)})


@query("A32_truncation", """SELECT l AS "limit", (count(*) FILTER (n_chars > l))::BIGINT AS over, round((count(*) FILTER (n_chars > l)) / count(*), 9) AS ratio, round(sum(least(n_chars, l)) / sum(n_chars), 9) AS kept_share FROM documents, (VALUES (128), (512), (4096)) t(l) GROUP BY l""")
def truncation(spark: SparkSession, folder: str) -> DataFrame:
    found = corpus.truncation(read(spark, folder, "documents"), "n_chars", [128, 512, 4096])
    return found.withColumns({"ratio": F.round("ratio", 9), "kept_share": F.round("kept_share", 9)})


@query("A37_merged_candidates", "SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS topics FROM lineitem GROUP BY 1")
def merged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("topic"))
    return corpus.merged_candidates(rows, "l_partkey", "topic").select("l_partkey", F.array_join("topics", ",").alias("topics"))


@query("F33_leaked_keys", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'gold,secret' ELSE 'secret' END AS leaked FROM orders WHERE o_orderstatus IN ('F', 'P')")
def leaked_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as nested records that have banned names two and three levels down where their status says so."""
    deep = F.when(F.col("o_orderstatus") == "F", F.struct(F.lit(1).alias("gold")))
    inner = F.when(F.col("o_orderstatus") != "O", F.array(F.struct(F.lit("x").alias("secret"), deep.alias("more"))))
    rows = read(spark, folder, "orders").select("o_orderkey", F.to_json(F.struct("o_custkey", F.struct(inner.alias("list")).alias("a"))).alias("j"))
    return corpus.leaked_keys(rows, "j", ["secret", "gold", "o_orderkey"]).select("o_orderkey", F.array_join(F.array_sort("leaked"), ",").alias("leaked"))


@query("E9_compared_runs", """WITH a AS (SELECT o_custkey AS k, avg(o_totalprice::DECIMAL(18, 2)) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice::DECIMAL(18, 2)) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, CASE WHEN a.m IS NULL THEN 'only_second' WHEN b.m IS NULL THEN 'only_first' WHEN b.m - a.m > 1e-6 THEN 'improved' WHEN b.m - a.m < -1e-6 THEN 'worsened' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (k)""")
def compared_runs(spark: SparkSession, folder: str) -> DataFrame:
    run = lambda s: read(spark, folder, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("m"))
    return corpus.compared(run("F"), run("O"), "k", "m", 1e-6)


@query("F5_period_starts", "SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE::VARCHAR AS week, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month FROM orders")
def period_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks that end on a Sunday begin on a Monday."""
    start = lambda unit: F.to_date(F.date_trunc(unit, "o_orderdate")).cast("string").alias(unit)
    return read(spark, folder, "orders").select("o_orderkey", start("week"), start("month"))


@query("C9_evidence_need", """WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS own, o_totalprice > 150000 AS must, CASE o_custkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'optional' ELSE 'none' END AS asked, o_custkey % 11 = 0 AS gone, o_custkey % 13 = 0 AS open FROM orders),
n AS (SELECT *, CASE WHEN gone THEN '' ELSE concat_ws(',', CASE WHEN own THEN 'training_records' END, CASE WHEN must OR asked = 'required' THEN 'literature' END) END AS required, CASE WHEN NOT gone AND asked = 'optional' AND NOT must THEN 'literature' ELSE '' END AS optional FROM o)
SELECT o_orderkey, required, optional, CASE WHEN open OR (NOT gone AND required = '' AND optional = '') THEN 'clarification_required' ELSE 'resolved' END AS status FROM n""")
def evidence_need(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("o_custkey")
    asked = F.when(c % 3 == 0, "required").when(c % 3 == 1, "optional").otherwise("none")
    found = workflow.evidence_need(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000, asked, c % 11 == 0, c % 13 == 0)
    return read(spark, folder, "orders").select("o_orderkey", found.alias("n")).select("o_orderkey", F.array_join("n.required", ",").alias("required"), F.array_join("n.optional", ",").alias("optional"), "n.status")


@query("F26_personal_leaks", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 2 = 0 THEN 'personal_date' END, CASE WHEN o_custkey % 3 = 0 THEN 'personal_session_condition' END, CASE WHEN o_custkey % 5 = 0 THEN 'canonical_catalog_form' END, CASE WHEN o_custkey % 7 = 0 THEN 'record_judgement' END) AS leaks FROM orders""")
def personal_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with parts of the asker's records as the customer's number says; plain numbers in them are no leak."""
    c = F.col("o_custkey")
    date = F.when(c % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M'월' d'일'"))
    said = F.concat_ws(" ", F.lit("hypertrophy after 12 weeks with 80 %"), F.when(c % 2 == 0, date), F.when(c % 3 == 0, F.lit("over the last 5 sessions")), F.when(c % 5 == 0, F.lit("Bench Press (Barbell)")), F.when(c % 7 == 0, F.lit("Median e1RM")))
    return read(spark, folder, "orders").select("o_orderkey", F.array_join(workflow.personal_leaks(said), ",").alias("leaks"))


@query("E10_adoption", """WITH a AS (SELECT o_custkey AS k, avg(o_totalprice::DECIMAL(18, 2)) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice::DECIMAL(18, 2)) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
c AS (SELECT a.m AS x, b.m AS y FROM a FULL JOIN b USING (k)), d AS (SELECT count(*) FILTER (y - x > 1e-6)::BIGINT AS improved, count(*) FILTER (y - x < -1e-6)::BIGINT AS worsened, count(*) FILTER (x IS NULL OR y IS NULL)::BIGINT AS missing FROM c)
SELECT *, missing = 0 AND improved > worsened AS adopt FROM d""")
def adoption(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.adopted_share(compared_runs(spark, folder))


@query("F23_literature_clauses", """SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'hypertrophy of ' || o_custkey || '?' WHEN 1 THEN 'what of hypertrophy and more' WHEN 2 THEN 'what research says' ELSE 'show my log, please.' END AS clause FROM orders""")
def literature_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that ask for records first and for literature in a later clause."""
    c = F.col("o_custkey")
    said = (
        F.when(c % 4 == 0, F.concat(F.lit("show my log and hypertrophy of "), c, F.lit("? Thanks."))).when(c % 4 == 1, F.lit(" show my log; what of hypertrophy and more"))
        .when(c % 4 == 2, F.lit("show my log, what research says")).otherwise(F.lit("show my log, please."))
    )
    return read(spark, folder, "orders").select("o_orderkey", workflow.literature_clause(said, ["Hypertrophy", "overload"], ["research"]).alias("clause"))
