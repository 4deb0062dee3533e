"""Gates, preservation checks and public views, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import gates
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import read


def _papers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, folder, "documents")
    papers = d.groupBy(F.col("source").alias("paper_id")).agg(F.min("doc_id").cast("string").alias("pmid"), F.max("doc_id").cast("string").alias("pmcid"), F.min("lang").alias("doi"), F.min("lang").alias("title"), F.collect_set("lang").alias("topics"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.col("lang").alias("section"), "text", F.sha2("text", 256).alias("text_sha256"), words.alias("words"), F.lit("v1").alias("version"))
    return papers.withColumns({"version": F.lit("v1"), "source_sha256": F.sha2("paper_id", 256)}), chunks


@query("X5_corpus_checks", r"""WITH p AS (SELECT source, min(doc_id) AS a, max(doc_id) AS z, min(lang) AS l FROM documents GROUP BY 1), c AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words FROM documents),
s AS (SELECT source, lang, count(*) AS n, min(words) AS w FROM c GROUP BY ALL)
SELECT 'paper_count_in_target_range' AS "check", count(*) BETWEEN 5 AND 30 AS ok FROM p UNION ALL SELECT 'paper_ids_unique', true UNION ALL SELECT 'pmids_unique_and_present', count(DISTINCT a) = count(*) FROM p UNION ALL SELECT 'pmcids_unique_and_present', count(DISTINCT z) = count(*) FROM p
UNION ALL SELECT 'dois_unique', count(DISTINCT l) = count(l) FROM p UNION ALL SELECT 'required_metadata_present', bool_and(coalesce(trim(l), '') <> '') FROM p UNION ALL SELECT 'source_hash_present', true
UNION ALL SELECT 'topic_coverage_present', (SELECT count(DISTINCT lang) FROM documents WHERE lang IN ('en', 'xx')) = 2 UNION ALL SELECT 'chunk_ids_unique', count(DISTINCT doc_id) = count(*) FROM documents
UNION ALL SELECT 'chunk_text_and_hash_present', bool_and(coalesce(trim(text, ' '), '') <> '') FROM documents UNION ALL SELECT 'chunk_word_limit_respected', bool_and(words <= 610) FROM c UNION ALL SELECT 'every_paper_has_chunks', true
UNION ALL SELECT 'every_chunk_maps_to_paper', bool_and(source IS NOT NULL) FROM documents UNION ALL SELECT 'short_chunks_are_complete_sections', bool_and(w >= 80 OR n = 1) FROM s UNION ALL SELECT 'corpus_version_constant', true""")
def corpus_checks(spark: SparkSession, folder: str) -> DataFrame:
    return gates.corpus_checks(*_papers(spark, folder), "v1", 550, 60, 80, ["en", "xx"], (5, 30))


@query("R18_Z13_vector_checks", """WITH v AS (SELECT *, len(embedding) AS n, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings)
SELECT 'one_vector_each' AS "check", count(DISTINCT vec_id) = count(*) AS ok FROM v UNION ALL SELECT 'size', coalesce(bool_and(n = 64), false) FROM v UNION ALL SELECT 'finite', coalesce(bool_and(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0), false) FROM v
UNION ALL SELECT 'unit_norm', coalesce(bool_and(abs(norm - 1) <= 1e-3), false) FROM v UNION ALL SELECT 'every_chunk_has_a_vector', NOT EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) UNION ALL SELECT 'every_vector_has_a_chunk', NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))""")
def vector_checks(spark: SparkSession, folder: str) -> DataFrame:
    return gates.vector_checks(read(spark, folder, "embeddings"), read(spark, folder, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "embedding", 64)


@query("F25_lost_in_translation", """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'number_preservation' END, CASE WHEN l_returnflag IN ('R', 'A') THEN 'unit_preservation' END, CASE WHEN l_linestatus = 'F' THEN 'acronym_preservation' END) AS lost FROM lineitem""")
def lost_in_translation(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of two languages whose number, unit or acronym is another one where the line's flags say so."""
    n, flag = F.col("l_quantity").cast("int"), F.col("l_returnflag")
    source = F.concat(F.lit("Lift "), n, F.lit(" kilograms 3 times at RPE"))
    other = F.concat(F.when(flag == "R", n + 1).otherwise(n), F.when(flag == "A", "파운드").otherwise("kg"), F.lit("를 3회 "), F.when(F.col("l_linestatus") == "F", "RIR").otherwise("RPE"))
    return read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(gates.lost_in_translation(source, other), ",").alias("lost"))


@query("R19_prepared_queries", """SELECT conv_id, turn, CASE WHEN f IS NULL THEN text || '!' ELSE text END AS lexical, text AS dense, coalesce(f, 'none') AS fallback
FROM (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN coalesce(trim(text), '') = '' THEN 'missing_output' WHEN turn % 3 = 0 THEN 'leak' END AS f FROM conversations)""")
def prepared_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    found = gates.prepared_query("translated_lexical", F.col("text"), F.lit(None).cast("string"), F.when(F.trim("text") != "", F.concat("text", F.lit("!"))), F.when(F.col("turn") % 3 == 0, F.lit("leak")))
    return rows.select("conv_id", "turn", found.alias("p")).select("conv_id", "turn", "p.lexical", "p.dense", F.coalesce("p.fallback", F.lit("none")).alias("fallback"))


@query("E17_grader_disagreement", """SELECT CASE WHEN quality IS NULL OR toxic IS NULL THEN 'unknown' WHEN quality = 1 AND toxic <> 1 THEN 'false_sufficient' WHEN quality <> 1 AND toxic = 1 THEN 'false_insufficient' ELSE 'agree' END AS verdict, count(*)::BIGINT AS cases FROM labels GROUP BY 1""")
def grader_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    verdict = gates.grader_disagreement(F.col("quality") == 1, F.col("toxic") == 1)
    return read(spark, folder, "labels").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("cases"))


@query("E18_eligible_cases", """WITH c AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS answerable, count(*) FILTER (o_totalprice > 200000) AS groups, count(*) FILTER (o_orderpriority LIKE '5%') AS gone FROM orders GROUP BY 1)
SELECT CASE WHEN NOT answerable THEN 'unanswerable' WHEN groups = 0 THEN 'no_required_gold' WHEN gone > 0 THEN 'gold_outside_corpus' ELSE 'eligible' END AS state, count(*)::BIGINT AS cases FROM c GROUP BY 1""")
def eligible_cases(spark: SparkSession, folder: str) -> DataFrame:
    cases = read(spark, folder, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("answerable"), F.count_if(F.col("o_totalprice") > 200000).alias("required_groups"), F.count_if(F.startswith("o_orderpriority", F.lit("5"))).alias("gold_missing"))
    return gates.eligible_cases(cases).groupBy(F.coalesce("excluded", F.lit("eligible")).alias("state")).agg(F.count("*").alias("cases"))


@query("C20_Z32_public_view", "SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey)[1:3], ',') AS hits, greatest(count(*) - 3, 0)::INT AS hits_omitted FROM lineitem GROUP BY 1")
def public_view(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("hits"), F.first("l_suppkey").alias("secret"))
    return gates.public_view(rows, ["l_orderkey", "hits", "not_there"], {"hits": 3}).withColumn("hits", F.array_join("hits", ","))


@query("P18_json_safe", """SELECT o_orderkey, sha256('{"day":"' || o_orderdate::DATE || '","note":' || CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',"whole":' || floor(o_totalprice)::BIGINT || '.0}') AS line_sha256 FROM orders WHERE o_totalprice < 10000000""")
def json_safe(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_orderkey", F.floor("o_totalprice").cast("decimal(18,2)").alias("whole"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("note"))
    return rows.select("o_orderkey", F.sha2(gates.json_safe(rows.drop("o_orderkey")), 256).alias("line_sha256"))


@query("Z8_named_nodes", "SELECT CASE event_type WHEN 'click' THEN 'press' ELSE event_type END AS node, count(*)::BIGINT AS n FROM events GROUP BY 1")
def named_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").groupBy(gates.named_nodes(F.col("event_type"), {"click": "press"}).alias("node")).agg(F.count("*").alias("n"))
