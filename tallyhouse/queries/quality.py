"""Queries that check constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import quality
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import flagged
from tallyhouse.sources.tables import SETS, read


@query("X2_check_violations", SETS + """SELECT 'e1rm_implies_volume' AS "check", (count(*) FILTER (in_e1rm AND NOT in_volume))::BIGINT AS violations FROM eligible UNION ALL SELECT 'reason_if_blocked', (count(*) FILTER (blocked AND outlier_reason = ''))::BIGINT FROM eligible
UNION ALL SELECT 'light', (count(*) FILTER (NOT weight < 1000))::BIGINT FROM eligible""")
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return quality.violations(flagged(spark, folder), {"e1rm_implies_volume": ~c("in_e1rm") | c("in_volume"), "reason_if_blocked": ~c("blocked") | (c("outlier_reason") != ""), "light": c("weight") < 1000})


@query("X3_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    return quality.repeated_keys(read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("X3_J5_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    return quality.orphans(read(spark, folder, "labels").select("doc_id", "quality"), read(spark, folder, "embeddings"), "doc_id", "vec_id")


@query("X12_same_build", """WITH a AS (SELECT l_orderkey, l_returnflag = 'N' AS x FROM lineitem), b AS (SELECT l_orderkey, l_linestatus = 'O' AS x FROM lineitem)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b))::BIGINT AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))::BIGINT AS only_second""")
def same_build(spark: SparkSession, folder: str) -> DataFrame:
    """Two ways to tell open lines, which agree on most."""
    rows = read(spark, folder, "lineitem")
    return quality.same_build(rows.select("l_orderkey", (F.col("l_returnflag") == "N").alias("x")), rows.select("l_orderkey", (F.col("l_linestatus") == "O").alias("x")))


@query("U4_set_algebra", "SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT vec_id FROM embeddings WHERE label = 3")
def set_algebra(spark: SparkSession, folder: str) -> DataFrame:
    labels, vectors = read(spark, folder, "labels"), read(spark, folder, "embeddings")
    both = labels.where("toxic = 1").select("doc_id").intersect(labels.where("quality = 1").select("doc_id"))
    return both.subtract(vectors.where("label = 3").select("vec_id"))


@query("U3_union", "SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings")
def union(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "labels").select("doc_id").union(read(spark, folder, "embeddings").select("vec_id")).distinct()


@query("J18_completeness", "SELECT coalesce(doc_id, vec_id) AS id, doc_id IS NULL AS no_label, vec_id IS NULL AS no_vector FROM labels FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    a, b = read(spark, folder, "labels").select("doc_id"), read(spark, folder, "embeddings").select("vec_id")
    both = a.join(b, a.doc_id == b.vec_id, "full_outer").where("doc_id IS NULL OR vec_id IS NULL")
    return both.select(F.coalesce("doc_id", "vec_id").alias("id"), F.col("doc_id").isNull().alias("no_label"), F.col("vec_id").isNull().alias("no_vector"))


@query("F28_token_cost", """WITH u AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN turn > 0 THEN length(text) // 2 ELSE 0 END AS c FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, round(((n - c) * 0.5 + c * 0.125 + (n % 97) * 1.5) / 1000000, 12)::DOUBLE AS cost FROM u""")
def token_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Letters as tokens: half of those after the first turn are cached."""
    from tallyhouse.functions.text import token_cost

    n = F.length("text")
    rows = read(spark, folder, "conversations").where("text IS NOT NULL").select("conv_id", "turn", n.alias("i"), F.when(F.col("turn") > 0, F.floor(n / 2)).otherwise(0).alias("c"), (n % 97).alias("o"))
    return rows.select("conv_id", "turn", token_cost("i", "c", "o", 0.5, 0.125, 1.5).alias("cost"))
