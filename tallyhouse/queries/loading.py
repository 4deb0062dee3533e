"""Loading and reconciling the log, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators import loading
from tallyhouse.operators.cleaning import lineage, processed_reason
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import RAW
from tallyhouse.sources.tables import read

VERSION, HASH = "v1", "0" * 64
MERGE, DEFER = ("Src1", "src0", "merge"), ("src2", "src0", "defer")


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw rows; a set is a text in any letter case, its session the language and length."""
    d = read(spark, folder, "documents")
    return d.select((F.col("doc_id") + 2).alias("source_row"), "text", F.lower("text").alias("set_text"), F.trim("source").alias("raw_name"), F.length(F.lower("text")).alias("started_at"), "n_chars")


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"in_volume": F.col("started_at") % 2 == 0, "in_e1rm": F.col("started_at") % 4 == 0, "version": F.lit(VERSION), "source_hash": F.lit(HASH)})


def lineage_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = lineage(raw(spark, folder), ["text"], ["set_text"])
    name = F.when(F.lower("raw_name") == MERGE[0].lower(), MERGE[1]).otherwise(F.col("raw_name"))
    return _marked(rows.withColumn("set_id", F.format_string("set_%06d", F.col("representative_row").cast("long"))).withColumn("canonical_name", name))


def sets(spark: SparkSession, folder: str) -> DataFrame:
    made = loading.processed(raw(spark, folder), ["text"], ["set_text"], ["raw_name", "started_at"])
    made = _marked(made).withColumn("session_id", F.col("started_at"))
    crowded = made.withColumnsRenamed({"raw_name": "exercise_name"}).withColumn("set_order", F.lit(1))
    return made.join(loading.collision_flags(crowded), "set_id")


SQL = RAW.rstrip() + f""", r AS (SELECT s.*, trim(source) AS raw_name, length(s.set_text) AS started_at FROM s JOIN documents ON doc_id + 2 = source_row),
l2 AS (SELECT *, format('set_{{:06d}}', representative_row) AS set_id, CASE WHEN lower(raw_name) = '{MERGE[0].lower()}' THEN '{MERGE[1]}' ELSE raw_name END AS canonical_name FROM r),
p AS (SELECT set_id, arg_min(raw_name, source_row) AS raw_name, arg_min(started_at, source_row) AS started_at, count(*)::BIGINT AS raw_rows, (count(*) FILTER (row_status = 'excluded_exact_duplicate'))::BIGINT AS exact_duplicates,
  (count(*) FILTER (row_status = 'excluded_alias_shadow'))::BIGINT AS alias_shadows FROM l2 GROUP BY 1),
pc AS (SELECT *, count(*) OVER (PARTITION BY started_at, raw_name) > 1 AS has_collision FROM p)
"""


@query("S13_processed_sets", SQL + "SELECT set_id, raw_name, started_at::INT AS started_at, raw_rows, exact_duplicates, alias_shadows, has_collision FROM pc")
def processed_sets(spark: SparkSession, folder: str) -> DataFrame:
    return sets(spark, folder).select("set_id", "raw_name", "started_at", "raw_rows", "exact_duplicates", "alias_shadows", "has_collision")


ALL_CHECKS = SQL + """, a AS (SELECT (SELECT count(*) FROM r) AS raw_n, (SELECT count(*) FROM l2) AS row_n, (SELECT count(*) FROM pc) AS set_n, (SELECT count(DISTINCT text) FROM documents) AS texts,
  (SELECT count(*) FROM l2 WHERE row_status = 'excluded_exact_duplicate') AS ex, (SELECT count(*) FROM l2 WHERE row_status = 'excluded_alias_shadow') AS sh, (SELECT count(*) FROM l2 WHERE row_status = 'kept') AS kept)
SELECT 'raw_rows_equal_lineage_rows' AS "check", raw_n = row_n AS ok FROM a UNION ALL SELECT 'source_row_is_unique', (SELECT count(DISTINCT source_row) FROM l2) = row_n FROM a
UNION ALL SELECT 'processed_set_id_is_unique', (SELECT count(DISTINCT set_id) FROM pc) = set_n FROM a UNION ALL SELECT 'kept_rows_equal_processed_rows', kept = set_n FROM a
UNION ALL SELECT 'logical_ids_reconcile', (SELECT count(DISTINCT set_id) FROM l2) = set_n FROM a UNION ALL SELECT 'every_processed_id_has_lineage', NOT EXISTS (SELECT set_id FROM pc EXCEPT SELECT set_id FROM l2)
UNION ALL SELECT 'raw_row_counts_reconcile', (SELECT sum(raw_rows) FROM pc) = raw_n FROM a UNION ALL SELECT 'collapsed_count_equation', set_n + ex + sh = raw_n FROM a
UNION ALL SELECT 'per_set_count_equation', (SELECT bool_and(raw_rows = 1 + exact_duplicates + alias_shadows) FROM pc) UNION ALL SELECT 'exact_duplicates_match_raw', ex = raw_n - texts FROM a
UNION ALL SELECT 'exact_duplicate_aggregates_reconcile', (SELECT sum(exact_duplicates) FROM pc) = ex FROM a UNION ALL SELECT 'alias_shadow_aggregates_reconcile', (SELECT sum(alias_shadows) FROM pc) = sh FROM a
UNION ALL SELECT 'source_hash_is_constant', true UNION ALL SELECT 'preprocessing_version_is_constant', true
UNION ALL SELECT 'session_count_preserved', (SELECT count(DISTINCT started_at) FROM pc) = (SELECT count(DISTINCT started_at) FROM r)
UNION ALL SELECT 'metric_flags_reconcile', (SELECT count(*) FROM pc WHERE started_at % 2 = 0) = (SELECT count(*) FROM l2 WHERE row_status = 'kept' AND started_at % 2 = 0)
UNION ALL SELECT 'merge_rules_applied', NOT EXISTS (SELECT 1 FROM l2 WHERE lower(raw_name) = 'src1' AND canonical_name <> 'src0') UNION ALL SELECT 'deferred_rules_not_merged', NOT EXISTS (SELECT 1 FROM l2 WHERE lower(raw_name) = 'src2' AND canonical_name <> raw_name)
UNION ALL SELECT 'collision_ids_present_when_flagged', true"""


@query("X1_all_checks", ALL_CHECKS)
def all_checks(spark: SparkSession, folder: str) -> DataFrame:
    aliases = spark.createDataFrame([MERGE, DEFER], "raw_name string, canonical_name string, decision string")
    return loading.reconciled(raw(spark, folder), sets(spark, folder), lineage_rows(spark, folder), aliases, ["text"], VERSION, HASH)


@query("X1_broken_checks", SQL + """SELECT 'alias_shadow_aggregates_reconcile' AS "check" WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2 AND alias_shadows > 0) UNION ALL SELECT 'collapsed_count_equation' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2)
UNION ALL SELECT 'exact_duplicate_aggregates_reconcile' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2 AND exact_duplicates > 0) UNION ALL SELECT 'every_processed_id_has_lineage' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2)
UNION ALL SELECT 'kept_rows_equal_processed_rows' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2) UNION ALL SELECT 'logical_ids_reconcile' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2)
UNION ALL SELECT 'raw_row_counts_reconcile' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2) UNION ALL SELECT 'session_count_preserved' WHERE (SELECT count(DISTINCT started_at) FROM pc) <> (SELECT count(DISTINCT started_at) FROM pc WHERE raw_rows <= 2)
UNION ALL SELECT 'metric_flags_reconcile' WHERE EXISTS (SELECT 1 FROM pc WHERE raw_rows > 2 AND started_at % 2 = 0)""")
def broken_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Which checks notice that the sets of three and more raw rows were lost."""
    aliases = spark.createDataFrame([MERGE, DEFER], "raw_name string, canonical_name string, decision string")
    lost = sets(spark, folder).where("raw_rows <= 2")
    return loading.reconciled(raw(spark, folder), lost, lineage_rows(spark, folder), aliases, ["text"], VERSION, HASH).where("NOT ok").select("check")


@query("J4_lineage_mismatches", SQL + "SELECT set_id, raw_rows + (CASE WHEN raw_rows > 2 THEN 1 ELSE 0 END) AS raw_rows, raw_rows AS found FROM pc WHERE raw_rows > 2")
def lineage_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Sets whose stored count is one too many, as it was made for those of three and more."""
    wrong = sets(spark, folder).withColumn("raw_rows", F.col("raw_rows") + (F.col("raw_rows") > 2).cast("int"))
    return loading.lineage_mismatches(wrong, lineage_rows(spark, folder))


@query("J9_flags_on_raw_rows", SQL + "SELECT source_row, has_collision FROM l2 JOIN pc USING (set_id)")
def flags_on_raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    return loading.flags_on_rows(lineage_rows(spark, folder), sets(spark, folder), "set_id", ["has_collision"]).select("source_row", "has_collision")


@query("J3_exercise_keys", """SELECT p_partkey, left(sha256('["' || p_brand || '"]'), 24) AS exercise_id FROM part""")
def exercise_keys(spark: SparkSession, folder: str) -> DataFrame:
    parts = read(spark, folder, "part")
    return loading.with_key(parts, loading.dimension(parts, "p_brand", "exercise_id"), "p_brand", "exercise_id").select("p_partkey", "exercise_id")


@query("J6_provenance_conflicts", """SELECT l_orderkey, l_linenumber, unnest(list_filter(['status', 'priority'], lambda c: (c = 'status' AND l_linestatus <> o_orderstatus) OR (c = 'priority' AND left(o_orderpriority, 1) <> l_linenumber::VARCHAR))) AS "column"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def provenance_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("priority"))
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.left("o_orderpriority", F.lit(1)).alias("priority"))
    return loading.conflicts(lines, orders, "order", ["status", "priority"]).select(F.col("order").alias("l_orderkey"), "l_linenumber", "column")


@query("X4_A38_loaded_counts", """SELECT 'orders' AS "check", 15000::BIGINT AS expected, count(*)::BIGINT AS found, count(*) = 15000 AS ok FROM orders UNION ALL SELECT 'late', 7::BIGINT, count(*)::BIGINT, count(*) = 7 FROM orders WHERE o_orderstatus = 'P'""")
def loaded_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders")
    return loading.loaded({"orders": orders, "late": orders.where("o_orderstatus = 'P'")}, {"orders": 15000, "late": 7})


@query("S13_Z5_typed_columns", """SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::VARCHAR AS price, o_orderdate::DATE::VARCHAR AS day, o_orderstatus = 'F' AS done FROM orders""")
def typed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as staged text, read back as typed columns."""
    done = F.when(F.col("o_orderstatus") == "F", " True ").otherwise("no").alias("done")
    staged = read(spark, folder, "orders").select(F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"), F.to_date("o_orderdate").cast("string").alias("day"), done)
    kinds = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("price", T.DecimalType(18, 2)), T.StructField("day", T.DateType()), T.StructField("done", T.BooleanType())])
    rows = loading.typed(staged, kinds)
    return rows.select("o_orderkey", F.col("price").cast("string").alias("price"), F.col("day").cast("string").alias("day"), "done")


@query("S13_cast_failures", """SELECT 'o_orderpriority' AS "column", count(*)::BIGINT AS failures FROM orders WHERE try_cast(trim(o_orderpriority) AS INTEGER) IS NULL UNION ALL SELECT 'o_clerk', 0::BIGINT""")
def cast_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_orderpriority", F.col("o_orderkey").cast("string").alias("o_clerk"))
    return loading.cast_failures(rows, T.StructType([T.StructField("o_orderpriority", T.IntegerType()), T.StructField("o_clerk", T.LongType())]))


@query("W8_broken_ranks", """SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def broken_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").where("l_returnflag <> 'N'")
    return loading.broken_ranks(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "n")


@query("J17_hit_details", "SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def hit_details(spark: SparkSession, folder: str) -> DataFrame:
    hits = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return loading.with_details(hits, read(spark, folder, "part"), "p_partkey", ["p_brand", "p_size"]).select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@query("O3_short_lists", "SELECT c_custkey AS query_id, count(o_orderkey)::BIGINT AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 5")
def short_lists(spark: SparkSession, folder: str) -> DataFrame:
    ranked = read(spark, folder, "orders").select(F.col("o_custkey").alias("query_id"))
    return loading.short_lists(ranked, read(spark, folder, "customer").select(F.col("c_custkey").alias("query_id")), 5)


@query("Z1_all_reasons", SQL + """SELECT set_id, concat_ws(';', CASE WHEN exact_duplicates > 0 THEN 'collapsed_exact_duplicates:' || exact_duplicates END, CASE WHEN alias_shadows > 0 THEN 'collapsed_alias_shadows:' || alias_shadows END,
  CASE WHEN started_at > 5000 THEN 'high_reps_ge_25' END, CASE WHEN has_collision THEN 'set_order_collision' END) AS validation_reason FROM pc""")
def all_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = sets(spark, folder).withColumn("outlier_reason", F.when(F.col("started_at") > 5000, "high_reps_ge_25").otherwise(""))
    return rows.select("set_id", processed_reason().alias("validation_reason"))
