"""Weekly metrics, alias evidence, metrics at two depths, counts that data give themselves, and grades that fail closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import cleaning, evaluation, metrics, records, timeseries
from tallyhouse.plans import grading
from tallyhouse.plans.registry import query
from tallyhouse.queries.evaluation import GROUPS, INDEX, METRICS, gold_groups, lexical
from tallyhouse.queries.records import dates_as_text, flagged, r6
from tallyhouse.sources.tables import SETS, log_sets, read


@query("A20_weekly_metrics", SETS + """, weekly AS (SELECT exercise_name, date_trunc('week', started_at)::DATE AS week, count(*) AS sets, sum(reps) AS reps, sum((weight * reps)::DECIMAL(18, 6)) AS volume, count(DISTINCT session_id) AS sessions FROM eligible WHERE in_volume GROUP BY ALL)
SELECT e.exercise_name, e.week::VARCHAR AS week, coalesce(w.sets, 0)::BIGINT AS sets, coalesce(w.reps, 0)::BIGINT AS reps, round(coalesce(w.volume, 0)::DECIMAL(28, 6), 2)::DOUBLE AS volume, coalesce(w.sessions, 0)::BIGINT AS sessions
FROM (SELECT exercise_name, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS week FROM weekly GROUP BY 1) e LEFT JOIN weekly w USING (exercise_name, week)""")
def weekly_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Sets, repetitions, volume and sessions of every week from an exercise's first to its last."""
    rows = timeseries.weekly_metrics(flagged(spark, folder), "exercise_name")
    return dates_as_text(rows).withColumn("volume", F.round("volume", 2).cast("double"))


@query("A21_trend_dates", SETS + """SELECT exercise_name, arg_min(started_at, (-best, started_at, session_id)) AS peak_at, arg_max(started_at, (started_at, session_id)) AS latest_at FROM bests GROUP BY 1""")
def trend_dates(spark: SparkSession, folder: str) -> DataFrame:
    """When each exercise's peak was, the first of equal ones, and its latest session."""
    return timeseries.peak_and_latest(metrics.session_bests(flagged(spark, folder)), "exercise_name").select("exercise_name", "peak_at", "latest_at")


ALSO = """, named AS (SELECT *, nullif(notes, 'N') AS note FROM sets UNION ALL SELECT * REPLACE (exercise_name || ' (alt)' AS exercise_name, CASE WHEN exercise_name = 'Brand#22' AND set_order % 3 = 0 OR exercise_name = 'Brand#33' AND set_order % 3 > 0 THEN weight + 1 ELSE weight END AS weight), nullif(notes, 'N') AS note
  FROM sets WHERE exercise_name IN ('Brand#11', 'Brand#22', 'Brand#33') AND set_order <= 5)
"""


@query("A22_alias_evidence", SETS + ALSO + """, c AS (SELECT DISTINCT session_id, started_at, set_order, weight, reps, distance, seconds, note, workout_notes, exercise_name FROM named), n AS (SELECT exercise_name, count(*) AS n FROM named GROUP BY 1),
p AS (SELECT a.exercise_name AS name_a, b.exercise_name AS name_b, count(*) AS pairs FROM c a JOIN c b ON a.session_id = b.session_id AND a.started_at = b.started_at AND a.set_order = b.set_order AND a.weight = b.weight AND a.reps = b.reps AND a.distance = b.distance AND a.seconds = b.seconds
  AND a.note IS NOT DISTINCT FROM b.note AND a.workout_notes IS NOT DISTINCT FROM b.workout_notes AND a.exercise_name < b.exercise_name GROUP BY ALL)
SELECT name_a, name_b, pairs::BIGINT AS pairs, round(pairs / least(x.n, y.n)::DOUBLE, 6) AS coverage, pairs / least(x.n, y.n)::DOUBLE >= 0.8 AS high FROM p JOIN n x ON x.exercise_name = name_a JOIN n y ON y.exercise_name = name_b WHERE pairs >= 10 AND pairs / least(x.n, y.n)::DOUBLE >= 0.5""")
def alias_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Second names of three exercises, of which one stands on the same sets, one on two thirds of them and one on a third."""
    sets = log_sets(spark, folder).withColumn("note", F.nullif("notes", F.lit("N")))
    name, third = F.col("exercise_name"), F.col("set_order") % 3
    moved = F.when((name == "Brand#22") & (third == 0) | (name == "Brand#33") & (third > 0), F.col("weight") + 1).otherwise(F.col("weight"))
    also = sets.where(name.isin("Brand#11", "Brand#22", "Brand#33") & (F.col("set_order") <= 5)).withColumns({"weight": moved, "exercise_name": F.concat(name, F.lit(" (alt)"))})
    same = ["session_id", "started_at", "set_order", "weight", "reps", "distance", "seconds", "note", "workout_notes"]
    return cleaning.alias_evidence(sets.unionByName(also), "exercise_name", same).withColumn("coverage", F.round("coverage", 6))


AT = {k: METRICS.replace("rank <= 10", f"rank <= {k}") for k in (5, 10)}
BOTH = INDEX + ", " + GROUPS + "hits AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 10)"
SHOWN = "count(*)::BIGINT AS cases, round(avg(group_recall), 6) AS group_recall, round(avg(complete), 6) AS complete, round(avg(chunk_recall), 6) AS chunk_recall, round(avg(reciprocal_rank), 6) AS reciprocal_rank"


@query("E6_macro_at_5_and_10", BOTH + ", " + ", ".join(f"m_{k} AS (WITH {AT[k]} SELECT * FROM m)" for k in AT) + " " + " UNION ALL ".join(f"SELECT {k} AS k, {SHOWN} FROM m_{k}" for k in AT))
def macro_at(spark: SparkSession, folder: str) -> DataFrame:
    """Means over queries at two depths from one list of hits."""
    gold, hits = gold_groups(spark, folder), lexical(spark, folder, 10)
    parts = [evaluation.macro(evaluation.retrieval_metrics(gold, hits, k)).withColumn("k", F.lit(k)) for k in (5, 10)]
    return parts[0].unionByName(parts[1]).withColumns(r6("group_recall", "complete", "chunk_recall", "reciprocal_rank"))


@query("X4_reconciled_counts", """SELECT 'lines' AS "check", (SELECT sum(n) FROM (SELECT max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey))::BIGINT AS expected, count(*)::BIGINT AS found, count(*) = (SELECT sum(n) FROM (SELECT max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)) AS ok FROM lineitem
UNION ALL SELECT 'orders', (SELECT count(DISTINCT l_orderkey) FROM lineitem)::BIGINT, count(*)::BIGINT, count(*) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) FROM orders
UNION ALL SELECT 'customers', (SELECT max(c_custkey) - min(c_custkey) + 1 FROM customer)::BIGINT, count(*)::BIGINT, count(*) = (SELECT max(c_custkey) - min(c_custkey) + 1 FROM customer) FROM customer
UNION ALL SELECT 'regions', (SELECT count(DISTINCT n_regionkey) FROM nation)::BIGINT, count(*)::BIGINT, count(*) = (SELECT count(DISTINCT n_regionkey) FROM nation) FROM region""")
def reconciled_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What tables hold against what other columns say they hold: the last line of each order, orders of lines, the span of keys, regions of nations."""
    lines, orders, customers, nations, regions = (read(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    said = {
        "lines": lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).agg(F.sum("n").alias("expected")), "orders": lines.agg(F.count_distinct("l_orderkey").alias("expected")),
        "customers": customers.agg((F.max("c_custkey") - F.min("c_custkey") + 1).alias("expected")), "regions": nations.agg(F.count_distinct("n_regionkey").alias("expected")),
    }
    out = None
    for name, table in (("lines", lines), ("orders", orders), ("customers", customers), ("regions", regions)):
        row = said[name].crossJoin(F.broadcast(table.agg(F.count("*").alias("found")))).select(F.lit(name).alias("check"), F.col("expected").cast("long").alias("expected"), "found", (F.col("expected") == F.col("found")).alias("ok"))  # one row each
        out = row if out is None else out.union(row)
    return out


@query("F6_display_names", """SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace('  ' || p_name || '   (  ' || p_brand || '  ) ', '\\s+', ' ', 'g')), '\\( ', '(', 'g'), ' \\)', ')', 'g') AS name FROM part""")
def display_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names with spaces around and inside brackets, as they are shown."""
    rows = read(spark, folder, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("   (  "), "p_brand", F.lit("  ) ")).alias("raw"))
    return rows.select("p_partkey", text.display_name("raw").alias("name"))


@query("P5_one_version", "SELECT o_orderpriority AS version, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY 1")
def one_version(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one version alone; here priorities stand for versions and the first of them is asked for."""
    orders = read(spark, folder, "orders").withColumn("preprocessing_version", F.col("o_orderpriority"))
    first = orders.agg(F.min("preprocessing_version")).collect()[0][0]
    return records.of_version(orders, first).groupBy(F.col("preprocessing_version").alias("version")).agg(F.count("*").alias("n"))


@query("O9_group_union", SETS + "SELECT set_id, row_number() OVER (ORDER BY started_at, session_id, set_order, set_id) AS place FROM sets WHERE exercise_name IN ('Brand#11', 'Brand#12') AND session_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-02-01')")
def group_union(spark: SparkSession, folder: str) -> DataFrame:
    """One month's sets of a group of exercises in their common order."""
    rows = log_sets(spark, folder).where((F.col("started_at") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("started_at") < F.lit("1995-02-01").cast("timestamp_ntz")))
    return records.group_union(rows, ["Brand#11", "Brand#12"]).select("set_id", F.col("place").cast("long").alias("place"))


@query("Z27_fail_closed_grades", """WITH d AS (SELECT doc_id, quality, toxic, doc_id % 9 AS f FROM labels),
e AS (SELECT *, CASE f WHEN 0 THEN 'provider_failure' WHEN 1 THEN 'provider_failure' WHEN 2 THEN 'schema_failure' WHEN 3 THEN 'schema_failure' WHEN 4 THEN 'component_failure' WHEN 5 THEN 'component_failure' END AS error FROM d)
SELECT doc_id AS case_id, error IS NULL AND quality = 1 AND f <> 6 AS sufficient, CASE WHEN error IS NOT NULL THEN 2 ELSE (quality <> 1)::INT + (f = 6)::INT END AS missing, error FROM e""")
def fail_closed_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as cases of two components: an error, no output, broken JSON, an unknown status, a component too few or twice, an anchor that wasn't supplied, and sound ones."""
    d = read(spark, folder, "labels").withColumn("f", F.col("doc_id") % 9)
    one = lambda name, status, anchors: F.concat(F.lit(f'{{"component_id":"{name}","status":"'), status, F.lit('","anchors":['), anchors, F.lit("]}"))
    own, other = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"')), F.lit('"none"')
    a = one("a", F.when(F.col("f") == 3, "perhaps").when(F.col("quality") == 1, "supported").otherwise("missing"), F.concat(own, F.lit(","), own))
    b = one("b", F.lit("supported"), F.when(F.col("f") == 6, other).otherwise(F.concat(other, F.lit(","), own)))
    whole = F.concat(F.lit('{"components":['), a, F.when(F.col("f") == 4, "").otherwise(F.concat(F.lit(","), F.when(F.col("f") == 5, a).otherwise(b))), F.lit("]}"))
    output = F.when(F.col("f") == 1, F.lit(None).cast("string")).when(F.col("f") == 2, F.left(whole, F.length(whole) - 2)).otherwise(whole)
    cases = d.select(F.col("doc_id").alias("case_id"), F.array(F.lit("a"), F.lit("b")).alias("required"), F.array(F.col("doc_id").cast("string")).alias("supplied"), F.when(F.col("f") == 0, "timeout").alias("provider_error"), output.alias("output"))
    return grading.graded(cases)[1]
