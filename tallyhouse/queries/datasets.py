"""Queries over evaluation data: passages located and covered, and data sets checked as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import datasets, spans
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import read

#: Words of a chunk, and from one chunk's beginning to the next one's.
CHUNK, STEP = 30, 20


def placed_chunks(texts: DataFrame) -> DataFrame:
    """doc_id, nth, start, end: overlapping windows of a document's words."""
    n = texts.select("doc_id", F.size(spans.words("text")).alias("n")).where("n > 0")
    last = F.greatest(F.ceil((F.col("n") - (CHUNK - STEP)) / STEP).cast("int"), F.lit(1)) - 1
    rows = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("nth"))
    return rows.select("doc_id", "nth", (F.col("nth") * STEP).alias("start"), F.least(F.col("nth") * STEP + CHUNK, F.col("n")).alias("end"))


@query("X8_Z40_spans", rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (SELECT doc_id, unnest(range(0, CAST(len(w) AS BIGINT))) AS start FROM d),
firsts AS (SELECT x.doc_id, x.start, d.w[x.start + 1] AS one, d.w[x.start + 2] AS two FROM windows x JOIN d USING (doc_id)),
found AS (SELECT p.item_id, f.doc_id, f.start, f.start + len(p.w) AS "end" FROM firsts f JOIN p ON f.one = p.w[1] AND f.two IS NOT DISTINCT FROM p.w[2] JOIN d ON d.doc_id = f.doc_id WHERE d.w[f.start + 1:f.start + len(p.w)] = p.w),
sized AS (SELECT f.*, greatest(CAST(ceil((len(d.w) - {CHUNK - STEP}) / {STEP}) AS BIGINT), 1) - 1 AS last, len(d.w) AS n FROM found f JOIN d USING (doc_id)),
alone AS (SELECT *, (SELECT min(i) FROM range(0, last + 1) t(i) WHERE i * {STEP} <= start AND least(i * {STEP} + {CHUNK}, n) >= "end") AS one FROM sized),
walk AS (
  SELECT item_id, doc_id, start, "end", last, n, CAST(start AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS taken FROM alone WHERE one IS NULL
  UNION ALL SELECT item_id, doc_id, start, "end", last, n, least(least(pos // {STEP}, last) * {STEP} + {CHUNK}, n), list_append(taken, least(pos // {STEP}, last)) FROM walk WHERE pos < "end"),
greedy AS (SELECT item_id, doc_id, start, taken FROM walk WHERE pos >= "end")
SELECT a.item_id, a.doc_id, CAST(a.start AS INT) AS start, CAST(a."end" AS INT) AS "end", CASE WHEN one IS NOT NULL THEN 'alone' ELSE 'together' END AS how, array_to_string(CASE WHEN one IS NOT NULL THEN [one] ELSE g.taken END, ',') AS chunks
FROM alone a LEFT JOIN greedy g ON g.item_id = a.item_id AND g.doc_id = a.doc_id AND g.start = a.start""")
def passage_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of a benchmark passage in the documents, and the chunks that hold it."""
    docs = read(spark, folder, "documents")
    found = spans.located(read(spark, folder, "benchmark"), docs, "item_id", "doc_id")
    out = spans.covered(found, placed_chunks(docs), ["item_id", "doc_id"], "doc_id")
    return out.select("item_id", "doc_id", "start", "end", "how", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


#: Chunks of the corpus that the cases below are about, and places of a search.
UNIVERSE, PLACES = 12, 6


def gold_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A user is a case; a day of events is a group whose chunks are the numbers in them, one day in ten asks for all of them."""
    events = read(spark, folder, "events").withColumns({"day": F.dayofmonth("ts"), "k": F.get_json_object("props", "$.k").cast("int") % (UNIVERSE + 1)})
    rows = events.groupBy("user_id", "day").agg(F.collect_set(F.when(F.col("k") < UNIVERSE, F.col("k").cast("string"))).alias("chunk_ids"))
    return rows.select(F.col("user_id").alias("case_id"), F.col("day").cast("string").alias("group_id"), F.when(F.col("day") % 10 == 0, "all").otherwise("any").alias("match"), "chunk_ids")


GROUPS = f"""WITH g AS (SELECT user_id AS case_id, day(ts) AS d, list_distinct(list(CASE WHEN k < {UNIVERSE} THEN k END)) AS ids FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % {UNIVERSE + 1} AS k FROM events) GROUP BY ALL),
b AS (SELECT case_id, d, d % 10 = 0 AS whole, len(ids) AS n, list_sum(list_transform(ids, lambda x: 1 << x)) AS bits FROM g),
masks AS (SELECT m FROM range(0, {1 << UNIVERSE}) t(m) WHERE bit_count(m) <= {PLACES}),
least AS (SELECT case_id, (SELECT min(bit_count(m)) FROM masks WHERE len(list_filter(x, lambda y: CASE WHEN y.n = 0 THEN true WHEN y.whole THEN (m & y.bits) <> y.bits ELSE (m & y.bits) = 0 END)) = 0) AS least
  FROM (SELECT case_id, list({{'n': n, 'whole': whole, 'bits': bits}}) AS x FROM b GROUP BY 1))
"""


@query("X7_least_chunks", GROUPS + "SELECT case_id, CAST(coalesce(least, -1) AS INT) AS least FROM least")
def least_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The fewest chunks that meet each user's groups, or -1 where they don't fit into the places of a search."""
    return datasets.least_chunks(gold_groups(spark, folder), "case_id", PLACES).withColumn("least", F.coalesce("least", F.lit(-1)))


@query("X7_dataset_checks", GROUPS + f"""SELECT 'infeasible' AS "check", count(*)::BIGINT AS wrong, count(*) = 0 AS ok FROM least WHERE least IS NULL
UNION ALL SELECT 'repeated_cases', count(*) - count(DISTINCT c_custkey), count(*) = count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
UNION ALL SELECT 'repeated_groups', count(*) - count(DISTINCT (case_id, d)), count(*) = count(DISTINCT (case_id, d)) FROM g
UNION ALL SELECT 'cases_of_category', CAST(sum(abs(n - 60)) AS BIGINT), sum(abs(n - 60)) = 0 FROM (SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT user_id FROM events)) AS n FROM customer GROUP BY 1)
UNION ALL SELECT 'unknown_match', count(*), count(*) = 0 FROM b WHERE whole IS NULL
UNION ALL SELECT 'groups_of_no_case', count(DISTINCT user_id), count(DISTINCT user_id) = 0 FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'cases_without_groups', count(*), count(*) = 0 FROM customer WHERE c_custkey IN (SELECT user_id FROM events) AND c_custkey NOT IN (SELECT case_id FROM g)
UNION ALL SELECT 'unknown_chunks', count(DISTINCT x), count(DISTINCT x) = 0 FROM (SELECT unnest(ids) AS x FROM g) WHERE x IS NOT NULL AND x NOT IN (SELECT DISTINCT p_size % 11 FROM part)""")
def dataset_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with events as cases, their market segment as category, and sizes of parts as the corpus."""
    groups = gold_groups(spark, folder)
    cases = read(spark, folder, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("category"))
    cases = cases.join(groups.select("case_id").distinct(), "case_id", "left_semi")
    kinds = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    chunks = read(spark, folder, "part").select((F.col("p_size") % 11).cast("string").alias("chunk_id")).distinct()
    return datasets.dataset_checks(cases, groups, chunks, dict.fromkeys(kinds, 60), PLACES)
