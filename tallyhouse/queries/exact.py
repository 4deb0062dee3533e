"""Queries over exact ranks, ordered digests, digests of JSON scalars, periods and conservation of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import conservation, metrics, orderstats, timeseries
from tallyhouse.operators.cleaning import digest
from tallyhouse.plans.registry import query
from tallyhouse.queries.records import CANDIDATES, dates_as_text, r6
from tallyhouse.sources.tables import period_series, read

# Places in the whole order, nodes of a thousand, four levels.
TREE = " ".join(f", l{k} AS (SELECT place // 1000 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM l{k - 1} GROUP BY 1)" for k in range(1, 5))


@query("O8_ordered_digest", "WITH l0 AS (SELECT row_number() OVER (ORDER BY doc_id, d) - 1 AS place, d AS digest FROM (SELECT doc_id, sha256(doc_id || ':' || coalesce(text, '')) AS d FROM documents))" + TREE
       + " SELECT (SELECT count(*) FROM documents)::BIGINT AS rows, coalesce(max(digest), sha256('')) AS digest FROM l4")
def corpus_digest(spark: SparkSession, folder: str) -> DataFrame:
    """All texts in the order of their ids."""
    rows = read(spark, folder, "documents").select("doc_id", "text")
    return orderstats.ordered_digest(rows, ["doc_id"], F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))))


@query("Z24_catalog_digest", "WITH l0 AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS place, sha256(p_brand) AS digest FROM (SELECT DISTINCT p_brand FROM part))" + TREE
       + " SELECT (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS rows, coalesce(max(digest), sha256('')) AS digest FROM l4")
def catalog_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical names in their order."""
    return orderstats.ordered_digest(read(spark, folder, "part").select("p_brand").distinct(), ["p_brand"], F.col("p_brand"))


# A double's text is that of the shortest decimal in the second engine too, but for the point of whole numbers.
@query("F9_json_digest", """SELECT l_orderkey, l_linenumber, left(sha256('[' || l_orderkey || ',' || l_extendedprice::VARCHAR || ',' || (l_discount * 1e-4)::VARCHAR || ',' || coalesce('"' || nullif(l_returnflag, 'N') || '"', 'null') || ',' || (l_linestatus = 'O') || ']'), 24) AS digest
FROM lineitem""")
def json_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of integers, reals large and small, texts, nulls and booleans."""
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_discount") * 1e-4).alias("small"), F.nullif("l_returnflag", F.lit("N")).alias("flag"), (F.col("l_linestatus") == "O").alias("open"))
    return rows.select("l_orderkey", "l_linenumber", digest(rows, "l_orderkey", "l_extendedprice", "small", "flag", "open").alias("digest"))


@query("W10_plateau_loads", CANDIDATES.replace("SELECT f.* FROM found f", ", plateaus AS (SELECT f.series, f.start_at::DATE AS start_on, f.end_at::DATE AS end_on FROM found f") + """),
weekly AS (SELECT o_orderstatus AS series, date_trunc('week', o_orderdate)::DATE AS week, count(*) AS sets, sum(o_totalprice::DECIMAL(18, 6)) AS volume, count(DISTINCT o_orderkey) AS sessions FROM orders GROUP BY ALL),
filled AS (SELECT e.series, e.week, coalesce(w.sets, 0) AS sets, coalesce(w.volume, 0) AS volume, coalesce(w.sessions, 0) AS sessions
  FROM (SELECT series, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS week FROM weekly GROUP BY 1) e LEFT JOIN weekly w USING (series, week)),
parts AS (SELECT f.*, start_on, end_on, CASE WHEN week BETWEEN start_on AND end_on THEN 'during' WHEN week >= start_on - greatest(end_on - start_on, 1)::INT AND week < start_on THEN 'before' END AS part FROM filled f JOIN plateaus p USING (series))
SELECT series, start_on::VARCHAR AS start_on, end_on::VARCHAR AS end_on, part, count(*)::BIGINT AS weeks, round(avg(sets), 6) AS mean_sets, round((sum(volume) / count(*))::DOUBLE, 2) AS mean_volume, round(avg(sessions), 6) AS mean_sessions FROM parts WHERE part IS NOT NULL GROUP BY ALL""")
def plateau_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly load during each plateau and as long before it."""
    found = metrics.plateau_candidates(period_series(spark, folder), "series")
    periods = found.select("series", F.to_date("start_at").alias("start_on"), F.to_date("end_at").alias("end_on"))
    orders = read(spark, folder, "orders")
    sets = orders.select(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("session_id"), F.lit(True).alias("in_volume"), F.col("o_totalprice").alias("weight"), F.lit(1).alias("reps"))
    loads = timeseries.periods_load(sets, periods, "series")
    return dates_as_text(loads).withColumns({**r6("mean_sets", "mean_sessions"), "mean_volume": F.round(F.col("mean_volume").cast("double"), 2)})


#: Words of a chunk, and those that it shares with the one before.
CHUNK, OVERLAP = 60, 12


@query("X6_token_conservation", rf"""WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
made AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest((len(w) - {OVERLAP} + {CHUNK - OVERLAP} - 1) // {CHUNK - OVERLAP}, 1) END)) AS i FROM s),
whole AS (SELECT doc_id, i, w[i * {CHUNK - OVERLAP} + 1:i * {CHUNK - OVERLAP} + {CHUNK}] AS c FROM made),
faulty AS (
  SELECT doc_id, (CASE WHEN doc_id % 5 = 2 AND i <= 1 THEN 1 - i ELSE i END) * 2 AS o, CASE WHEN doc_id % 5 = 4 AND i = 1 THEN c[1:20] || c[23:] ELSE c END AS c FROM whole WHERE NOT (doc_id % 5 = 1 AND i = 1)
  UNION ALL SELECT doc_id, 3, c FROM whole WHERE doc_id % 5 = 3 AND i = 0),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, c FROM faulty),
firsts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, c FROM (SELECT doc_id, c, min(i) AS i FROM chunks GROUP BY ALL)),
both_ AS (SELECT doc_id, 0 AS v, i, c FROM chunks UNION ALL SELECT doc_id, 1, i, c FROM firsts),
dp AS (
  SELECT doc_id, v, CAST(0 AS BIGINT) AS i, CAST([0] AS BIGINT[]) AS places, CAST([] AS VARCHAR[]) AS before FROM s, (VALUES (0), (1)) t(v)
  UNION ALL
  SELECT d.doc_id, d.v, b.i, list_distinct(flatten(list_transform(
      list_filter(range(0, least({OVERLAP}, len(d.before), len(b.c)) + 1), lambda n: d.before[len(d.before) - n + 1:len(d.before)] = b.c[1:n]),
      lambda n: list_transform(list_filter(d.places, lambda p: s.w[p + 1:p + len(b.c) - n] = b.c[n + 1:len(b.c)]), lambda p: p + len(b.c) - n)))), b.c
  FROM dp d JOIN both_ b ON b.doc_id = d.doc_id AND b.v = d.v AND b.i = d.i + 1 JOIN s ON s.doc_id = d.doc_id),
ends AS (SELECT doc_id, v, arg_max(places, i) AS places FROM dp GROUP BY ALL),
counts AS (SELECT doc_id, x, sum(n) AS n FROM (SELECT doc_id, unnest(w) AS x, 1 AS n FROM s UNION ALL SELECT doc_id, unnest(c), -1 FROM chunks) GROUP BY ALL HAVING sum(n) > 0),
lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY 1),
told AS (
  SELECT s.doc_id, len(s.w) AS words, (SELECT count(*) FROM chunks c WHERE c.doc_id = s.doc_id) AS chunks, list_contains(a.places, len(s.w)) AS kept, list_contains(b.places, len(s.w)) AS mended, coalesce(l.n, 0) AS lost_words
  FROM s JOIN ends a ON a.doc_id = s.doc_id AND a.v = 0 JOIN ends b ON b.doc_id = s.doc_id AND b.v = 1 LEFT JOIN lost l ON l.doc_id = s.doc_id)
SELECT doc_id, CAST(words AS INT) AS words, CAST(chunks AS INT) AS chunks, CASE WHEN kept THEN 0 ELSE lost_words END AS lost_words,
  CASE WHEN kept THEN 'kept' WHEN lost_words > 0 THEN 'lost' WHEN mended THEN 'repeated' ELSE 'reordered' END AS status FROM told""")
def token_conservation(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping chunks of every document, four fifths of them with a fault: one chunk gone, two swapped, one repeated, two words dropped."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    step = CHUNK - OVERLAP
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    split = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - OVERLAP) / step).cast("int"), F.lit(1)) - 1
    whole = split.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("doc_id", "i", F.slice("w", F.col("i") * step + 1, CHUNK).alias("c"))
    fault, i = F.col("doc_id") % 5, F.col("i")
    order = 2 * F.when((fault == 2) & (i <= 1), 1 - i).otherwise(i)
    words = F.when((fault == 4) & (i == 1), F.concat(F.slice("c", 1, 20), F.slice("c", 23, CHUNK))).otherwise(F.col("c"))
    made = whole.where(~((fault == 1) & (i == 1))).select("doc_id", order.alias("nth"), words.alias("c"))
    made = made.union(whole.where((fault == 3) & (i == 0)).select("doc_id", F.lit(3).alias("nth"), "c"))
    return conservation.conservation(docs, made.select("doc_id", "nth", F.array_join("c", " ").alias("text")), "doc_id", OVERLAP)
