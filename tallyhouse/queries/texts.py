"""Queries over passages, markup, names and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import periods, text
from tallyhouse.operators import passages
from tallyhouse.plans.registry import query
from tallyhouse.sources import files
from tallyhouse.sources.tables import read


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sections whose lines are paragraphs."""
    rows = read(spark, folder, "documents")
    return rows.select("doc_id", F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "").alias("paragraphs"))


@query("R9_R10_chunks")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return passages.chunked(sections(spark, folder), ["doc_id"])


@query("R14_X6_chunk_conservation", r"""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_filter(regexp_split_to_array(array_to_string(p, ' '), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS words, 0::BIGINT AS over_limit FROM s WHERE len(p) > 0""")
def conservation(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a document by its chunks, less what each repeats of the one before, and chunks beyond what the rules allow."""
    rules = passages.ChunkRules()
    made = passages.chunked(sections(spark, folder), ["doc_id"], rules=rules)
    return made.groupBy("doc_id").agg(F.sum(F.col("fresh").cast("long")).alias("words"), F.count_if((F.col("words") > rules.most + rules.overlap + rules.least) | (F.col("words") < F.col("fresh"))).alias("over_limit"))


@query("R7_children")
def children(spark: SparkSession, folder: str) -> DataFrame:
    return passages.with_children(read(spark, folder, "documents"), "doc_id")


@query("F17_sentence_counts")
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", passages.sentence_count("text").alias("sentences"))


@query("F18_sentence_split", r"SELECT doc_id, len(regexp_extract_all(text, '[.!?]\s+[A-Z0-9]')) + 1 AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.sentences("text")).cast("long").alias("sentences"))


@query("R11_sections")
def page_sections(spark: SparkSession, folder: str) -> DataFrame:
    return passages.sectioned(read(spark, folder, "pages"), "page_id", "html").select("page_id", "nth", "title", F.array_join("paragraphs", "\n").alias("text"))


@query("F11_slugs", "SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_'), 48), ''), 'section') AS slug FROM part")
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", text.slug("p_type").alias("slug"))


@query("F10_text_hashes", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("F6_F24_normalised_names", "SELECT p_partkey, trim(regexp_replace(lower(nfc_normalize(p_name)), '\\s+', ' ', 'g')) AS name FROM part")
def normalised_names(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", text.normalised("p_name").alias("name"))


@query("F27_redaction", """SELECT doc_id, sha256(regexp_replace(text, '(?i)\\b((?:api[_-]?key|token|secret|password)\\s*[=:]\\s*)"?[^\\s",;]+"?', '\\1[redacted]', 'g')) AS text_sha256 FROM documents""")
def redaction(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.sha2(text.redacted("text"), 256).alias("text_sha256"))


@query("F19_F20_periods", """WITH o AS (SELECT *, o_orderdate::DATE AS d, (o_orderdate + INTERVAL 9 DAYS)::DATE AS e, o_orderkey % 7 AS n FROM orders)
SELECT o_orderkey, (CASE WHEN n IN (1, 2, 4) THEN d WHEN n = 3 THEN date_trunc('month', d)::DATE WHEN n = 5 THEN date_trunc('year', d)::DATE END)::VARCHAR AS first_date,
  (CASE WHEN n = 1 THEN d WHEN n IN (2, 4) THEN e WHEN n = 3 THEN last_day(d) WHEN n = 5 THEN (date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE END)::VARCHAR AS last_date,
  CASE n WHEN 0 THEN 'reversed_date_range' WHEN 6 THEN 'missing_date_year' ELSE 'none' END AS error, (CASE WHEN n IN (0, 2, 4) THEN 2 WHEN n = 1 THEN 1 ELSE 0 END)::INT AS dates FROM o""")
def named_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that name an order's day, month or year in one of seven ways."""
    rows = read(spark, folder, "orders")
    n, d, e = F.col("o_orderkey") % 7, F.col("o_orderdate"), F.expr("o_orderdate + INTERVAL 9 DAYS")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    korean = lambda c: F.date_format(c, "yyyy'년' M'월' d'일'")
    said = (
        F.when(n == 0, F.concat(iso(e), F.lit(" - "), iso(d))).when(n == 1, F.concat(F.lit("on "), iso(d))).when(n == 2, F.concat(F.lit("from "), iso(d), F.lit(" ~ "), iso(e)))
        .when(n == 3, F.date_format(d, "yyyy'년' M'월' '기록'")).when(n == 4, F.concat(korean(d), F.lit("부터 "), korean(e), F.lit("까지"))).when(n == 5, F.date_format(d, "yyyy'년'")).otherwise(F.date_format(d, "M'월'"))
    )
    rows = rows.select("o_orderkey", said.alias("q")).withColumn("p", periods.period("q"))
    return rows.select("o_orderkey", "p.first_date", "p.last_date", F.coalesce("p.error", F.lit("none")).alias("error"), F.size(periods.full_dates("q")).alias("dates"))


@query("F21_session_counts", "SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 WHEN o_orderkey % 3 = 1 THEN 3 ELSE 0 END)::INT AS n FROM orders")
def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("o_orderkey")
    said = F.when(i % 3 == 0, F.concat(F.lit("the last "), i % 50, F.lit("-session median"))).when(i % 3 == 1, F.lit("최근 세 세션")).otherwise(F.lit("no number"))
    return read(spark, folder, "orders").select(i, said.alias("q")).select("o_orderkey", F.coalesce(periods.session_count("q"), F.lit(0)).alias("n"))


@query("P13_evidence_predicate", "SELECT doc_id FROM documents WHERE regexp_matches(source, '^src[0-5]$') AND regexp_matches(text, '(?i)\\bthe\\b') AND regexp_matches(text, '(?i)licen[cs]e')")
def evidence_predicate(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").where(F.col("source").rlike("^src[0-5]$") & F.col("text").rlike(r"(?i)\bthe\b") & F.col("text").rlike("(?i)licen[cs]e")).select("doc_id")


@query("Z9_numbers_kept", "SELECT conv_id, turn, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))::INT AS numbers FROM conversations")
def numbers_kept(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("numbers"))


#: Letters and signs of each text without white space, which no cut may lose or repeat.
LETTERS = r"SELECT {} AS {}, length(regexp_replace(coalesce({}, ''), '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS letters FROM {}"


@query("F17_sentence_cover", LETTERS.format("doc_id", "doc_id", "text", "documents"))
def sentence_cover(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", passages.sentence_letters("text").alias("s")).select("doc_id", "s.letters")


@query("R7_J16_children_of_parents", LETTERS.format("item_id", "parent_id", "text", "benchmark"))
def children_of_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The letters of each parent by its children's texts, which a join with it gives."""
    found = passages.children_of_parents(read(spark, folder, "benchmark"), "item_id", most=20)
    return found.groupBy("parent_id").agg(F.sum(F.length(F.regexp_replace("child", r"[ \t\n\x0B\f\r]+", ""))).alias("letters"))


@query("S14_relational_lines", "SELECT 'rows' AS part, count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS total FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT 'parts', count(*)::BIGINT, sum(l_partkey)::BIGINT FROM lineitem")
def relational_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as JSON lines with their parts in a list, read as two tables."""
    lines = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts")).select(F.to_json(F.struct("l_orderkey", "parts")).alias("value"))
    made = files.relational(lines, "l_orderkey long, parts array<long>", "l_orderkey", ["parts"])
    one = lambda df, name, c: df.agg(F.count("*").alias("n"), F.sum(c).alias("total")).select(F.lit(name).alias("part"), "n", "total")
    return one(made["rows"], "rows", "l_orderkey").union(one(made["parts"], "parts", "item"))
