"""Queries over the passage corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import retrieval
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import chunks, read

# The tokenizer for an engine without class intersections: the third branch as ranges.
TOKENS = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?|[가-힣]+|[À-ÖØ-öø-ɏªµº]+"
WORDS = f"list_transform(regexp_extract_all(text, '{TOKENS.replace(chr(39), chr(39) * 2)}'), lambda t: replace(lower(t), 'ß', 'ss'))"

INDEX = f"""WITH words AS (SELECT doc_id AS chunk_id, {WORDS} AS t FROM documents),
tf AS (SELECT term, chunk_id, count(*) AS tf, any_value(n) AS length FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS passages, avg(len(t)) AS mean_length FROM words),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(qf * ln(1 + (passages - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 50)
"""
COSINE = """qv AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
cs AS (SELECT query_id, vec_id AS chunk_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE))
  / (sqrt(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: q[i]::DOUBLE * q[i]::DOUBLE)))) AS score FROM qv, embeddings),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cs) WHERE rank <= 50)
"""
FUSED = """fj AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, d.rank AS dense_rank, b.rank AS lexical_rank FROM dn d FULL JOIN bm b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
fm AS (SELECT *, greatest(count(dense_rank) OVER w, count(lexical_rank) OVER w) + 1 AS missing FROM fj WINDOW w AS (PARTITION BY query_id)),
fs AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS score, coalesce(dense_rank, missing) AS a, coalesce(lexical_rank, missing) AS b FROM fm),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(a, b), a + b, chunk_id) AS rank FROM fs) WHERE rank <= 10)
"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def asked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).join(vectors(spark, folder).withColumnRenamed("chunk_id", "query_id"), "query_id").select("query_id", "vector")


def lexical(spark: SparkSession, folder: str, k: int = 50, retain_zero: bool = False) -> DataFrame:
    return retrieval.bm25(questions(spark, folder), chunks(spark, folder), k, retain_zero)


def dense(spark: SparkSession, folder: str, k: int = 50) -> DataFrame:
    return retrieval.exact_cosine(asked_vectors(spark, folder), vectors(spark, folder), k)


def hybrid(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """found: the first 50 of lexical(), where they are there already."""
    return retrieval.rrf(dense(spark, folder), lexical(spark, folder) if found is None else found, 10)


@query("F12_tokens", f"SELECT doc_id, len({WORDS})::INT AS n, array_to_string({WORDS}, ' ') AS tokens FROM documents")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", text.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("R1_postings", INDEX + "SELECT term, chunk_id, tf::BIGINT AS tf, length::INT AS length FROM tf")
def postings(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.postings(chunks(spark, folder))


@query("A27_index_statistics", INDEX + "SELECT passages::BIGINT AS passages, round(mean_length, 6) AS mean_length, (SELECT min(len(t)) FROM words)::INT AS shortest, (SELECT max(len(t)) FROM words)::INT AS longest FROM st")
def statistics(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.statistics(chunks(spark, folder)).withColumn("mean_length", F.round("mean_length", 6))


@query("F14_document_frequency", INDEX + "SELECT term, df::BIGINT AS df, round(ln(1 + (passages - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st")
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks(spark, folder)
    n = F.broadcast(rows.agg(F.count("*").alias("passages")))
    return retrieval.document_frequency(retrieval.postings(rows)).crossJoin(n).select("term", "df", F.round(retrieval.idf(F.col("df"), F.col("passages")), 6).alias("idf"))


@query("R2_bm25_positive_only", INDEX + "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM bm WHERE rank <= 10")
def bm25(spark: SparkSession, folder: str) -> DataFrame:
    return lexical(spark, folder, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("R2_bm25_retain_zero", INDEX + """, z AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents), a AS (SELECT z.*, coalesce(score, 0) AS score FROM z LEFT JOIN sc USING (query_id, chunk_id))
SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM a) WHERE rank <= 20""")
def bm25_retain_zero(spark: SparkSession, folder: str) -> DataFrame:
    return lexical(spark, folder, 20, retain_zero=True).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("R3_exact_cosine", "WITH " + COSINE + "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM dn WHERE rank <= 10")
def exact_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return dense(spark, folder, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("R4_R5_hybrid", INDEX + ", " + COSINE + ", " + FUSED + "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 9) AS score, coalesce(dense_rank, 0)::INT AS dense_rank, coalesce(lexical_rank, 0)::INT AS lexical_rank FROM fused")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid(spark, folder).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.coalesce("lexical_rank", F.lit(0)).alias("lexical_rank"))


@query("R6_recovery_fusion", INDEX + ", " + COSINE + ", " + FUSED + """, i AS (SELECT query_id, chunk_id, rank FROM fused), r AS (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 10),
j AS (SELECT coalesce(i.query_id, r.query_id) AS query_id, coalesce(i.chunk_id, r.chunk_id) AS chunk_id, i.rank AS x, r.rank AS y FROM i FULL JOIN r ON i.query_id = r.query_id AND i.chunk_id = r.chunk_id),
m AS (SELECT *, greatest(count(x) OVER w, count(y) OVER w) + 1 AS missing FROM j WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + x), 0) + coalesce(1.0::DOUBLE / (60 + y), 0) AS score FROM m)
SELECT query_id, chunk_id, rank::INT AS rank, round(score, 9) AS score, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'both_retrievals' WHEN x IS NOT NULL THEN 'initial_only' ELSE 'recovery_only' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(coalesce(x, missing), coalesce(y, missing)), coalesce(x, missing) + coalesce(y, missing), chunk_id) AS rank FROM s) WHERE rank <= 10""")
def recovery(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical(spark, folder)
    rows = retrieval.recovery_fusion(hybrid(spark, folder, found), found.where(F.col("rank") <= 10))
    return rows.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "reason")


@query("R8_W13_parents", INDEX + """, h AS (SELECT bm.*, source AS parent_id FROM bm JOIN documents ON doc_id = chunk_id), p AS (SELECT query_id, parent_id, min(rank) AS child_rank, arg_min(chunk_id, rank) AS best_child FROM h GROUP BY ALL)
SELECT query_id, parent_id, best_child, child_rank::INT AS child_rank, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY child_rank) AS rank FROM p) WHERE rank <= 5""")
def parents(spark: SparkSession, folder: str) -> DataFrame:
    hits = lexical(spark, folder).join(chunks(spark, folder).select("chunk_id", F.col("paper_id").alias("parent_id")), "chunk_id")
    return retrieval.collapse_to_parents(hits, 5).select("query_id", "parent_id", "best_child", "child_rank", "rank")


@query("R8_W14_all_parents", INDEX + """, h AS (SELECT query_id, chunk_id, round(score, 9) AS score, source AS parent_id FROM sc JOIN documents ON doc_id = chunk_id WHERE score > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, chunk_id) AS nth FROM h)
SELECT query_id, parent_id, chunk_id AS best_child, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM c WHERE nth = 1) WHERE rank <= 5""")
def all_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The first parents over all children that match, where R8_W13_parents has those of a fixed pool of children."""
    scores = retrieval.best_scores(questions(spark, folder), chunks(spark, folder), 5, "paper_id")
    return retrieval.best_parents(scores, 5).select("query_id", "parent_id", "best_child", F.round("score", 6).alias("score"), "rank")


@query("A28_corpus_statistics", """SELECT source AS paper_id, count(*)::BIGINT AS chunks, count(DISTINCT lang)::BIGINT AS sections, min(w)::INT AS shortest, max(w)::INT AS longest, round(avg(w), 6) AS mean_words, (count(*) FILTER (w < 80))::BIGINT AS below_minimum
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1""")
def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks(spark, folder).withColumn("w", text.word_count("text"))
    return rows.groupBy("paper_id").agg(F.count("*").alias("chunks"), F.count_distinct("section").alias("sections"), F.min("w").alias("shortest"), F.max("w").alias("longest"), F.round(F.avg("w"), 6).alias("mean_words"), F.count_if(F.col("w") < 80).alias("below_minimum"))


@query("F16_vector_validation", "SELECT count(*)::BIGINT AS vectors, (count(*) FILTER (len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-5))::BIGINT AS valid FROM embeddings")
def vector_validation(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).agg(F.count("*").alias("vectors"), F.count_if(text.valid_vector("vector", 64)).alias("valid"))


@query("A27_vocabulary", INDEX + "SELECT count(DISTINCT term)::BIGINT AS terms, count(*)::BIGINT AS postings, sum(tf)::BIGINT AS words, max(tf)::BIGINT AS most FROM tf")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The index' terms, postings and words, and how often a passage has its commonest term."""
    per_term = retrieval.postings(chunks(spark, folder)).groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("w"), F.max("tf").alias("m"))
    return per_term.agg(F.count("*").alias("terms"), F.sum("n").alias("postings"), F.sum("w").alias("words"), F.max("m").alias("most"))
