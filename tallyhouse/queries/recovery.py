"""The recovery loop over all benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import retrieval
from tallyhouse.plans import recovery
from tallyhouse.plans.registry import query
from tallyhouse.queries.retrieval import INDEX, WORDS
from tallyhouse.sources.tables import chunks, read

#: Words of a passage that each round asks for, passages of evidence, and places that the right one has to stand in.
ASKED, KEPT, SHOWN, ROUNDS = 4, 10, 3, 3


def _round(r: int) -> str:
    """One round as SQL: the open questions' next words, their scores, what is fused, and who is still open."""
    some = f"SELECT item_id AS query_id, array_to_string(string_split(coalesce(text, ''), ' ')[{ASKED * r + 1}:{ASKED * (r + 1)}], ' ') AS text FROM benchmark"
    opened = "WHERE trim(coalesce(text, '')) <> ''" if r == 0 else f"WHERE item_id IN (SELECT query_id FROM open{r})"
    out = f""", q{r} AS ({some} {opened}),
qt{r} AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({WORDS}) AS term FROM q{r}) GROUP BY ALL),
sc{r} AS (SELECT query_id, chunk_id, sum(qf * ln(1 + (passages - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))) AS score FROM qt{r} JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bm{r} AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc{r} WHERE score > 0) WHERE rank <= {KEPT})"""
    if r == 0:
        out += ", ev0 AS (SELECT *, 0 AS first_round FROM bm0)"
    else:
        out += f""", i{r} AS (SELECT * FROM ev{r - 1} WHERE query_id IN (SELECT query_id FROM open{r})),
j{r} AS (SELECT coalesce(i.query_id, b.query_id) AS query_id, coalesce(i.chunk_id, b.chunk_id) AS chunk_id, i.rank AS x, b.rank AS y, coalesce(i.first_round, {r}) AS first_round FROM i{r} i FULL JOIN bm{r} b ON i.query_id = b.query_id AND i.chunk_id = b.chunk_id),
m{r} AS (SELECT *, greatest(count(x) OVER w, count(y) OVER w) + 1 AS missing FROM j{r} WINDOW w AS (PARTITION BY query_id)),
s{r} AS (SELECT *, coalesce(1.0::DOUBLE / (60 + x), 0) + coalesce(1.0::DOUBLE / (60 + y), 0) AS score FROM m{r}),
ev{r} AS (SELECT query_id, chunk_id, rank, first_round FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(coalesce(x, missing), coalesce(y, missing)), coalesce(x, missing) + coalesce(y, missing), chunk_id) AS rank FROM s{r}) WHERE rank <= {KEPT})"""
    return out + f""", ok{r} AS (SELECT DISTINCT e.query_id FROM ev{r} e JOIN benchmark b ON b.item_id = e.query_id JOIN documents d ON d.doc_id = e.chunk_id WHERE e.rank <= {SHOWN} AND contains(d.text, b.text)),
open{r + 1} AS (SELECT query_id FROM q{r} WHERE query_id NOT IN (SELECT query_id FROM ok{r}) AND {"true" if r == ROUNDS - 1 else f"query_id IN (SELECT item_id FROM benchmark WHERE trim(array_to_string(string_split(text, ' ')[{ASKED * (r + 1) + 1}:{ASKED * (r + 2)}], ' ')) <> '')"}),
end{r} AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM ok{r}) THEN 'answer_ready' ELSE 'abstain_ready' END AS status, {r} AS retries FROM q{r} WHERE query_id IN (SELECT query_id FROM ok{r}) OR {"true" if r == ROUNDS - 1 else f"query_id NOT IN (SELECT query_id FROM open{r + 1})"})"""


LOOP = INDEX.partition("qt AS")[0].rstrip().removesuffix(",") + "".join(map(_round, range(ROUNDS)))


@query("C15_recovery_loop", LOOP + " SELECT n.query_id, n.status, n.retries, coalesce(string_agg(e.chunk_id || ':' || e.first_round, ',' ORDER BY e.rank), '') AS evidence FROM ("
       + " UNION ALL ".join(f"SELECT *, {r} AS r FROM end{r}" for r in range(ROUNDS)) + ") n LEFT JOIN (" + " UNION ALL ".join(f"SELECT *, {r} AS r FROM ev{r}" for r in range(ROUNDS)) + ") e ON e.query_id = n.query_id AND e.r = n.r GROUP BY ALL")
def recovery_loop(spark: SparkSession, folder: str) -> DataFrame:
    """A question is a passage's first words, and then its next ones; evidence suffices if a text with the whole passage is shown."""
    passages, texts = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")), chunks(spark, folder)
    words = F.split("passage", " ", -1)
    part = lambda n: F.array_join(F.slice(words, F.lit(ASKED) * n + 1, F.lit(ASKED)), " ")
    asked = passages.select("query_id", part(F.lit(0)).alias("text"))

    def grade(evidence: DataFrame, open_: DataFrame) -> DataFrame:
        shown = evidence.where(F.col("rank") <= SHOWN).join(passages, "query_id").join(texts.select("chunk_id", "text"), "chunk_id")
        good = shown.groupBy("query_id").agg(F.bool_or(F.contains("text", "passage")).alias("good"))
        return open_.select("query_id").join(good, "query_id", "left").select("query_id", F.coalesce("good", F.lit(False)).alias("sufficient"), F.lit(False).alias("failed"))

    def again(open_: DataFrame, evidence: DataFrame) -> DataFrame:
        """The words that come after those asked for."""
        after = F.filter(F.sequence(F.lit(0), F.lit(ROUNDS)), lambda n: part(n) == F.col("text"))
        return open_.join(passages, "query_id").select("query_id", part(F.element_at(after, 1) + 1).alias("text"))

    outcomes, evidence, _ = recovery.recovery_loop(asked, lambda q: retrieval.bm25(q, texts, KEPT), grade, again, ROUNDS - 1, KEPT)
    listed = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "chunk_id", "first_round").alias("x")))).alias("l"))
    return outcomes.join(listed, "query_id", "left").select("query_id", "status", "retries", F.coalesce(F.array_join(F.transform("l", lambda y: y["x"]), ","), F.lit("")).alias("evidence"))
