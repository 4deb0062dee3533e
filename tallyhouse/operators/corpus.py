"""Building a corpus: papers, their paragraphs and chunks, and what is counted and checked about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.passages import ChunkRules, chunked


@dataclass
class Corpus:
    papers: DataFrame
    paragraphs: DataFrame
    chunks: DataFrame


def build(articles: DataFrame, rules: ChunkRules = ChunkRules()) -> Corpus:
    """papers (paper_id, sections, paragraphs, words, status), paragraphs and chunks from paper_id and sections.

    sections is an array of title and paragraphs. White space inside a paragraph is one space;
    paragraphs without words are left out; a paper without any has status `no_text`.
    """
    squeezed = F.trim(F.regexp_replace("p", r"\s+", " "))
    sections = articles.select("paper_id", F.posexplode("sections").alias("section", "s")).select("paper_id", "section", F.col("s.title").alias("title"), F.col("s.paragraphs").alias("ps"))
    rows = sections.select("paper_id", "section", "title", F.posexplode("ps").alias("paragraph", "p")).withColumn("text", squeezed).where("text <> ''").drop("p")
    words = F.size(F.split("text", " "))
    paragraphs = rows.select("paper_id", "section", "paragraph", "title", "text", words.alias("words"), F.sha2("text", 256).alias("text_sha256"))
    counts = paragraphs.groupBy("paper_id").agg(F.count_distinct("section").alias("sections"), F.count("*").alias("paragraphs"), F.sum("words").alias("words"))
    papers = articles.select("paper_id").distinct().join(counts, "paper_id", "left").na.fill(0, ["sections", "paragraphs", "words"])
    papers = papers.withColumn("status", F.when(F.col("paragraphs") > 0, "built").otherwise("no_text"))
    made = chunked(sections, ["paper_id", "section", "title"], "ps", rules)
    chunks = made.withColumn("chunk_id", F.format_string("%s::%02d::%04d", F.col("paper_id").cast("string"), F.col("section"), F.col("nth")))
    return Corpus(papers, paragraphs, chunks)


def build_statistics(chunks: DataFrame, paper: str, text: str = "text") -> DataFrame:
    """papers, chunks, duplicate_texts (chunks beyond the first of each text), mean_chunks and mean_words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    same = chunks.groupBy(F.sha2(text, 256).alias("h")).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicate_texts"))
    counted = chunks.agg(F.count_distinct(paper).alias("papers"), F.count("*").alias("chunks"), F.sum(words).alias("_w"))
    return counted.crossJoin(same).select("papers", "chunks", "duplicate_texts", (F.col("chunks") / F.col("papers")).alias("mean_chunks"), (F.col("_w") / F.col("chunks")).alias("mean_words"))  # one row each


def truncation(rows: DataFrame, size: str, limits: list[int]) -> DataFrame:
    """limit, over, ratio, kept_share: how many texts are longer than each limit, and the share of all tokens that it leaves."""
    every = rows.select(F.col(size).alias("n"), F.explode(F.array(*[F.lit(x) for x in limits])).alias("limit"))
    found = every.groupBy("limit").agg(F.count_if(F.col("n") > F.col("limit")).alias("over"), F.count("*").alias("_all"), F.sum(F.least("n", "limit")).alias("_kept"), F.sum("n").alias("_n"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return found.select("limit", "over", rate("over", "_all").alias("ratio"), rate("_kept", "_n").alias("kept_share"))


def merged_candidates(found: DataFrame, key: str, topic: str) -> DataFrame:
    """Each candidate once with the sorted topics that it was found for."""
    return found.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(topic)).alias("topics"))


def keys_of(json: str):
    """Names of fields at any depth of a JSON text, sorted; null if it is none."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(shape, F.lit(r"(?:OBJECT<|, )`?([^:`<>,]+)`?: "), F.lit(1))))


def leaked_keys(rows: DataFrame, json: str, banned: list[str]) -> DataFrame:
    """Rows that have one of some field names at any depth, with those."""
    return rows.withColumn("leaked", F.array_intersect(keys_of(json), F.array(*[F.lit(b) for b in sorted(banned)]))).where(F.size("leaked") > 0)


def compared(first: DataFrame, second: DataFrame, key: str, metric: str, tolerance: float = 1e-12) -> DataFrame:
    """key, change: improved, worsened, unchanged, or in which of two runs a case is missing."""
    a, b = first.select(key, F.col(metric).alias("_a")), second.select(key, F.col(metric).alias("_b"))
    rows = a.join(b, key, "full_outer")
    delta = F.col("_b") - F.col("_a")
    change = F.when(F.col("_a").isNull(), "only_second").when(F.col("_b").isNull(), "only_first").when(delta > tolerance, "improved").when(delta < -tolerance, "worsened").otherwise("unchanged")
    return rows.select(key, change.alias("change"))


def adopted_share(changes: DataFrame) -> DataFrame:
    """improved, worsened, missing, adopt: a run is adopted if none of its cases are missing and more improve than worsen."""
    count = lambda *names: F.count_if(F.col("change").isin(*names))
    found = changes.agg(count("improved").alias("improved"), count("worsened").alias("worsened"), count("only_first", "only_second").alias("missing"))
    return found.withColumn("adopt", (F.col("missing") == 0) & (F.col("improved") > F.col("worsened")))
