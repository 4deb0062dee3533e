"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to
the shared folder and gives it, read again, to the next. All stages but the last return the columns
of documents. Columns that a document table has besides are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import language_id, mixing, near_dedup, packing, quality_rules
from tallyhouse.llm.common import dropped, id_crc, made, small, staged, table

#: Least score at which a document's predicted language counts as told.
LEAST_LANGUAGE_SCORE = 0.05


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their source share.

    A null text goes, a null source is a source of its own, repeated rows stay repeatedly and are judged
    alike, an empty table stays empty, and other columns of any name are carried along.
    """
    return quality_rules.cleaned(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it as their lang; those without letters or a near profile go.

    Profiles are learned from the documents' own languages, but for the fourth of ids that is held out
    and rows without an id or lang. Equal distances go to the first language by name. Repeated rows stay
    repeatedly, an empty table stays empty, and other columns of any name are carried along.
    """
    learned = language_id.learn(docs.where("doc_id IS NOT NULL").where(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2))
    known = language_id.with_language(docs, learned)
    told = known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return told.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (five-word shingles, similarity 0.8), the one with the smallest id.

    Rows are decided one by one: of repeated rows one stays, and different texts of one id are documents
    of their own, so a text goes only if a near copy of it stays. To tell them apart, rows whose id is
    null or repeated get numbers below all ids; of a class with such rows one of them stays. Texts
    without words are near copies of nothing. An empty table stays empty, and other columns of any name
    are carried along.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    ids = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").select("id")
    repeated = small(staged(ids.select("id", F.lit(True).alias("repeated")), "repeated"))
    lowest = rows.agg(F.coalesce(F.min("id"), F.lit(0))).collect()[0][0]
    same = rows["id"].eqNullSafe(repeated["id"])
    # Numbers are written with their rows, so that they are the same whenever they are read.
    odd = staged(rows.join(repeated, same, "left_semi").select("row", (F.lit(min(lowest, 0) - 1) - F.monotonically_increasing_id()).alias("id")), "numbered")
    every = rows.join(repeated, same, "left_anti").union(odd)
    found = near_dedup.near_duplicates(every.select(F.col("id").alias("doc_id"), "row.text"))
    # Most documents stay, so those that go are the smaller table to meet.
    gone = small(staged(found.where("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "gone"))
    return every.join(gone, "id", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in a random order of the whole.

    A source without characters has none, null ids draw alike, repeated rows are each repeated, an empty
    table stays empty, and other columns of any name, such as rate or copy, are carried along.
    """
    return mixing.replicated(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and offset; a null text is one token, repeated rows are packed
    repeatedly, and an empty table has no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).placements.drop("part", "row")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]

#: Language profiles, signatures and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows; what a stage has written for itself is deleted when the next one's documents are written."""
    docs, older = table(spark, sf_dir, "documents"), set(made())
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        own = [p for p in made() if p not in older]
        dropped(spark, own[:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
