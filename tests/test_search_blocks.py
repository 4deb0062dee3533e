"""Searches pass on the best of each block, not all pairs, and give what a second engine gives for their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import tallyhouse.queries  # noqa: F401
from tallyhouse.operators import retrieval
from tallyhouse.plans.registry import ORACLES, QUERIES

DOCS, ASKED = 1500, 60


def tables(spark, folder, texts, asked):
    """texts: doc_id, text, source."""
    spark.createDataFrame(texts, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(3)
    spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(64)]) for k in range(80)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def same(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    told = lambda frame: sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
    ours, theirs = told(QUERIES[name](spark, folder).toPandas()), told(c.execute(ORACLES[name]).df())
    assert ours == theirs and ours


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    """Every question matches every text."""
    rng = random.Random(1)
    said = lambda n: " ".join(["common", "words", *rng.choices([f"w{k}" for k in range(300)], k=n)])
    return tables(spark, tmp_path_factory.mktemp("common"), [(k, said(6), f"s{k % 40}") for k in range(DOCS)], [(k, said(3)) for k in range(ASKED)])


@pytest.mark.parametrize("name", ["R2_bm25_retain_zero", "E7_metric_changes", "R6_recovery_fusion", "R8_W14_all_parents"])
def test_pairs_of_questions_and_passages_are_not_shuffled(spark, common, name):
    before = shuffled(spark)
    same(spark, common, name)
    assert shuffled(spark) - before < DOCS * ASKED / 2


@pytest.mark.parametrize("name", ["R2_bm25_positive_only", "R2_bm25_retain_zero", "R8_W14_all_parents"])
def test_blocks_of_any_size_with_null_and_empty_texts_and_ties(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 5)
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 40)
    rng = random.Random(2)
    said = lambda n: " ".join(rng.choices("a b c d e f g h".split(), k=n))
    texts = [(k, said(rng.randrange(1, 9)), f"s{k % 7}") for k in range(90)] + [(100 + k, "a a b", "s1") for k in range(30)]
    texts += [(200, None, "s2"), (201, "", "s3"), (202, None, None), (203, "a b b", None), (204, "?!", "s4")]
    same(spark, tables(spark, tmp_path, texts, [(0, "a"), (1, "a b zz"), (2, said(9)), (3, "zz"), (4, None), (5, ""), (6, "h g f e d")]), name)


@pytest.mark.parametrize("name", ["R2_bm25_positive_only"])
def test_rows_of_one_id_are_one_passage(spark, tmp_path, name):
    texts = [(k, f"a b{k % 3} c{k}", f"s{k % 4}") for k in range(20)] + [(5, "b1 a x", "s9"), (7, "a a a", "s3"), (7, "a y b0", "s3")]
    same(spark, tables(spark, tmp_path, texts, [(0, "a b1"), (1, "x y"), (2, "c7 a b0")]), name)


def test_texts_of_one_id_count_for_each_parent(spark, tmp_path):
    texts = [(6, "x x", "p"), (5, "x b", "p"), (5, "c b", "q"), (7, "c c", "r"), (8, "x c", "r")]
    same(spark, tables(spark, tmp_path, texts, [(0, "x"), (1, "none")]), "R8_W14_all_parents")


def test_more_terms_than_are_sent(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"k{k}", f"term{k % 3} common word{k}") for k in range(30)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "term1 common"), (2, "word7 none")], "query_id long, text string")
    found = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieval.bm25(asked, chunks, 4).collect())
    few = found()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 2)
    assert found() == few and [x[2] for x in few] == ["k1", "k10", "k13", "k16", "k7"]


def test_a_stored_index_is_searched_like_the_texts(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"term{k % 3} common word{k}") for k in range(30)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "term1 common"), (2, "word7 none"), (3, "nothing")], "query_id long, text string")
    plain, stored = (sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieval.bm25(asked, x, 3).collect()) for x in (chunks, retrieval.stored_index(chunks, str(tmp_path / "index"))))
    assert plain == stored and len(plain) == 4
