"""The pipeline's stages on clashing columns, repeated ids and nulls."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import common, near_dedup, quality_rules, token_files
from tallyhouse.llm.common import new_path, staged
from tests.llm.test_operators import docs

public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ("rate", "copy", "mix_key", "_kept", "_lines", "_lang", "_score", "_nth", "_d", "_n", "_source", "_id", "row", "kept", "lines", "acted", "host", "text_key", "id", "repeated", "lang_pred", "score", "node", "a.b", "n")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(n))


def staged_all(spark, frame):
    table, out = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        table = staged(stage(spark, table, ""), name)
        out[name] = table
    return out


def test_columns_of_any_name_are_carried(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, 40), "en", f"s{k % 2}", 1) for k in range(30)] + [(50, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in NAMES})
    out = staged_all(spark, frame)
    for name in list(out)[:-1]:
        assert out[name].columns == frame.columns
        got = out[name].collect()
        assert got and all(r[c] == f"{c}:{r.doc_id}" for r in got for c in NAMES)
    assert {r.doc_id for r in out["near_duplicates"].collect()} == set(range(30)) and out["packed"].count() > 0


def test_texts_of_one_id_are_decided_one_by_one(spark):
    rng = random.Random(4)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, c + " end"), (8, d), (9, d), (None, b + " x"), (None, a), (10, None), (10, None), (-4, words(rng, 40))]
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    texts = Counter(r.text for r in kept)
    # Each text has one near copy of it left, and unrelated texts of an id all stay.
    for group in ((a,), (b, b + " x"), (c, c + " end"), (d,)):
        assert sum(texts[t] for t in group) == 1
    assert texts[None] == 2 and {r.doc_id for r in kept if r.text == d} == {8} and sum(r.doc_id == -4 for r in kept) == 1
    assert len(kept) == 7 and corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


def test_repeated_rows_of_every_stage(spark):
    rng = random.Random(6)
    text = words(rng, 40)
    frame = spark.createDataFrame([(1, text, "en", "s", None)] * 3 + [(2, words(rng, 40), "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    quality = corpus_pipeline.quality(spark, frame, "")
    assert Counter(r.doc_id for r in quality.collect()) == {1: 3, 2: 1}
    language = corpus_pipeline.language(spark, staged(quality, "q"), "")
    assert Counter(r.doc_id for r in language.collect()) == {1: 3, 2: 1}
    assert Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, staged(language, "l"), "").collect()) == {1: 1, 2: 1}


def test_a_line_of_short_texts_counts_each_different_text(spark):
    """Texts of at most 8 words are told apart by equality alone, longer near copies count once."""
    rules = quality_rules.Rules(min_words=1, max_line_docs=5)
    line = "sign up here now"
    short = [(k, f"{line}\nonly {chr(97 + k)}", "h") for k in range(8)]
    rng = random.Random(2)
    base = words(rng, 60)
    long = [(100 + k, f"{base} {chr(97 + k)}\nclick for more", "h") for k in range(8)]
    same = [(200 + k, "one footer\nequal", "h") for k in range(8)]
    got = {r.doc_id: r.removed_words for r in quality_rules.judged(docs(spark, short + long + same), rules).collect()}
    assert all(got[k] == 4 for k in range(8)) and all(got[100 + k] == 0 for k in range(8)) and all(got[100 + k] == 0 for k in range(8)) and all(got[200 + k] == 0 for k in range(8))


def test_token_files_in_a_folder_without_scheme(spark, tmp_path):
    rows = [(k, f"text number {k} " * (k % 5 + 1)) for k in range(60)] + [(None, "none")]
    folder = f"{tmp_path}/files"
    manifest = token_files.write_token_files(docs(spark, rows), folder, public_tokenizers.path("byte_bpe_50k.json"), 2, shards=4)
    assert [(x["first"], x["last"]) for x in manifest["shards"]] == sorted((x["first"], x["last"]) for x in manifest["shards"]) and manifest["shards"][-1]["last"] == 59
    found = {r.doc_id: bytes(r.ids) for r in token_files.read_token_files(spark, folder).collect()}
    assert len(found) == 61 and all(token_files.document_ids(folder, k).tobytes() == found[k] for k in (0, 17, 59)) and token_files.document_ids(folder, 60) is None


def test_a_shared_folder_without_scheme(spark, monkeypatch):
    plain = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    monkeypatch.setattr(common, "shared_dir", lambda spark: plain)
    folder = new_path(spark, "files")
    assert "://" not in folder
    got = near_dedup.near_duplicates(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (2, False)]
    token_files.write_token_files(docs(spark, [(1, "a"), (2, "b")]), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(spark, folder).count() == 2
