"""Exact vectors beside hostile ones, and paths of any file system."""

import numpy as np
import pytest

from tallyhouse.operators import retrieval
from tallyhouse.session import qualified
from tallyhouse.sources import files

KIND = "chunk_id long, vector array<double>"


def brute(queries, rows, k):
    """The definition: cosine of what it is defined for, told apart to nine decimals."""
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = {}
    for q, v in queries:
        if not good(v):
            continue
        told = []
        for i, w in rows:
            if good(w) and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                told.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9), i))
        for rank, (score, i) in enumerate(sorted(told)[:k], 1):
            out[q, rank] = (i, -score)
    return out


@pytest.mark.parametrize("k", [1, 4, 10, 60])
def test_exact_cosine_beside_zero_null_and_other_vectors(spark, k, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(30)]
    rows += [(100 + i, [0.0] * 6) for i in range(5)] + [(110, None), (111, [float("nan")] + [1.0] * 5), (112, [float("inf")] * 6), (113, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(120, [1.0, 2.0]), (121, []), (122, rows[3][1]), (123, [1e200] * 6), (124, [-1e-200] * 6)]
    queries = [(0, rows[3][1]), (1, [0.0] * 6), (2, None), (3, [1.0, 1.0]), (4, [float("nan")] * 6), (5, [1.0] * 6)]
    asked = spark.createDataFrame([(q, v) for q, v in queries], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in retrieval.exact_cosine(asked, spark.createDataFrame(rows, KIND), k).collect()}
    want = brute(queries, rows, k)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-9) for x in want)
    assert retrieval.exact_cosine(asked, spark.createDataFrame([], KIND), k).count() == 0


def test_paths_get_the_default_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        assert qualified(spark, "/a/b") == "file:///a/b" and qualified(spark, "file:///a") == "file:///a"
        conf.set("fs.viewfs.mounttable.far.link./in", "file:///tmp")
        conf.set("fs.defaultFS", "viewfs://far/")
        assert qualified(spark, "/in/b") == "viewfs://far/in/b" and qualified(spark, "file:/a") == "file:///a"
    finally:
        conf.set("fs.defaultFS", before) if before else conf.unset("fs.defaultFS")


def test_matrices_in_a_folder_without_scheme(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "key long, vector array<float>").repartition(3)
    assert files.write_matrix(rows, "key", "vector", f"{tmp_path}/m") == 9
    assert sorted((r.key, list(r.vector)) for r in files.read_matrix(spark, f"{tmp_path}/m").collect()) == [(i, [float(i), 1.0]) for i in range(9)]
