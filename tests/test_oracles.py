"""Every query that has SQL gives what a second engine gives for it."""

import os

import duckdb
import pytest

import tallyhouse.queries  # noqa: F401
from tallyhouse.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
