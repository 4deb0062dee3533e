"""Exact ranks, ordered digests, JSON scalars, days in intervals and conserved words against plain versions of themselves."""

import datetime as dt
import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import json_real
from tallyhouse.operators import conservation, intervals, orderstats
from tallyhouse.operators.cleaning import digest

# numbers and digests


def test_reals_as_json_writes_them(spark):
    rng = random.Random(2)
    some = [0.0, -0.0, 1.0, 0.1, 12345678.0, 1e7, 9999999.0, 1e-4, 1e-5, 1.5e-7, 1e15, 1e16, 123456789012345680.0, 1e22, 2e23, 8.41e21, 2.2250738585072014e-308, 1.7976931348623157e308, 2**53 + 1.0, -1e-7, -3.25, 2.0**-44, 1e23]
    some += [float(rng.randrange(2**53, 2**63)) for _ in range(3000)] + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)] + [rng.uniform(-1e6, 1e6) for _ in range(3000)] + [round(rng.uniform(0, 1e5), 2) for _ in range(3000)] + [10 ** rng.uniform(-9, 24) for _ in range(3000)]
    some = [x for x in some if math.isfinite(x)]
    got = spark.createDataFrame([(x,) for x in some], "x double").select("x", json_real(F.col("x")).alias("t")).collect()
    bad = [(r.x, r.t) for r in got if json.dumps(r.x) != r.t]
    assert bad == [], bad
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(json_real(F.col("x")).alias("t")).collect()
    assert [r.t for r in odd] == ['"nan"', '"inf"', '"-inf"', None]


def test_digests_of_mixed_rows(spark):
    rows = [(7, 12345678.0, True, "plain", None), (-3, 1e-7, False, 'quo"te \\ back', "é日本"), (0, -0.5, None, "tab\there\nline\x01\x1f", ""), (2**62, 1e22, True, "", "\x7f")]
    frame = spark.createDataFrame(rows, "a long, b double, c boolean, d string, e string")
    want = [hashlib.sha256(json.dumps(list(r), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24] for r in rows]
    assert [r.d for r in frame.select(digest(frame, "a", "b", "c", "d", "e").alias("d")).collect()] == want
    one = spark.createDataFrame([(12345678.0, True, 3)], "x double, y boolean, z int")
    assert one.select(digest(one, "x", "y", "z").alias("d")).collect()[0].d.startswith("5b5a8158")


# ranks


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_ranks_against_sorting(spark, monkeypatch, hot):
    monkeypatch.setattr(orderstats, "CUTS", 4)
    rng = random.Random(7)
    rows = [(("a", "b", None)[k % 3], rng.choice([rng.uniform(-5, 5), 1.25, rng.randint(0, 9) * 1.0])) for k in range(3000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("a", None)]
    if hot:  # one group with all rows, most of one value
        rows = [("a", 7.0 if rng.random() < 0.9 else rng.uniform(0, 10)) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "kind string, x double").repartition(5)
    got = {r.kind: (r.p95, r.first, r.last, r.median) for r in orderstats.nearest_ranks(frame, ["kind"], "x", {"p95": 0.95, "first": 0.0, "last": 1.0}).collect()}
    want = {}
    for kind in {k for k, _ in rows}:
        v = sorted(x for k, x in rows if k == kind and x is not None)
        if v:
            at = lambda s: v[min(len(v) - 1, int(len(v) * s))]  # noqa: B023, E731
            want[kind] = at(0.95), at(0.0), at(1.0), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert got == want
    plan = orderstats.at_ranks(frame, ["kind"], "x", spark.createDataFrame([("a", 5), ("a", 10**6)], "kind string, rank long"))
    assert [(r.kind, r.rank, r.value) for r in plan.collect()] == [("a", 5, sorted(x for k, x in rows if k == "a" and x is not None)[4])]
    assert orderstats.nearest_ranks(frame.limit(0), ["kind"], "x", {"p95": 0.95}).count() == 0


# ordered digests


def brute_tree(texts, fan, levels):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = [sha(t) for t in texts]
    for _ in range(levels):
        level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
    return level[0] if level else sha("")


def test_a_digest_follows_order_and_not_partitions(spark, monkeypatch):
    monkeypatch.setattr(orderstats, "FAN", 5)
    texts = [f"text {k}" for k in range(120)]
    want = brute_tree(texts, 5, orderstats.LEVELS)
    made = lambda t, parts: orderstats.ordered_digest(spark.createDataFrame(list(enumerate(t)), "id long, t string").repartition(parts), ["id"], F.col("t")).collect()[0]
    for parts in (1, 3, 16):
        assert tuple(made(texts, parts)) == (120, want)
    swapped = [*texts]
    swapped[17], swapped[90] = swapped[90], swapped[17]
    assert made(swapped, 3).digest == brute_tree(swapped, 5, 4) != want
    assert made(texts[:-1], 3).digest != want and tuple(orderstats.ordered_digest(spark.createDataFrame([], "id long, t string"), ["id"], F.col("t")).collect()[0]) == (0, brute_tree([], 5, 4))
    ties = [(1, "b"), (1, "a"), (1, "a"), (None, "n")]
    digests = {orderstats.ordered_digest(spark.createDataFrame(x, "id long, t string").repartition(2), ["id"], F.col("t")).collect()[0].digest for x in (ties, ties[::-1])}
    assert len(digests) == 1


# intervals


@pytest.mark.parametrize("series", [["a"], ["a", "b", None]])
def test_days_in_intervals_against_brute_force(spark, series):
    rng = random.Random(len(series))
    day = lambda k: dt.date(1969, 12, 1) + dt.timedelta(days=k)
    days = [(rng.choice(series), day(rng.randint(0, 400)), k) for k in range(500)] + [("a", None, -1)]
    spans = [(rng.choice(series), day(a), day(a + rng.choice([0, 0, 1, 6, 29, 200, 399])), k) for k, a in enumerate(rng.randint(-50, 420) for _ in range(150))]
    spans += [("a", day(9), day(3), 900), ("a", None, day(3), 901), ("a", day(3), None, 902)]
    left, right = spark.createDataFrame(days, "s string, day date, d int"), spark.createDataFrame(spans, "s string, a date, z date, i int")
    got = sorted((r.d, r.i) for r in intervals.held_days(left, right, "s", "day", "a", "z").collect())
    want = sorted((d, i) for s, x, d in days for t, a, z, i in spans if s == t and s is not None and x and a and z and a <= x <= z)
    assert got == want and len(want) > 500
    assert intervals.held_days(left, right.limit(0), "s", "day", "a", "z").count() == 0
    # What meets by bins is in proportion to what is held, whatever the number of intervals.
    short = spark.createDataFrame([("a", day(k), day(k), k) for k in range(300)], "s string, a date, z date, i int")
    assert intervals.held_days(left, short, "s", "day", "a", "z").count() == sum(s == "a" and x is not None and x < day(300) for s, x, _ in days)


# conservation


def brute_status(source, chunks, overlap):
    def whole(parts):
        places, before = {0}, []
        for words in parts:
            new = set()
            for n in range(min(overlap, len(before), len(words)) + 1):
                if before[len(before) - n :] == words[:n]:
                    rest = words[n:]
                    new |= {p + len(rest) for p in places if source[p : p + len(rest)] == rest}
            places, before = new, words
        return len(source) in places

    if whole(chunks):
        return "kept"
    flat = [w for c in chunks for w in c]
    if any(flat.count(w) < source.count(w) for w in set(source)):
        return "lost"
    return "repeated" if whole([c for k, c in enumerate(chunks) if c not in chunks[:k]]) else "reordered"


def test_conservation_against_brute_force(spark):
    rng = random.Random(9)
    sources, chunks, want = [], [], {}
    for k in range(150):
        source = rng.choices("abc" if k % 2 else "abcdefghijklmnop", k=rng.randint(0, 40))
        parts = [source[a : a + 8] for a in range(0, max(len(source) - 3, 1), 5)] if source else []
        fault = rng.randint(0, 5)
        if parts and fault == 1:
            parts.pop(rng.randrange(len(parts)))
        elif len(parts) > 1 and fault == 2:
            a = rng.randrange(len(parts) - 1)
            parts[a], parts[a + 1] = parts[a + 1], parts[a]
        elif parts and fault == 3:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(parts))
        elif parts and fault == 4:
            parts[-1] = parts[-1][:-1]
        sources.append((k, " \n".join(source) if k else None))
        chunks += [(k, i, "  ".join(c)) for i, c in enumerate(parts)]
        want[k] = brute_status(source if k else [], parts, 3)
    chunks.append((999, 0, "of no source"))
    out = conservation.conservation(spark.createDataFrame(sources, "k long, text string"), spark.createDataFrame(chunks, "k long, nth int, text string"), "k", 3).collect()
    assert {r.k: r.status for r in out} == want and len(set(want.values())) == 4
    assert all((r.lost_words > 0) == (r.status == "lost") or r.status == "kept" for r in out)
