"""Passages located and covered, gold that can be found, data sets with planted faults, and folders against manifests."""

import hashlib
import itertools
import os
import random

import pytest

from tallyhouse.operators import datasets, passages, spans
from tallyhouse.sources import manifests

# spans


def test_places_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spans, "ANCHOR", 3)
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for k in range(40)] + [(90, None), (91, "  \n")]
    sought = [(k, "  ".join(rng.choices("ab", k=rng.randint(1, 6)))) for k in range(12)] + [(50, None), (51, ""), (52, "zz")]
    got = sorted(tuple(r) for r in spans.located(spark.createDataFrame(sought, "p long, text string"), spark.createDataFrame(texts, "d long, text string"), "p", "d").collect())
    want = []
    for (p, s), (d, t) in itertools.product(sought, texts):
        s, t = (s or "").split(), (t or "").split()
        want += [(p, d, i, i + len(s)) for i in range(len(t) - len(s) + 1) if s and t[i : i + len(s)] == s]
    assert got == sorted(want) and len(got) > 100


@pytest.mark.parametrize("size", [256, 5])
def test_covers_against_the_plain_form(spark, monkeypatch, size):
    monkeypatch.setattr(spans, "BIN", size)
    rng = random.Random(size)
    parts, asked = [], []
    for d in range(25):
        n = rng.randint(1, 12)
        if d % 2:  # as a chunker makes them, in order
            at = 0
            for nth in range(n):
                parts.append((d, nth, at, at + rng.randint(3, 12)))
                at += rng.randint(1, 9)
        else:  # any
            starts = sorted(rng.randint(0, 40) for _ in range(n))
            parts += [(d, nth, a, a + rng.randint(0, 15)) for nth, a in enumerate(starts)]
        asked += [(100 * d + k, d, a, a + rng.randint(0, 30)) for k, a in enumerate(rng.randint(0, 45) for _ in range(12))]
    asked.append((9999, 77, 0, 5))
    out = spans.covered(spark.createDataFrame(asked, "s long, d long, start int, end int"), spark.createDataFrame(parts, "d long, nth int, start int, end int"), ["s", "d"], "d").collect()
    got = {r.s: (r.how, r.chunks) for r in out}
    assert got.keys() == {s for s, _, a, z in asked if a < z}
    for s, d, a, z in asked:
        if a < z:
            mine = [(x, y) for k, _, x, y in sorted(parts) if k == d]
            want = passages.covering(mine, a, z)
            assert got[s][1] == want and got[s][0] == ("none" if not want else "alone" if any(x <= a and z <= y for x, y in mine) else "together")


# least chunks


def brute_least(groups, k):
    ids = sorted({i for _, g in groups for i in g})
    for n in range(k + 1):
        for some in itertools.combinations(ids, n):
            if all(set(g) <= set(some) if m == "all" else set(g) & set(some) for m, g in groups) and all(g for _, g in groups):
                return n
    return None


def test_least_chunks_by_size(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for case in range(60):
        groups = [("all" if rng.random() < 0.2 else "any", sorted(rng.sample("abcdefgh", rng.randint(1, 3)))) for _ in range(rng.randint(1, 7))]
        if case % 20 == 0:
            groups.append(("any", []))
        want[case] = brute_least(groups, 4)
        rows += [(case, str(n), m, g) for n, (m, g) in enumerate(groups)]
    rows += [(100, "0", "any", ["x", "x", None]), (101, "0", "all", ["x", None, "y"])]
    want |= {100: 1, 101: 2}
    got = {r.case_id: r.least for r in datasets.least_chunks(spark.createDataFrame(rows, "case_id long, group_id string, match string, chunk_ids array<string>"), "case_id", 4).collect()}
    assert got == want and None in want.values() and 4 in want.values()


def test_planted_faults_are_counted(spark):
    cases = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, "c")]
    groups = [(1, "g", "any", ["x"]), (1, "g", "any", ["x"]), (2, "g", "some", ["y"]), (3, "g", "all", ["x", "y", "z"]), (9, "g", "any", ["w"])]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    made = lambda c, g, k: {r.check: r.wrong for r in datasets.dataset_checks(frame(c, "case_id long, category string"), frame(g, "case_id long, group_id string, match string, chunk_ids array<string>"), frame([("x",), ("y",), ("z",)], "chunk_id string"), {"a": 2, "b": 1, "d": 1}, k).collect()}
    assert made(cases, groups, 2) == {"repeated_cases": 1, "repeated_groups": 1, "cases_of_category": 3, "unknown_match": 1, "groups_of_no_case": 1, "cases_without_groups": 1, "unknown_chunks": 1, "infeasible": 1}
    sound = [(1, "a"), (2, "a"), (3, "b"), (4, "d")]
    assert set(made(sound, [(k, "g", "any", ["x"]) for k in range(1, 5)], 1).values()) == {0}
    assert made([], [], 1)["cases_of_category"] == 4


# manifests


def test_a_folder_against_its_manifest(spark, tmp_path):
    folder = tmp_path / "frozen"
    (folder / "sub dir").mkdir(parents=True)
    content = {"a.txt": b"one", "sub dir/b.bin": bytes(range(256)), "changed": b"new", "empty": b"", "extra": b"x"}
    for name, data in content.items():
        (folder / name).write_bytes(data)
    (tmp_path / "outside").write_bytes(b"secret")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    said = [("a.txt", sha(b"one")), ("sub dir/b.bin", sha(bytes(range(256)))), ("changed", sha(b"old")), ("empty", sha(b"")), ("gone", sha(b"g")), ("../outside", sha(b"secret")), ("/etc/passwd", "0"), ("file:///etc/passwd", "0"), ("sub dir/../../outside", "0"), ("a.txt", sha(b"one"))]
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    got = sorted(tuple(r) for r in manifests.manifest_problems(spark, str(folder), frame(said)).collect())
    assert got == sorted([("a.txt", "repeated"), ("changed", "changed"), ("gone", "missing"), ("extra", "extra"), ("../outside", "escaping"), ("/etc/passwd", "escaping"), ("file:///etc/passwd", "escaping"), ("sub dir/../../outside", "escaping")])
    hashes = {r.path: (r.bytes, r.sha256) for r in manifests.file_hashes(spark, str(folder)).collect()}
    assert hashes == {k: (len(v), sha(v)) for k, v in content.items()}
    assert manifests.manifest_problems(spark, str(folder), frame([(k, sha(v)) for k, v in content.items()])).count() == 0 and os.path.exists(tmp_path / "outside")
