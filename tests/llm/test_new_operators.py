"""Fill-in-the-middle, near-duplicate vectors and collocations against brute force, and the registered queries on written tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import collocations, embedding_dedup, fill_middle
from tallyhouse.llm.common import new_path

# fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    """The definition, unit by unit."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts(rng, n):
    pieces = ["a", "bc", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "ä", "日本", " ", " ", "\x1c", "\x00", "<", "<P", "P>", "<P>", "<S>", "<M>", "👩‍👧", "."]
    weights = [8] * 16 + [2] * 2 + [0.3] * 3 + [2, 2]
    return ["".join(rng.choices(pieces, weights, k=rng.choice([0, 1, 2, 5, 40, 200]))) for _ in range(n)]


def test_fill_middle_against_its_definition(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(odd_texts(rng, 400))] + [(900, None), (901, ""), (902, " \n "), (None, "with no id"), (903, "x"), (903, "x"), (904, " lead and trail "), (905, "w " * 100_000), (906, "no" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "form": F.lit(1), "output": F.lit(2)})
    found = fill_middle.transformed(frame).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((brute_middle(*r) for r in rows), key=key)
    assert sorted(((r.doc_id, r.back) for r in found), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    forms = Counter(r.form for r in found)
    assert forms["plain"] > forms["spm"] > forms["psm"] > 0 and fill_middle.transformed(frame.limit(0)).count() == 0


def test_events_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(fill_middle, "EVENTS", 3)
    scan = fill_middle.event_scan()
    for text in odd_texts(random.Random(8), 300):
        ends, marked = scan(text)
        assert ends.tolist() == [m.end() for m in UNIT.finditer(text)] and marked == any(x in text for x in fill_middle.SENTINELS)


# near-duplicate vectors


def brute_links(rows, threshold=0.95):
    """For each (id, vector): links to other different rows, and the smallest id reachable."""
    known = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    near = defaultdict(set)
    for a, (i, v) in enumerate(known):
        for b, (j, w) in enumerate(known):
            if a != b and len(v) == len(w):
                x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[a].add(b)
    out = {}
    for a, row in enumerate(known):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[row] = len(near[a]), min(known[b][0] for b in seen)
    return out


def vectors_of(rng, n, dim, groups):
    rows, x = [], rng.normal(size=(n, dim))
    for i in range(n):
        rows.append((i, x[i].tolist()))
    for g, size in enumerate(groups):
        base = x[g]
        for _ in range(size):
            away = rng.normal(size=dim)
            away -= away @ base / (base @ base) * base
            share = rng.uniform(0.0, 0.36)  # the tangent of angles on both sides of the threshold
            rows.append((len(rows), (rng.uniform(0.5, 3) * (base + share * np.linalg.norm(base) * away / np.linalg.norm(away))).tolist()))
    return rows


@pytest.mark.parametrize("rows_of_cell, block", [(128, 2048), (8, 16)])
def test_embedding_links_against_brute_force(spark, monkeypatch, rows_of_cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", rows_of_cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(11)
    rows = vectors_of(rng, 500, 16, (1, 2, 40, 80))
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [(1100, [2 * x for x in rows[7][1]]), (7, rows[7][1])]  # copies, a multiple, a repeated row
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2004, [1.0, None]), (None, rows[7][1]), (2005, [])]
    rows += [(3000, [1.0, 1.0]), (3001, [1e200, 1e200]), (3002, [3.0]), (3003, [5.0]), (3004, [-5.0]), (3005, [1.0, 2.0, 3.0]), (3005, [-1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"node": F.lit("clash"), "v": F.lit(1), "set_key": F.lit(2), "dim": F.lit(3)})
    got = Counter(map(tuple, embedding_dedup.near_duplicates(frame).collect()))
    brute = brute_links(rows)
    want = Counter((i, n, c, i == c) for i, v in rows for n, c in [brute[i, tuple(v)]]) + Counter((i, 0, i, True) for i, _ in odd)
    assert got == want and max(n for _, n, _, _ in got) > 50


def test_a_searchs_reach_at_the_threshold():
    """Partners at the threshold, in random directions: the share that is met, and how much is searched, at two sizes."""
    share = {}
    for n in (2_000, 32_000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        grid = embedding_dedup.Grid(x[: embedding_dedup.SAMPLE], n, 0.95)
        q = x[:400]
        away = rng.normal(size=(400, 64))
        away -= (away * q).sum(1)[:, None] * q
        partner = 0.95 * q + np.sqrt(1 - 0.95**2) * away / np.linalg.norm(away, axis=1)[:, None]
        rows, cells = grid.visits(q)
        own = grid.own(partner)
        met = {(a, b) for a, b in zip(rows.tolist(), cells.tolist(), strict=True)}
        assert np.mean([(i, c) in met for i, c in enumerate(own.tolist())]) >= 0.99
        held = np.bincount(grid.own(x), minlength=len(grid.books[0]) * len(grid.books[1]))
        share[n] = held[cells].sum() / len(q) / n
        sums = grid.to([b[rows] for b in grid.bounds(q)], cells)
        assert all((np.diff(sums[rows == i]) >= -1e-12).all() for i in range(20)) and (sums <= grid.reach).all()
    assert share[32_000] < 0.5 * share[2_000]


def test_an_empty_table_and_one_vector(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>")).collect()] == [(5, 0, 5, True)]


# collocations


def brute_phrases(rows, least, top):
    """The definition, phrase by phrase."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in some.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_texts(rng, n):
    words = ["The", "the", "of", "new", "NEW", "york", "York", "city", "ä", "Ä", "日本", " ", "a\x00b", "x\x1cy"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "?", ";", ":", "\x0b", "\x0c", ""]
    return ["".join(rng.choice(words) + rng.choices(ends, [30, 3, 2] + [1] * 11)[0] for _ in range(rng.choice([0, 1, 3, 30, 90]))) for _ in range(n)]


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_collocations_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rng = random.Random(21)
    rows = [(rng.choice(["en", "en", "de", None, "und"]), t) for t in phrase_texts(rng, 250)] + [("fr", None), ("es", ""), ("en", "...,,, \n\n"), ("it", "new york city of the world " * 40), ("pt", "nowhere twice")]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({"group": F.lit("clash"), "n": F.lit(1), "phrase": F.lit(2), "words": F.lit(3)}).repartition(3)
    for least, top in ((30, 2000), (12, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(frame, least=least, top=top).collect())
        assert got == brute_phrases(rows, least, top) and len(got) > 20
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**18
    row = spark.range(1).select(collocations._floor_share(2_000_000, F.lit(big), F.lit(2 * big + 1)).alias("s")).collect()[0]
    assert row.s == 2_000_000 * big // (2 * big + 1)


# the registered queries, on written tables


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(31)
    at = new_path(spark, "tables")
    rows = [(k, t, rng.choice(["en", "de", None]), "s", len(t)) for k, t in enumerate(phrase_texts(rng, 120))] + [(500, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    vectors = vectors_of(np.random.default_rng(2), 60, 8, (3, 9))
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, rows


def test_op11_fill_middle(spark, folder):
    at, rows = folder
    out = fill_middle.op11_fill_middle(spark, at)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(*brute_middle(i, t)[:5], sha(brute_middle(i, t)[5]), sha(t or "")) for i, t, *_ in rows]


def test_op12_embedding_dedup(spark, folder):
    out = embedding_dedup.op12_embedding_dedup(spark, folder[0])
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect()]
    brute = brute_links(rows)
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted(map(tuple, out.collect())) == sorted((i, *brute[i, tuple(v)], i == brute[i, tuple(v)][1]) for i, v in rows)


def test_op13_collocations(spark, folder):
    at, rows = folder
    out = collocations.op13_collocations(spark, at)
    assert dict(out.dtypes) == {"lang": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint"), "phrase": "string"}
    assert sorted(map(tuple, out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases([(lang, t) for _, t, lang, *_ in rows], 30, 2000)
