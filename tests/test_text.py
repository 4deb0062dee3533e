"""Passages, periods, routes and checks on inputs written out by hand."""

import itertools
import random

import pytest

from tallyhouse.functions import periods, text
from tallyhouse.operators import passages, retrieval
from tallyhouse.plans import answers, questions, router
from tallyhouse.plans.questions import ClarificationError, Clarifications
from tallyhouse.sources import files


@pytest.mark.parametrize("n", [1, 40, 59, 60, 61, 79, 80, 349, 350, 351, 549, 550, 551, 1100])
def test_chunks_lose_no_word(n):
    rules = passages.ChunkRules()
    paragraphs = [" ".join(f"w{k}" for k in range(n)), " ".join(f"v{k}" for k in range(n // 2))]
    made = passages.chunk_paragraphs([p for p in paragraphs if p], rules)
    assert passages.overlap_loss(paragraphs, [c["text"] for c in made], rules.overlap) == 0
    assert all(len(c["text"].split()) <= rules.most + rules.overlap for c in made)


def test_sentences_keep_abbreviations():
    spans = passages.sentence_spans("See Fig. 2 vs. that, e.g. 3.5 kg. Then rest! Done")
    assert len(spans) == 3


def test_children_cover_and_bound():
    t = "One two three. " + " ".join(f"w{k}" for k in range(30)) + ". End here."
    made = passages.children(t, 10)
    assert all(len(t[a:b].split()) <= 10 for a, b, _ in made) and "".join("".join(t[a:b].split()) for a, b, _ in made) == "".join(t.split())
    assert any(f for _, _, f in made)


def test_covers():
    assert passages.covering([(0, 5), (4, 9), (0, 9)], 1, 8) == [2]
    assert passages.covering([(0, 5), (4, 9)], 1, 8) == [0, 1] and passages.covering([(0, 5), (6, 9)], 1, 8) == []
    assert passages.least_hitting_set([("any", ["a", "b"]), ("any", ["b", "c"])]) == ["b"]


@pytest.mark.parametrize(
    ("said", "want"),
    [("2024-01-05부터 2024-02-01까지", ("2024-01-05", "2024-02-01", None)), ("2024년 2월", ("2024-02-01", "2024-02-29", None)), ("2024년 1월 ~ 3월", ("2024-01-01", "2024-03-31", None)), ("3월", (None, None, "missing_date_year")),
     ("2024-02-30", (None, None, "invalid_calendar_date")), ("2024-03-01 - 2024-02-01", (None, None, "reversed_date_range")), ("2024-03-01 and 2024-02-01", (None, None, None)), (None, (None, None, None))],
)
def test_periods(said, want):
    assert periods.explicit_period(said) == want


def test_search_tokens(spark):
    row = spark.createDataFrame([("Progressive overload이 proximity-to-failure와 RPE-based",)], "t string").select(text.tokens("t").alias("x")).collect()[0]
    assert len(row.x) == 9 and row.x[:2] == ["progressive", "overload"]


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "query_id int, chunk_id string, rank int")


def test_fusion_puts_shared_first(spark):
    rows = retrieval.rrf(ranked(spark, ["dense_only", "shared", "d3"]), ranked(spark, ["bm25_only", "shared", "b3"]), 3).orderBy("rank").collect()
    assert rows[0].chunk_id == "shared" and rows[0].score == pytest.approx(2 / 62)
    alone = retrieval.rrf(ranked(spark, ["z", "a"]), ranked(spark, []), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in alone] == ["z", "a"]


def test_zero_policies(spark):
    chunks = spark.createDataFrame([("z", "one"), ("a", "two"), ("m", "three")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "nothing")], "query_id int, text string")
    assert retrieval.bm25(asked, chunks, 3).count() == 0
    assert [r.chunk_id for r in retrieval.bm25(asked, chunks, 3, retain_zero=True).orderBy("rank").collect()] == ["a", "m", "z"]


def test_routes(spark):
    said = ["my training log weekly volume", "hypertrophy", "sleep quality", None, "hello"]
    rows = router.routed(spark.createDataFrame([(s,) for s in said], "text string")).collect()
    assert [r.task_type for r in rows] == ["log_metric", "literature_only", "unsupported", "invalid", "ambiguous"]
    assert rows[1].confidence == 0.85


def test_anchors_decide(spark):
    rows = spark.createDataFrame([(1, "supported", [1, 1, 9], [1, 2]), (1, "supported", [9], [1])], "case_id int, model_status string, proposed_ids array<bigint>, supplied_ids array<bigint>")
    got = answers.finalised(rows).collect()
    assert [r.status for r in got] == ["supported", "missing"] and got[0].duplicate_anchors == 1 and got[0].rejected_ids == [9]


def test_clarifications_are_taken_once():
    now = [0.0]
    c = Clarifications(seconds=10, most=1, clock=lambda: now[0])
    key = c.ask("q", ("a", "b"))
    with pytest.raises(ClarificationError, match="capacity"):
        c.ask("r", ("a", "b"))
    with pytest.raises(ClarificationError, match="invalid"):
        c.choose(key, "c")
    assert c.choose(key, "a") == "q"
    with pytest.raises(ClarificationError, match="not_found"):
        c.choose(key, "a")
    key, now[0] = c.ask("q", ("a", "b")), 11.0
    with pytest.raises(ClarificationError, match="expired"):
        c.choose(key, "a")


def test_files(spark, tmp_path):
    good = ",".join(files.LOG_SCHEMA.names) + "\n2024-01-01 10:00:00,Push,Press,1,100,5,0,0,,\n"
    (tmp_path / "log.csv").write_text(good)
    rows = files.log_csv(spark, str(tmp_path / "log.csv")).collect()
    assert rows[0].source_row == 2 and rows[0].started_at.hour == 10
    (tmp_path / "bad.csv").write_text(good.replace("Date", "When"))
    with pytest.raises(ValueError, match="header"):
        files.log_csv(spark, str(tmp_path / "bad.csv"))
    frozen = str(tmp_path / "frozen")
    made = files.freeze(spark.range(5), frozen)
    assert made.rows == 5 and files.verified(spark, frozen).count() == 5
    with pytest.raises(Exception, match="(?i)already exists"):
        files.freeze(spark.range(5), frozen)
    spark.range(1).write.mode("append").parquet(f"{frozen}/rows")
    with pytest.raises(ValueError, match="changed"):
        files.verified(spark, frozen)


def test_articles(spark, tmp_path):
    xml = '<article xmlns="x"><front><article-id pub-id-type="pmid">7</article-id><pub-date pub-type="ppub"><year>2001</year></pub-date><pub-date pub-type="epub"><year>2000</year></pub-date><article-title>A <i>b</i></article-title></front><body><sec><title>Intro</title><p>One.</p><fig><p>no</p></fig></sec></body></article>'
    (tmp_path / "a.xml").write_text(xml)
    row = files.articles(spark, str(tmp_path / "a.xml")).collect()[0]
    assert (row.pmid, row.title, row.year) == ("7", "A b", 2000) and [(s.title, s.paragraphs) for s in row.sections] == [("Intro", ["One."])]


def test_parents_beyond_a_pool_of_children_are_found(spark):
    rows = [(k, "hot", "word word") for k in range(80)] + [(100 + k, f"p{k}", "word other words") for k in range(6)]
    scores = retrieval.bm25_scores(spark.createDataFrame([(1, "word")], "query_id long, text string"), spark.createDataFrame(rows, "chunk_id long, parent_id string, text string"))
    hits = scores.join(spark.createDataFrame(rows, "chunk_id long, parent_id string, text string").drop("text"), "chunk_id")
    got = retrieval.best_parents(hits, 5).orderBy("rank").collect()
    assert [(r.parent_id, r.best_child, r["rank"]) for r in got] == [("hot", 0, 1), ("p0", 100, 2), ("p1", 101, 3), ("p2", 102, 4), ("p3", 103, 5)]


def test_no_alias_of_a_large_dictionary_is_lost(spark):
    aliases = spark.range(100_060).selectExpr("concat('lift', id, 'x') AS alias", "concat('Lift ', id) AS canonical_name")
    asked = spark.createDataFrame([(k, f"my lift{k}x records") for k in [*range(30), *range(100_000, 100_060)]], "q long, text string")
    assert {r.q: r.exercise for r in questions.longest_alias(asked, aliases, "q").collect()} == {k: f"Lift {k}" for k in [*range(30), *range(100_000, 100_060)]}


@pytest.mark.parametrize(
    ("said", "want"),
    [("2032년", ("2032-01-01", "2032-12-31", None)), ("2030년부터 2032년까지", ("2030-01-01", "2032-12-31", None)), ("2034년 11월부터 2035년 2월까지", ("2034-11-01", "2035-02-28", None)),
     ("2034년 9월 3일부터 12월까지", ("2034-09-03", "2034-12-31", None)), ("2033년 2월 29일", (None, None, "invalid_calendar_date")), ("2034년 13월", (None, None, "invalid_calendar_date")),
     ("2034년 12월~9월", (None, None, "reversed_date_range")), ("2034년과2035년", (None, None, "ambiguous_date_range")), ("120345년 12 일", (None, None, None)), ("", (None, None, None))],
)
def test_written_out_periods(said, want):
    assert periods.explicit_period(said) == want


def test_days_in_both_forms(spark):
    rows = spark.createDataFrame([("2024-01-05, 2024년 1월 5일, 2024년2월3일 and 2024-02-30",), ("2024년 3월",), (None,)], "t string").select(periods.full_dates("t").alias("x")).collect()
    assert [r.x for r in rows] == [["2024-01-05", "2024-02-03"], [], []]


def test_sentences_of_odd_texts():
    cut = lambda t: [t[a:b].strip() for a, b in passages.sentence_spans(t)]
    assert cut("See (e.g. this) et al. and J. Doe. Done?!\" Yes") == ["See (e.g. this) et al. and J. Doe.", "Done?!\"", "Yes"]
    assert cut("A list etc.. Next 3.5 kg.)  ") == ["A list etc..", "Next 3.5 kg.)"] and cut(" \n ") == []


def test_a_piece_without_room_keeps_the_overlap_and_one_after_the_target_may_not():
    rules = passages.ChunkRules(target=5, least=1, most=8, overlap=3)
    made = passages.chunk_paragraphs(["a b c", "d e f g h i j", "k l m n o p"], rules)
    assert [c["text"] for c in made] == ["a b c", "a b c\n\nd e f g h i j", "k l m n o p"] and [(c["first"], c["last"]) for c in made] == [(1, 1), (1, 2), (3, 3)]


def test_a_stored_index_gives_the_same_ranks(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"term{k % 3} common word{k}") for k in range(30)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "term1 common"), (2, "word7 none")], "query_id long, text string")
    index = retrieval.stored_index(chunks, str(tmp_path / "index"))
    plain, stored = (sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in retrieval.bm25_scores(asked, x).collect()) for x in (chunks, index))
    assert plain == stored and len(plain) == 31
    with pytest.raises(Exception, match="(?i)already exists"):
        retrieval.stored_index(chunks, str(tmp_path / "index"))


def jats_sections(body, front=""):
    found = files.article(f"<article>{front}<body>{body}</body></article>".encode())["sections"]
    return [(s["title"], s["paragraphs"]) for s in found]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<sec><title>T</title><list><list-item><p>One</p></list-item><list-item><p>Two</p></list-item></list></sec>", [("T", ["- One\n- Two"])]),
        ("<boxed-text><title>Key</title><p>Dose</p><list><list-item><p>A</p></list-item></list></boxed-text>", [("Body", ["Key\nDose\n- A"])]),
        ("<sec><title>Ab</title><def-list><def-item><term><bold>RIR</bold></term><def><p>Reps <italic>in reserve</italic></p></def></def-item></def-list></sec>", [("Ab", ["RIR: Reps in reserve"])]),
        ("<p>First</p><sec><title>P</title><p>a</p><sec><title>C</title><p>b</p></sec><p>c</p></sec><p>Last</p>", [("Body", ["First"]), ("P", ["a"]), ("P > C", ["b"]), ("P", ["c"]), ("Body", ["Last"])]),
        ("<p>Intro <list><list-item><p>Item</p></list-item></list>Tail <fig><p>no</p></fig></p>", [("Body", ["Intro Item Tail"])]),
        ("<list><label>L</label><list-item><label>1.</label><p>x</p><p>y</p><list><list-item><p>n</p></list-item></list></list-item></list>", [("Body", ["L\n- 1.\n  x\n  y\n  - n"])]),
        ("<p>Kept</p><table-wrap><list><list-item><p>no</p></list-item></list></table-wrap><boxed-text><media><p>no</p></media></boxed-text>", [("Body", ["Kept"])]),
        ("<boxed-text><label>Box 1</label><caption><title>Con</title><p>Cap</p></caption><sec><title>Known</title><p>k</p></sec></boxed-text>", [("Body", ["Box 1\nCon Cap\nKnown\nk"])]),
    ],
)
def test_blocks_of_articles(body, want):
    assert jats_sections(body) == want


def test_front_matter():
    front = "<front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><contrib-group><contrib contrib-type='author'><name><surname>Doe</surname><given-names>A B</given-names></name></contrib><contrib contrib-type='editor'><name><surname>No</surname></name></contrib><contrib><collab>Team</collab></contrib></contrib-group><abstract><p>Sum</p></abstract></article-meta></front>"
    found = files.article(f"<article>{front}<body><p>x</p></body></article>".encode())
    assert found["journal"] == "J" and found["authors"] == ["A B Doe", "Team"] and found["sections"][0] == {"title": "Abstract", "paragraphs": ["Sum"]}


def test_hitting_sets_against_all_sets():
    rng = random.Random(3)
    for _ in range(200):
        groups = [(rng.choice(["any", "any", "all"]), rng.sample("abcdefg", rng.randint(1, 3))) for _ in range(rng.randint(0, 4))]
        fits = lambda ids, groups=groups: all((set(g) <= set(ids) if m == "all" else set(g) & set(ids)) for m, g in groups)
        best = min((c for n in range(8) for c in itertools.combinations("abcdefg", n) if fits(c)), key=lambda c: (len(c), c))
        assert passages.least_hitting_set(groups) == list(best)
    many = [("any", [f"x{k}", f"y{k}", "common"]) for k in range(40)]
    assert passages.least_hitting_set(many) == ["common"] and passages.least_hitting_set([("any", []), ("all", ["a"])]) == ["a"]
