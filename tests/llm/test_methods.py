"""The dealt methods against plain versions of themselves, their bounds, and the pipeline's stages."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import chat_format, html_text, language_id, mixing, near_dedup, packing, quality_rules, token_files, tokens, toxicity, vector_search
from tallyhouse.llm.common import new_path, staged
from tests.llm.test_operators import brute_components, brute_rules, docs, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


# language: the distance


def test_out_of_place_distance_against_its_definition():
    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60))

    def ranked(t):
        codes, counts = language_id.ngrams(t)
        return [int(c) for c, _ in sorted(zip(codes.tolist(), counts.tolist(), strict=True), key=lambda x: -x[1])][:50]

    profiles = {lang: np.array(ranked(text(letters)), np.int64) for lang, letters in (("x", "abcdef"), ("y", "cdefgh"), ("z", "abgh"))}
    known = language_id.Profiles(profiles, places=50)
    for _ in range(40):
        t = text(rng.choice(["abcdef", "cdefgh", "abgh", "abcdefgh"]))
        mine = ranked(t)
        away = {k: sum(abs(i - v.tolist().index(g)) if g in v else 50 for i, g in enumerate(mine)) for k, v in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert known.predict(t) == (best, pytest.approx(1 - away[best] / (50 * len(mine))))


def test_equal_distances_go_to_the_first_name():
    same = np.array(language_id.ngrams("abc")[0], np.int64)
    assert language_id.Profiles({"b": same, "a": same}).predict("abc")[0] == "a" and language_id.Profiles({"a": same}).predict("x " * 50_000)[0] == "a"


# vectors: recall and the share of candidates


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_and_candidates_of_random_vectors(n):
    """Neighbours of random vectors are hardly nearer than others, so this is the worst case; the share of candidates doesn't grow."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q = np.arange(0, n, n // 60)
    hit = np.zeros((len(q), n), bool)
    for t in range(vector_search.TABLES):
        mine, probes = vector_search.axes(x, t, 1)[:, 0], vector_search.axes(x[q], t, vector_search.PROBES)
        hit |= (probes[:, :, None] == mine).any(1)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -9
    best = np.argsort(-scores, 1)[:, :20]
    assert np.take_along_axis(hit, best, 1).mean() >= 0.9 and hit.mean() < 0.6


# toxicity


def naive_weight(lexicon, text):
    words = toxicity.folded_words(text)
    excused = set()
    for phrase in lexicon.exceptions:
        parts = phrase.split(" ")
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                excused.update(range(k, k + len(parts)))
    return sum(lexicon.weights.get(w, 0.0) for k, w in enumerate(words) if k not in excused)


def test_matches_against_a_plain_scan():
    rng = random.Random(9)
    names = [toxicity.fold(w) for w in ("trash", "can", "vile", "man", "trashcan", "an")]
    lexicon = toxicity.Lexicon({names[0]: 2.0, names[2]: 3.0, names[5]: 1.0}, (f"{names[0]} {names[1]}", f"{names[1]} {names[0]}", f"{names[3]} {names[2]}"))
    m = toxicity.Matcher(lexicon)
    for _ in range(500):
        text = " ".join(rng.choice(["trash", "can", "VILE", "man", "trashcan", "an", "x", "tra5h", "v1le"]) for _ in range(rng.randint(0, 12)))
        assert m.matched(text)[0] == pytest.approx(naive_weight(lexicon, text)), text


def test_a_text_of_phrases_takes_time_in_proportion():
    m = toxicity.Matcher(toxicity.Lexicon({toxicity.fold("trash"): 1.0}, (toxicity.fold("trash can"),)))
    began = time.process_time()
    assert m.matched("trash can trash " * 40_000)[0] == 40_000
    assert time.process_time() - began < 5


def test_exceptions_are_learned_and_act(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, 25) + (" vile" if k % 4 == 0 else " bubble" if k % 4 == 1 else " vile bubble" if k % 4 == 2 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs(spark, rows).where("doc_id < 300"), labels)
    assert toxicity.fold("vile") in lexicon.weights and toxicity.fold("vile bubble") in lexicon.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, rows), lexicon).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(400))


def test_a_long_text_needs_more_than_a_short_one():
    lexicon = toxicity.Lexicon({"v": 4.0}, (), 2.0, 2.0, half_words=100)
    m = toxicity.Matcher(lexicon)
    assert m.score("v " + "w " * 20) > 0.5 > m.score("v " + "w " * 2000) and m.score("v " * 3000) > 0.5


# packing


def fewest(sizes, capacity):
    """The least number of bins, by trying all assignments of ever smaller pieces."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[k]}):
            left = list(rooms)
            left[left.index(room)] -= sizes[k]
            place(k + 1, left)
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_few_pieces_against_the_fewest_bins(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
    histogram = dict(Counter(sizes))
    used = sum(n for _, n in packing.solve(histogram, 20))
    best = fewest(sizes, 20)
    assert packing.least_sequences(histogram, 20) <= best <= used <= best + 1


def test_the_rounded_program_places_most_and_meets_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(np.exp(rng.normal(5.5, 1.2, 20_000)).astype(int), 1, 2048)
    for times in (1, 100):
        histogram = {s: n * times for s, n in Counter(lengths.tolist()).items()}
        bound = packing.least_sequences(histogram, 2048)
        used = sum(n for _, n in packing.solve(histogram, 2048))
        assert bound <= used <= bound * 1.001 + 1
    sizes = np.array(sorted(s for s in histogram if s < 2048), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    program = packing.fractional(sizes, counts, 2048)
    assert ((program.times @ program.patterns) <= counts + 1e-3).all() and (program.patterns @ sizes <= 2048).all()
    assert (program.times % 1 > 1e-6).any()


# quality rules


def test_verdict_against_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    common = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = []
    for k in range(300):
        # Even lines are in half of the documents, odd ones in a few; a tenth of the documents has few words of its own.
        lines = [" ".join(word() for _ in range(rng.randint(40, 60) if k % 10 else 6))] + [common[j] for j in range(6) if rng.random() < (0.05 if j % 2 else 0.5)]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), f"h{k % 3}" if k % 50 else None))
    rules = quality_rules.Rules(max_line_docs=20, min_kept_share=0.5)
    places = defaultdict(set)
    for i, text, host in rows:
        for line in text.split("\n"):
            if line.strip():
                places[host, line].add(i)
    want = {}
    for i, text, host in rows:
        gone = sum(len(x.split()) for x in text.split("\n") if len(places[host, x]) > 20)
        n, *_, failed = brute_rules(text)
        want[i] = not failed and n - gone >= 0.5 * n
    got = {r.doc_id: r.kept for r in quality_rules.judged(docs(spark, rows), rules).collect()}
    assert got == want and 0 < sum(not v for v in want.values()) and any(not got[i] and not brute_rules(t)[-1] for i, t, _ in rows)


# pages


def test_region_against_all_regions():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 14))]
        begin, end = html_text.best_region(scores)
        best = max((sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=0)
        assert sum(scores[begin:end]) == pytest.approx(max(best, 0)) and ((begin, end) == (0, 0)) == (best <= 0)


def learned_pages(spark):
    page = lambda k: f'<html><body><nav><a>Menu {k}</a></nav><div class="ad">Buy this {k}</div><article><h1>Head {k}</h1><p>Some words of the text {k}.</p></article><footer>Foot of page</footer></body></html>'
    return html_text.learn(spark.createDataFrame([(k, "u", page(k)) for k in range(20)], "page_id long, url string, html string"))


def test_learned_weights_find_articles_without_names(spark):
    weights = learned_pages(spark)
    bare = "<body><div>Home Shop About</div><div class='x1'>Buy now</div><h1>Title here</h1><p>Long text of the page.<p>And more of it.<div>Terms and contact</div></body>"
    assert html_text.main_text(bare, weights) == "Title here Long text of the page. And more of it."
    assert html_text.main_text(bare, html_text.Weights()) != html_text.main_text(bare, weights)
    assert html_text.main_text("<div>Only plain blocks here</div>", weights) == "Only plain blocks here"


def test_parts_of_an_article_whatever_their_names(spark):
    weights = learned_pages(spark)
    page = '<article><div class="entry-header"><h1>My title</h1></div><section id="related-work">Related work</section><p>this <span class="alert">is important</span></p><div class="ad">Buy</div><p class="notice-period">A period</p><form><input>Name</form><ul><li>End</ul></article>'
    assert html_text.main_text(page, weights) == "My title Related work this is important A period End"
    assert html_text.main_text("<article>" + "İ" * 60 + "<SCRIPT>x</p></Script ><p>next</p></article>", weights) == "İ" * 60 + " next"


@pytest.mark.parametrize("page", ["</b>" * 30_000, "<p " * 30_000, "<div>" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "<p>x" * 3000, '<p "' * 20_000 + ">", "<script>" * 20_000])
def test_hostile_markup_takes_time_in_proportion(page):
    began = time.process_time()
    html_text.main_text(page, html_text.Weights({"p": 4.0}))
    assert time.process_time() - began < 5


# chat


def test_layouts_of_any_depth_and_with_other_fields(spark):
    said = [
        '{"conversation":{"id":1,"messages":[{"role":"human","content":"{\\"a\\":1}"},{"content":"z","role":"gpt","extra":{"q":[1]}}]}}', '{"prompt":"a","response":"b","system":"s"}',
        '{"prompt":"a","response":"b","unknown":{"deep":[{"x":1}]}}', '{"instruction":"i","input":"more","output":"o"}', '{"messages":[]}', '{"messages":[{"role":"user"},{"content":"late"}]}',
    ]
    rows = chat_format.turns_of_json(spark.createDataFrame([(s,) for s in said], "record string")).collect()
    assert [r.layout for r in rows] == ["nested_messages", "prompt_response", "prompt_response", "instruction_input", None, "messages"]
    assert [[tuple(t) for t in r.turns or []] for r in rows] == [[("user", '{"a":1}'), ("assistant", "z")], [("system", "s"), ("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")], [("user", "i\n\nmore"), ("assistant", "o")], [], [("user", ""), ("", "late")]]


def test_rows_of_two_layouts(spark):
    a = spark.createDataFrame([(1, 1, None, "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    b = spark.createDataFrame([("d", 0, "bob", "yo", 5)], "dialogue_id string, position int, speaker string, utterance string, extra int")
    rows = chat_format.turns_of_rows(a.unionByName(b, allowMissingColumns=True)).collect()
    assert {r.key: [tuple(t) for t in r.turns] for r in rows} == {"1": [("user", "a"), ("", "b")], "d": [("bob", "yo")]}
    mixed = a.withColumns({"dialogue_id": F.lit("x"), "position": F.lit(0), "speaker": F.lit("s"), "utterance": F.lit("u")})
    with pytest.raises(Exception, match="fits no mapping"):
        chat_format.turns_of_rows(mixed).collect()


@pytest.mark.parametrize(("group", "strip"), [(2, 3), (1, 1), (256, 4096)])
def test_spans_of_any_grouping(spark, monkeypatch, group, strip):
    monkeypatch.setattr(chat_format, "GROUP_TURNS", group)
    monkeypatch.setattr(chat_format, "STRIP_CHARS", strip)
    rng = random.Random(group)
    said = [(k % 7, k, rng.choice(["user", "assistant"]), "".join(rng.choice(["a", "é", "\n", "<|", "\\", "\U0001f600", "|>"]) for _ in range(rng.randint(0, 9)))) for k in range(60)]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    made = chat_format.formatted(chat_format.turns_of_rows(rows))
    for r in chat_format.read_back(made).collect():
        mine = [(role, t) for key, _, role, t in said if key == r.key]
        assert [tuple(t) for t in r.turns] == mine and r.learned == [t for role, t in mine if role == "assistant"]


def test_a_very_long_conversation(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|t|>"), F.col("id").cast("string")).alias("text"))
    got = chat_format.read_back(chat_format.formatted(chat_format.turns_of_rows(rows))).collect()
    assert len(got) == 1 and len(got[0].turns) == 30_000 and got[0].learned[-1] == "<|t|>29999"


# tokens


def test_words_are_forgotten_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 64)
    rng, e = random.Random(2), tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choice(["Ab", "c", " ", "\n", ".", ",", "'s", "9", "é", " ", " 　"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    plain = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.encode(texts) == [np.array(plain.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts] and len(e.words) <= 60


def test_the_dictionary_is_that_of_any_partitioning(spark):
    rng = random.Random(6)
    rows = docs(spark, [(k % 40, prose(rng, 30)) for k in range(80)])
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert len({token_files.train_dictionary(rows.repartition(n), path, 2) for n in (1, 3, 7)}) == 1


# near-duplicates


def test_one_group_of_copies_takes_blocks_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)
    rng = random.Random(13)
    base, other = prose(rng, 60).split(), prose(rng, 60).split()
    rows = [(k, " ".join(f"e{k}" if j == k % 60 else w for j, w in enumerate(base if k % 4 else other))) for k in range(240)]
    seen = []
    plain = near_dedup.links_of_block
    monkeypatch.setattr(near_dedup, "links_of_block", lambda ids, *a: seen.append(len(ids)) or plain(ids, *a))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 5).items()}


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    rng = random.Random(17)
    make = {"en": "abcdefgh", "de": "ijklmnop"}
    own = lambda lang, n: " ".join("".join(rng.choices(make[lang], k=rng.randint(3, 7))) for _ in range(n))
    rows = []
    for k in range(160):
        lang = ("en", "de")[k % 2]
        rows.append((k, own(lang, 40), lang, f"s{k % 3}"))
    rows += [(200 + k, rows[k][1] if k % 2 else rows[k][1].rsplit(" ", 1)[0], rows[k][2], "s0") for k in range(20)]
    rows += [(300, "short one", "en", "s0"), (301, None, None, None), (302, "1 2 3 4 " * 20, "en", "s1"), (None, own("en", 40), "en", "s2")]
    frame = spark.createDataFrame([(i, t, lang, s, len(t) if t else None, "kept along") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    table = staged(frame, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        table = staged(stage(spark, table, ""), name)
        out[name] = table
        if name != "packed":
            assert table.columns == frame.columns
    by = {i: t for i, t, *_ in rows}
    kept = {r.doc_id for r in out["quality"].collect()}
    assert kept == {i for i, t in by.items() if not brute_rules(t)[-1]}
    told = {r.doc_id: r.lang for r in out["language"].collect()}
    assert told.keys() == {i for i in kept if re.search("[a-z]", by[i])} and all(told[i] == ("en", "de")[i % 2] for i in range(160))
    stay = {r.doc_id for r in out["near_duplicates"].collect()}
    assert stay == {None} | {i for i, (_, c) in brute_components([(i, by[i]) for i in told if i is not None], 5).items() if i == c}
    mixed = [r.doc_id for r in out["mixture"].collect()]
    again = Counter(r.doc_id for r in mixing.mixed(out["near_duplicates"]).collect())
    assert Counter(mixed) == again and set(mixed) <= stay
    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    size, at = Counter(), Counter()
    for r in sorted(out["packed"].collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id] and r.length <= 2048
        at[r.sequence_id] += r.length
        size[r.doc_id] += r.length
    assert dict(size) == {i: n * (len(e.encode([by[i]])[0]) // 4 + 1) for i, n in Counter(mixed).items()} and max(at.values()) <= 2048


def test_pipeline_of_an_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        table = staged(stage(spark, table, ""), name)
    assert table.count() == 0 and new_path(spark, "x")
