"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding undoes disguises: compatibility forms, case, marks on letters, letters of other alphabets
that look Latin, and digits or signs that stand for letters. The lexicon, its weights and its
exception phrases are learned from a bounded sample of labelled documents. The score is the summed
weight of the matched words outside exception phrases, set against the text's length and put
through a logistic curve whose middle separates the learned labels best.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm.common import id_crc, slices, table

#: Labelled documents of each label that are learned from at most, those with the least hashes of their ids.
LEARN_ROWS = 4000
#: Fewest documents of its label that have a word or phrase, a word's least log-odds outside exception phrases, and the
#: log-odds from which on a word is tried: more clean documents than that would have to excuse it.
LEAST_DOCS, LEAST_ODDS, TRIED_ODDS = 5, 4.0, 1.0
#: Lengths in words at which a text's length halves the weight of its matches; the one that parts the labels best is learned.
HALF_WORDS = (100, 300, 1000, 3000, 10_000, 30_000)

# Letters and signs by what they are folded to. The letters l and i fold together, as 1 and | may stand for either.
LOOKALIKES = {
    "a": "аɑαѧ4@", "b": "вьƅ8", "c": "сϲс¢", "d": "ԁɗ", "e": "еєɛ3€", "f": "ƒ", "g": "ɡց9", "h": "һн", "i": "іιıј1!|lӏǀ",
    "k": "кκ", "m": "м", "n": "п", "o": "оοσօ0", "p": "рρ", "r": "гя", "s": "ѕꜱ5$", "t": "тτ7+", "u": "υսц", "v": "ѵν",
    "w": "ԝω", "x": "хχ", "y": "уүγ", "z": "ᴢ2",
}
_FOLD = {ord(x): k for k, v in LOOKALIKES.items() for x in v}
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]+")
#: Signs that stand for letters within a word, but beside one may be punctuation.
_SIGNS = "".join(x for v in LOOKALIKES.values() for x in v if not x.isalnum())
_WORD = re.compile(rf"(?:[^\W_]|[{re.escape(_SIGNS)}])+")


def _plain(text: str) -> str:
    """Compatibility forms, without marks and case; the letters and signs that _FOLD replaces, one by one, still stand."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def fold(text: str) -> str:
    """Same words for disguised and plain spellings."""
    return _plain(text).translate(_FOLD)


def word_forms(text: str | None) -> list[tuple[str, str]]:
    """Each word folded without and with the signs at its ends, which may be punctuation or letters; signs alone are no word."""
    words = []
    for m in _WORD.finditer(_plain(text or "")):
        whole = m[0]
        bare = whole.strip(_SIGNS)
        if bare:
            folded = bare.translate(_FOLD)
            words.append((folded, folded if bare == whole else whole.translate(_FOLD)))
    return words


def folded_words(text: str | None) -> list[str]:
    return [bare for bare, _ in word_forms(text)]


def _beyond(plain: str, at: int, step: int) -> int | None:
    """The place past the signs from `at` on if a word may end there, else None."""
    while 0 <= at < len(plain) and plain[at] in _SIGNS:
        at += step
    return None if 0 <= at < len(plain) and plain[at].isalnum() else at


@dataclass(frozen=True)
class Lexicon:
    """Folded words with weights, folded phrases that excuse a word, and the curve from weight to score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    middle: float = 1.0
    steep: float = 4.0
    half_words: float = 10_000


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.machine = lexicon, ahocorasick.Automaton()
        for word, weight in lexicon.weights.items():
            self.machine.add_word(word, (len(word), weight))
        for phrase in lexicon.exceptions:
            self.machine.add_word(phrase, (len(phrase), None))
        self.ready = bool(lexicon.weights)
        if self.ready:
            self.machine.make_automaton()

    def matched(self, text: str | None) -> tuple[float, int]:
        """Summed weight of matched words outside exception phrases, and the number of words apart by spaces or lines."""
        if not text or not self.ready:
            return 0.0, 0
        plain = _plain(text)
        folded = plain.translate(_FOLD)
        words: dict[int, tuple[int, int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.machine.iter(folded):
            begin = end - size + 1
            # Most hits lie within longer words. Signs alone are no word.
            if begin and plain[begin - 1].isalnum() or end + 1 < len(plain) and plain[end + 1].isalnum() or not plain[begin : end + 1].strip(_SIGNS):
                continue
            left, right = _beyond(plain, begin - 1, -1), _beyond(plain, end + 1, 1)
            if left is None or right is None:
                continue
            if weight is None:
                excused.append((begin, end))
            elif right not in words or words[right][1] - words[right][0] < end - begin:  # a word counts once, by the form with more of its signs
                words[right] = (begin, end, weight)
        hits = list(words.values())
        if hits and excused:
            # Of the phrases that begin at or before a hit, the one that reaches farthest decides.
            excused.sort()
            begins, reach = [a for a, _ in excused], list(itertools.accumulate((b for _, b in excused), max))
            hits = [h for h in hits if not (k := bisect.bisect_right(begins, h[0])) or reach[k - 1] < h[1]]
        return sum(w for _, _, w in hits), folded.count(" ") + folded.count("\n") + 1

    def weight(self, text: str | None) -> float:
        """Summed weight of matched words over 1 + words / half_words; 0 for a text without words."""
        total, words = self.matched(text)
        return total / (1 + words / self.lexicon.half_words)

    def score(self, text: str | None) -> float:
        x = self.lexicon.steep * (self.weight(text) - self.lexicon.middle)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _terms(text: str | None, words: set[str] | None, excuses: set[str]) -> set[str]:
    """All words of a text; with `words` those of them with a neighbour, or with `excuses` those of them outside of such phrases."""
    forms = word_forms(text)
    if words is None:
        return {w for form in forms for w in form}
    parts = [whole if whole in words else bare for bare, whole in forms]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    if not excuses:
        return {p for p, a, b in zip(pairs, parts, parts[1:], strict=False) if a in words or b in words}
    excused = [p in excuses for p in pairs]
    return {x for x, before, after in zip(parts, [False, *excused], [*excused, False], strict=True) if x in words and not before and not after}


def _counted(rows: DataFrame, words: set[str] | None = None, excuses: set[str] = frozenset()) -> DataFrame:
    """term, toxic, clean: in how many documents of each label one of the _terms stands."""

    def count(batches):
        for batch in slices(batches):
            seen: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen.update((w, toxic) for w in _terms(text, words, excuses))
            yield pa.record_batch([pa.array([w for w, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "toxic", "docs"])

    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("docs")).otherwise(0))
    return rows.mapInArrow(count, "term string, toxic int, docs long").groupBy("term").agg(of(1).alias("toxic"), of(0).alias("clean"))


def _apart(rows: DataFrame) -> DataFrame:
    """text, toxic without most copies and near copies, which would make their chance words look telling: of the
    documents of a label whose sets of three-word shingles have the same least hash, one stays."""

    def mark(batches):
        for batch in slices(batches):
            keys = []
            for text in batch.column("text").to_pylist():
                parts = folded_words(text)
                keys.append(min((zlib.crc32(" ".join(parts[k : k + 3]).encode("utf-8", "replace")) for k in range(max(1, len(parts) - 2))), default=0))
            yield pa.record_batch([batch.column("text"), batch.column("toxic"), pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    marked = rows.mapInArrow(mark, "text string, toxic int, key long")
    return marked.groupBy("toxic", "key").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Lexicon:
    """A lexicon from doc_id, text and the labels' doc_id, toxic; an id's label is 1 if most of its label rows say so."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    marked = marked.withColumn("h", order)
    # A hash range that holds some more than `rows` of a label leaves few to be ranked.
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, 1.0 if v <= 2 * rows else (1.2 * rows + 200) / v)])
    marked = marked.where(F.pmod("h", F.lit(1 << 40)) < share[F.col("toxic")] * float(1 << 40)) if n else marked
    part = W.Window.partitionBy("toxic", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    marked = marked.withColumn("r", F.row_number().over(part)).where(F.col("r") <= rows)
    marked = marked.withColumn("r", F.row_number().over(W.Window.partitionBy("toxic").orderBy("h", "doc_id"))).where(F.col("r") <= rows)
    # Two labels of `rows` ids each at most: a proven bound.
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked.select("doc_id", "toxic")), "doc_id")
    picked = _apart(picked.select("text", "toxic")).persist()
    try:
        return _learned(picked)
    finally:
        picked.unpersist()


def _learned(picked: DataFrame) -> Lexicon:
    n = {r.toxic: r.n for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # What is collected are terms of the bounded sample that several of its documents share.
    telling = lambda counts: counts.where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds)
    tried = {r.term: float(r.odds) for r in telling(_counted(picked)).where(F.col("odds") >= TRIED_ODDS).collect()}
    excuses = _counted(picked, set(tried)).where(F.col("clean") >= LEAST_DOCS).where(odds <= 0)
    exceptions = tuple(sorted(r.term for r in excuses.collect()))
    if exceptions:
        tried = {r.term: float(r.odds) for r in telling(_counted(picked, set(tried), set(exceptions))).collect()}
    weights = {w: x for w, x in tried.items() if x >= LEAST_ODDS}
    exceptions = tuple(e for e in exceptions if any(w in weights for w in e.split(" ")))
    rough = Lexicon(weights, exceptions)

    def weigh(batches):
        matcher = Matcher(rough)
        for batch in slices(batches):
            found = [matcher.matched(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), batch.column("toxic")], ["total", "words", "toxic"])

    found = [(r.total, r.words, r.toxic) for r in picked.mapInArrow(weigh, "total double, words long, toxic int").collect()]
    # Of lengths that part the labels equally well, the one that changes weights least.
    best = min((*_parted([(x / (1 + n / half), t) for x, n, t in found], toxic, clean), -half) for half in HALF_WORDS)
    middle = best[1]
    return Lexicon(weights, exceptions, max(middle, 1e-6), 4.0 / max(middle, 0.1), -best[2])


def _parted(weighed: list[tuple[float, int]], toxic: int, clean: int) -> tuple[float, float]:
    """The least error (each label's in proportion) of a threshold on weights, and that threshold; between two weights, half way."""
    found = sorted(weighed)
    missed, kept = 0, clean
    error, middle = kept / clean, -1.0
    for k, (w, label) in enumerate(found):
        missed, kept = missed + label, kept - (1 - label)
        nxt = found[k + 1][0] if k + 1 < len(found) else w + 1.0
        if nxt > w and (tried := missed / toxic + kept / clean) < error - 1e-12:
            error, middle = tried, (w + nxt) / 2
    return round(error, 9), middle


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted of every row.

    A null or empty text has no match and scores below one half. Repeated rows are scored
    repeatedly, a null id stays null, and only doc_id and text are read, whole.
    """

    def work(batches):
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array([matcher.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    lexicon = learn(docs, labels.where(~held_out))
    return score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")
