"""Making passages: sentence spans, chunks with overlap, children of bounded length, markup sections, covers.

Packing is sequential inside one section or passage, so it runs as Arrow-batched functions over
rows that hold one section each; sections are independent, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that end a sentence, what may close behind them, and words after which a lone full stop ends none.
MARKS, CLOSERS = ".!?", "\"'”’)"
ABBREVIATIONS = ("e.g", "i.e", "et al", "Fig", "Figs", "Eq", "Eqs", "Dr", "Mr", "Ms", "vs", "etc")
_SHORT = {tuple(re.findall(r"\w+", a.lower())) for a in ABBREVIATIONS}
_WORD = re.compile(r"\S+")
_LETTERS = re.compile(r"\w+")


def _abbreviated(before: str, word: str) -> bool:
    """Whether a word's one full stop belongs to an abbreviation or to a single letter; `before` is the word one space before."""
    if word[-1:] != "." or word[-2:-1] in MARKS:
        return False
    parts = _LETTERS.findall(word)
    if not parts or not word[:-1].endswith(parts[-1]):
        return False
    last, other = parts[-1].lower(), _LETTERS.findall(before)[-1:] if word[:-1] == parts[-1] else []
    return len(last) == 1 and last.isascii() and last.isalpha() or (last,) in _SHORT or (*(x.lower() for x in other), last) in _SHORT and before.endswith(tuple(other))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends of a text's sentences; decimals and abbreviations end none."""
    spans, start, before = [], 0, ""
    for m in _WORD.finditer(text):
        word = m[0]
        if word.rstrip(CLOSERS)[-1:] in MARKS and word.rstrip(CLOSERS) and not _abbreviated(before, word):
            spans.append((start, m.end()))
            start = m.end()
        before = word if text[m.end() : m.end() + 1] == " " and not text[m.end() + 1 : m.end() + 2].isspace() else ""
    if text[start:].strip():
        spans.append((start, len(text)))
    return spans


def sentence_count(text: str) -> Column:
    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda v: len(sentence_spans(v or "")))

    return count(F.col(text))


@dataclass(frozen=True)
class ChunkRules:
    target: int = 350
    least: int = 80
    most: int = 550
    overlap: int = 60


def _sentences(paragraph: str) -> list[str]:
    """A paragraph in parts that end with a mark, where the next begins with a capital or a digit; text between is white space."""
    out, start, ended = [], 0, 0
    for m in _WORD.finditer(paragraph):
        begins = "A" <= m[0][0] <= "Z" or "0" <= m[0][0] <= "9"
        if begins and ended and paragraph[ended - 1] in MARKS:
            out.append(paragraph[start:ended])
            start = m.start()
        ended = m.end()
    return [*out, paragraph[start:]]


def _pieces(paragraph: str, most: int) -> list[tuple[str, int]]:
    """A paragraph in pieces of at most `most` words with their sizes, cut between sentences where possible."""
    parts = _sentences(paragraph)
    upto = list(itertools.accumulate((len(p.split()) for p in parts), initial=0))
    out, i = [], 0
    while i < len(parts):
        # The farthest cut that the running number of words allows; parts without words go along.
        j = bisect.bisect_right(upto, upto[i] + most) - 1
        if j > i:
            out.append((" ".join(parts[i:j]), upto[j] - upto[i]))
            i = j
        else:
            words = parts[i].split()
            out += [(" ".join(words[k : k + most]), min(most, len(words) - k)) for k in range(0, len(words), most)]
            i += 1
    return out


def chunk_paragraphs(paragraphs: list[str], rules: ChunkRules = ChunkRules()) -> list[dict]:
    """A section's chunks: text, numbers (from 1) of the first and last paragraph that each has words of, and how many of
    its words aren't repeated from the chunk before.

    The cuts follow from the pieces' running number of words alone: a chunk ends with the piece
    that reaches the target, or before one that would go beyond the most. It begins with the last
    words of the chunk before, unless that one reached the target and they leave no room for the
    next piece; a piece that had no room in the chunk before is taken together with them.
    """
    pieces = [(text, n, number) for number, p in enumerate(paragraphs, 1) for text, n in _pieces(p, rules.most)]
    upto = list(itertools.accumulate((n for _, n, _ in pieces), initial=0))
    made: list[dict] = []
    i, carried, due = 0, 0, 0
    while i < len(pieces):
        enough = bisect.bisect_left(upto, upto[i] + rules.target - carried, i + 1)
        beyond = bisect.bisect_right(upto, upto[i] + rules.most - carried, i + 1 + due)
        j = min(enough, beyond - 1, len(pieces))
        if upto[j] == upto[i]:
            if j == len(pieces):
                break  # nothing but pieces without words
            i, carried, due = j, 0, 1  # the words of the chunk before leave no room
            continue
        tail = made[-1]["text"].split()[-carried:] if carried else []
        chunk = {"text": "\n\n".join([*([" ".join(tail)] if tail else []), *(p[0] for p in pieces[i:j])]), "first": made[-1]["last"] if carried else pieces[i][2], "last": pieces[j - 1][2], "fresh": upto[j] - upto[i]}
        size, short = carried + upto[j] - upto[i], j == len(pieces) and carried + upto[j] - upto[i] < rules.target
        if short and made and size - carried < rules.least and made[-1]["words"] + size - carried <= rules.most + rules.overlap:
            made[-1]["text"] += "\n\n" + " ".join(chunk["text"].split()[carried:])
            made[-1]["last"] = chunk["last"]
            made[-1]["fresh"] += chunk["fresh"]
        else:
            made.append({**chunk, "words": size})
        i, carried, due = j, min(rules.overlap, size), int(size < rules.target)
    return [{k: c[k] for k in ("text", "first", "last", "fresh")} for c in made]


def chunked(sections: DataFrame, key: list[str], paragraphs: str = "paragraphs", rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Rows of one section each, exploded to its chunks: key, nth, text, first, last, fresh, words and the text's hash."""

    @F.pandas_udf("array<struct<text:string,first:int,last:int,fresh:int>>")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: chunk_paragraphs([p for p in (v if v is not None else []) if p is not None], rules))

    rows = sections.select(*key, F.posexplode(pack(F.col(paragraphs))).alias("nth", "c"))
    return rows.select(*key, "nth", "c.text", "c.first", "c.last", "c.fresh", F.size(F.filter(F.split("c.text", r"\s+"), lambda w: w != "")).alias("words"), F.sha2("c.text", 256).alias("text_sha256"))


def overlap_loss(original: list[str], chunks: list[str], overlap: int) -> int:
    """Words of a section that its chunks, less each one's overlap with the one before, don't have; 0 if nothing is lost."""
    have = Counter(itertools.chain.from_iterable(c.split() for c in chunks))
    want = Counter(itertools.chain.from_iterable(p.split() for p in original))
    return sum((want - have).values())


def children(text: str, most: int, units: list[tuple[int, int]] | None = None) -> list[tuple[int, int, bool]]:
    """Sentences packed to children of at most `most` units, words unless given: start, end, whether a sentence was cut by force.

    Units are counted once for the whole text, so how many a run of sentences has is a difference of two
    running counts, and the last sentence that still fits is looked up. A sentence of its own that
    doesn't fit is cut after every `most` units.
    """
    units = [m.span() for m in _WORD.finditer(text)] if units is None else units
    starts = [a for a, _ in units]
    spans = [(b - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in sentence_spans(text)]
    upto = [bisect.bisect_left(starts, b) for _, b in spans]
    out, nth = [], 0
    while nth < len(spans):
        first = bisect.bisect_left(starts, spans[nth][0])
        fitting = bisect.bisect_right(upto, first + most)
        if fitting > nth:
            out.append((spans[nth][0], spans[fitting - 1][1], False))
        else:
            cuts = [*range(first, upto[nth], most), upto[nth]]
            out += [(units[a][0], units[b - 1][1], True) for a, b in itertools.pairwise(cuts)]
        nth = max(nth + 1, fitting)
    return out


def with_children(passages: DataFrame, key: str, text: str = "text", most: int = 110) -> DataFrame:
    """parent, child id, character span, words and whether it was cut by force, for each child of each passage."""

    @F.pandas_udf("array<struct<start:int,end:int,forced:boolean>>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"start": a, "end": b, "forced": f} for a, b, f in children(v or "", most)])

    rows = passages.select(F.col(key).alias("parent_id"), F.col(text).alias("t"), F.posexplode(cut(F.col(text))).alias("nth", "c"))
    body = F.substring(F.col("t"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return rows.select("parent_id", F.format_string("%s::child:%04d", F.col("parent_id").cast("string"), F.col("nth")).alias("child_id"), "c.start", "c.end", "c.forced", F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).alias("words"))


def children_of_parents(passages: DataFrame, key: str, text: str = "text", most: int = 110) -> DataFrame:
    """Each child with its own text, by a join with its parent: parent_id, child_id, start, end, child."""
    cut = with_children(passages, key, text, most)
    parents = passages.select(F.col(key).alias("parent_id"), F.col(text).alias("_t")).dropDuplicates(["parent_id"])
    return cut.join(parents, "parent_id").select("parent_id", "child_id", "start", "end", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("child"))


def _token_spans(text: str, offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a tokenizer's tokens without white space at their begin; tokens that share a letter are one."""
    out: list[tuple[int, int]] = []
    for a, b in offsets:
        a = b - len(text[a:b].lstrip())
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def token_children(passages: DataFrame, key: str, tokenizer: str, most: int = 128, special: int = 2, text: str = "text") -> DataFrame:
    """Like with_children, with sizes in a tokenizer's tokens and room for its special ones in each child: parent_id, nth, start, end, forced."""

    @F.pandas_udf("array<struct<start:int,end:int,forced:boolean>>")
    def cut(values: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(tokenizer)
        coded = lambda t: made.encode(t, add_special_tokens=False)
        out = []
        for v in values:
            found = []
            for a, b, forced in children(v or "", most - special, _token_spans(v or "", coded(v or "").offsets)):
                # A piece by itself may have more tokens than within its text; such a piece is halved until it fits.
                todo = [(a, b)]
                while todo:
                    x, y = todo.pop()
                    if y - x > 1 and len(coded(v[x:y]).ids) > most - special:
                        todo += [((x + y) // 2, y), (x, (x + y) // 2)]
                    else:
                        found.append({"start": x, "end": y, "forced": forced})
            out.append(found)
        return pd.Series(out)

    return passages.select(F.col(key).alias("parent_id"), F.posexplode(cut(F.col(text))).alias("nth", "c")).select("parent_id", "nth", "c.start", "c.end", "c.forced")


def sentence_letters(text: str) -> Column:
    """How many sentences a text has, and how many letters and signs they have without white space."""

    @F.pandas_udf("sentences int, letters long")
    def count(values: pd.Series) -> pd.DataFrame:
        spans = [[(v or "")[a:b] for a, b in sentence_spans(v or "")] for v in values]
        return pd.DataFrame({"sentences": [len(s) for s in spans], "letters": [sum(len("".join(x.split())) for x in s) for s in spans]})

    return count(F.col(text))


def covering(spans: list[tuple[int, int]], start: int, end: int) -> list[int]:
    """Numbers of spans that cover [start, end): one that does alone, else the fewest by taking what reaches farthest; [] if none do."""
    alone = [k for k, (a, b) in enumerate(spans) if a <= start and end <= b]
    if alone:
        return alone[:1]
    out, at = [], start
    while at < end:
        reach = max((k for k, (a, b) in enumerate(spans) if a <= at < b), key=lambda k: (spans[k][1], -k), default=None)
        if reach is None:
            return []
        out.append(reach)
        at = spans[reach][1]
    return out


def least_hitting_set(groups: list[tuple[str, list[str]]]) -> list[str]:
    """The fewest ids (of several choices the first in order) that meet one of each `any` group and all of each `all` group.

    Each step branches on the ids of the smallest group that isn't met, to a depth that grows until
    it suffices, so the work follows the number of ids needed and not of those there are. A group
    without ids can't be met and asks for nothing more.
    """
    needed = {i for match, ids in groups if match == "all" for i in ids}
    open_ = [set(ids) for match, ids in groups if match == "any" and not set(ids) & needed]
    if not all(open_):
        return sorted(needed)

    def choices(taken: frozenset, more: int) -> Iterator[frozenset]:
        unmet = [g for g in open_ if not g & taken]
        if not unmet:
            yield taken
        elif more:
            for i in min(unmet, key=len):
                yield from choices(taken | {i}, more - 1)

    for size in itertools.count():
        found = {tuple(sorted(c)) for c in choices(frozenset(), size)}
        if found:
            return sorted(needed | set(min(found)))
    raise AssertionError("unreachable")


_BLOCK = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>", re.S | re.I)


def sections_of(markup: str) -> Iterator[dict]:
    """Sections of a marked-up page or article: the heading before, and the paragraphs and list items below it.

    Figures, tables, navigation and what isn't shown are left out.
    """
    title, paragraphs, buffer, skipped, where = "", [], "", 0, None
    pos = 0

    def flush() -> None:
        nonlocal buffer
        words = " ".join(buffer.split())
        if words and where == "p":
            paragraphs.append(words)
        buffer = ""

    for m in itertools.chain(_BLOCK.finditer(markup), [None]):
        if not skipped:
            buffer += markup[pos : m.start() if m else len(markup)]
        pos = m.end() if m else len(markup)
        if not m or not m[2]:
            continue
        name, ends = m[2].lower(), m[0].startswith("</")
        if name in ("nav", "footer", "fig", "figure", "table", "table-wrap", "head", "aside", "form"):
            flush()
            skipped = max(0, skipped + (-1 if ends else 1))
        elif name in ("h1", "h2", "h3", "title"):
            if ends:
                if paragraphs:
                    yield {"title": title, "paragraphs": paragraphs}
                    paragraphs = []
                title, buffer, where = " ".join(buffer.split()), "", None
            else:
                flush()
                where = "h"
        elif name in ("p", "li", "sec", "section", "div", "article", "list", "list-item", "ul", "ol", "body"):
            flush()
            where = "p" if name in ("p", "li", "list-item") and not ends else None
    flush()
    if paragraphs:
        yield {"title": title, "paragraphs": paragraphs}


def sectioned(pages: DataFrame, key: str, markup: str) -> DataFrame:
    @F.pandas_udf("array<struct<title:string,paragraphs:array<string>>>")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: list(sections_of(v or "")))

    return pages.select(key, F.posexplode(read(F.col(markup))).alias("nth", "s")).select(key, "nth", "s.title", "s.paragraphs")
