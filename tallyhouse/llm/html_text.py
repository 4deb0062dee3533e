"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive where their surroundings are like
those of article text and negative where they are like menus and the rest; tags score negative by
how much more often they stand outside articles. One linear scan finds the contiguous region of the
largest score. All weights are learned from a bounded sample of pages that mark their article
themselves, by <article>, <main> or itemprop=articleBody. Names of elements and classes that
usually hold no article text are features like others, to which a few words outside are added as
pseudo-counts; such an element is left out of the region if its words score negative, everything
else in the region is kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import slices, table

#: Pages that weights are learned from at most, those with the least hashes of their ids.
LEARN_PAGES = 500
#: Least and largest cost of a tag, and the most that one set apart element costs, so that an advert doesn't part an article.
TAG_COST, APART_COST = (0.001, 4.0), 5.0
#: Words outside articles that a name is taken to have been seen with, and the log-odds that make a word's score 1.
PSEUDO_WORDS, FULL_ODDS = 20, 4.0
#: Log-odds of a word before its features count: unlike an article if articles were learned from, else like one.
UNKNOWN_ODDS, UNLEARNED_ODDS = -0.5, 0.5

# Kinds of elements, and words in class, id or role that name what isn't an article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "xmp", "noframes"}
APART = {"aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "header", "menu", "nav", "select", "video"} | RAW
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "teaser", "toolbar", "widget", "alert", "contentinfo", "complementary",
}
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: Elements that a class, id or role of NAMES sets apart; headings, paragraphs and inline elements are text whatever their name.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "center", "blockquote", "fieldset", "details"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Run:
    """A piece of text or a tag: the block that it lies in, its features, the number of the element set apart that it
    lies in (0: none), and whether it lies in a marked article."""

    text: str = ""
    tag: str = ""
    block: int = 0
    features: tuple[str, ...] = ()
    apart: int = 0
    article: bool = False


@dataclass
class _Open:
    name: str
    features: tuple[str, ...]
    apart: int
    mark: str
    article: bool


def _about(name: str, attributes: str) -> tuple[tuple[str, ...], str, bool]:
    """An element's features, the one that sets it apart (or none), and whether it marks an article."""
    features, mark, article = [name], name if name in APART else "", name in ("article", "main")
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            for x in value.split():
                features.append(f"{name}.{x}")
                if x in NAMES and name in CONTAINERS and not mark:
                    mark = f"{name}.{x}"
        elif key == "itemprop" and value == "articlebody":
            article = True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            mark = "hidden"
    return tuple(features), mark, article


def runs(page: str) -> list[Run]:
    """A page's texts and tags in order; scripts, styles and the like are left out with their content."""
    found: list[Run] = []
    open_: list[_Open] = []
    names: Counter = Counter()  # how many elements of each name are open
    ground = _Open("", (), 0, "", False)
    pos, block, elements, last = 0, 0, 0, page.rfind(">")

    def text(begin: int, end: int) -> None:
        if end > begin:
            top = open_[-1] if open_ else ground
            around = (top.mark,) if top.apart else tuple(dict.fromkeys(f for x in open_[-4:] for f in x.features))
            found.append(Run(page[begin:end], "", block, around, top.apart, top.article))

    def close(k: int) -> None:
        nonlocal block
        block += any(x.name not in INLINE for x in open_[k:])
        names.subtract(x.name for x in open_[k:])
        del open_[k:]

    def inner(name: str, within: int, stops: set[str]) -> int | None:
        """The innermost open element of a name among the last ones, unless one of `stops` lies inside it."""
        if names[name] > 0:
            for k in range(len(open_) - 1, max(-1, len(open_) - 1 - within), -1):
                if open_[k].name == name:
                    return k
                if open_[k].name in stops:
                    return None
        return None

    while m := _TOKEN.search(page, pos) if pos <= last else None:
        text(pos, m.start())
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        block += name not in INLINE
        if ending:
            k = inner(name, len(open_), set())
            if k is not None:
                found.append(Run(tag=name, apart=open_[k].apart, article=open_[k].article))
                close(k)
            continue
        if name in BLOCKS_END_P and (k := inner("p", len(open_), {"table", "td", "div", "li", "section", "article"})) is not None:
            close(k)
        for other in CLOSES_ITSELF.get(name, ()):
            if (k := inner(other, 5, {"ul", "ol", "dl", "table"})) is not None:
                close(k)
        if name == "body" and (k := inner("head", len(open_), set())) is not None:
            close(k)
        features, mark, article = _about(name, attributes)
        above = open_[-1] if open_ else ground
        # A header inside an article is the article's own heading.
        if name == "header" and above.article:
            mark = ""
        apart, outer = above.apart, above.mark
        if mark and not apart:
            elements += 1
            apart, outer = elements, mark
        found.append(Run(tag=name, apart=apart, article=above.article or article, features=features))
        if name in RAW:
            end = re.compile(f"</{name}", re.I | re.A).search(page, pos)
            stop = page.find(">", end.end()) if end else -1
            pos = len(page) if stop < 0 else stop + 1
        elif name not in VOID and not attributes.endswith("/"):
            open_.append(_Open(name, features, apart, outer, above.article or article))
            names[name] += 1
    text(pos, len(page))
    return found


@dataclass(frozen=True)
class Weights:
    """Log-odds of words by the features around them, and costs of tags by name."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)


def _word_score(run: Run, marked: bool, weights: Weights, before: float) -> float:
    """From -1 to 1. `marked`: the page marks its article, so that being inside it is a feature too. `before`: the odds
    without any feature."""
    if run.apart:
        odds = weights.words.get(run.features[0], -math.log1p(PSEUDO_WORDS))
    else:
        odds = before + sum(weights.words.get(f, 0.0) for f in run.features)
    if marked and (not run.apart or not run.article):
        odds += weights.words.get("inside" if run.article else "outside", FULL_ODDS if run.article else -FULL_ODDS)
    return max(-1.0, min(1.0, odds / FULL_ODDS))


def scored(tokens: list[Run], weights: Weights, before: float = UNLEARNED_ODDS) -> list[float]:
    """Each text's and tag's score; all of one element set apart costs APART_COST at most, and nothing inside a marked article."""
    marked = any(r.article and not r.apart and r.text.strip() for r in tokens)
    scores, paid = [], Counter()
    for run in tokens:
        if run.tag:
            score = -weights.tags.get(run.tag, TAG_COST[0]) if not run.apart and not (marked and run.article) else -TAG_COST[0]
        else:
            score = len(run.text.split()) * _word_score(run, marked, weights, before)
        if run.apart and score < 0:
            most = 0.0 if marked and run.article else APART_COST
            score = -min(-score, most - paid[run.apart])
            paid[run.apart] -= score
        scores.append(score)
    return scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous part of the largest positive sum (of several the first); (0, 0) if there is none."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, begin, end = total, start, k + 1
    return begin, end


def main_text(page: str | None, weights: Weights) -> str:
    """The page's main text; empty for a null or empty page, or where no word scores positive. A page whose words have
    nothing in common with the learned articles is read as if none had been learned from."""
    tokens = runs(page or "")
    marked = any(r.article and not r.apart and r.text.strip() for r in tokens)
    for before in (UNKNOWN_ODDS, UNLEARNED_ODDS) if weights.words else (UNLEARNED_ODDS,):
        begin, end = best_region(scored(tokens, weights, before))
        if end:
            break
    blocks: dict[int, list[str]] = {}
    for run in tokens[begin:end]:
        if not run.tag and not (run.apart and _word_score(run, marked, weights, before) <= 0):
            blocks.setdefault(run.block, []).append(html.unescape(run.text))
    return " ".join(x for x in (" ".join("".join(b).split()) for _, b in sorted(blocks.items())) if x)


def learn(pages: DataFrame, rows: int = LEARN_PAGES) -> Weights:
    """Weights from pages that mark their article; without any, words are positive unless their names set them apart."""
    page = F.col("html").cast("string")
    marks = pages.where(F.lower(page).rlike(r"<article|<main|articlebody")).select(F.xxhash64(F.col("page_id").cast("string"), page, F.lit("weights")).alias("h"), page.alias("html"))
    least = marks.select("h").distinct().orderBy("h").limit(rows).collect()  # hashes alone meet in one task
    if not least:
        return Weights()
    sample = marks.where(F.col("h") <= least[-1].h).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def count(batches):
        for batch in slices(batches):
            seen: Counter = Counter()
            for page in batch.column("html").to_pylist():
                for run in runs(page):
                    if not run.tag:
                        n = len(run.text.split())
                        for f in {*run.features, *(() if run.apart else ("inside" if run.article else "outside",))}:
                            seen[("word", f, run.article)] += n
                    elif not run.apart and run.tag not in ("html", "head", "body", "article", "main"):
                        seen[("tag", run.tag, run.article)] += 1
            columns = zip(*((a, b, c, n) for (a, b, c), n in seen.items()), strict=True) if seen else [()] * 4
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], ["kind", "name", "inside", "n"])

    counts = sample.mapInArrow(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))
    words, tags = {}, {}
    for r in counts.collect():  # features of the sample alone, so bounded by it
        if r.kind == "word":
            # Frames that hold everything tell nothing.
            if r["name"] not in ("html", "body", "article", "main", "div", "section"):
                pseudo = PSEUDO_WORDS if r["name"] in APART or r["name"] == "hidden" or r["name"].partition(".")[2] in NAMES else 0
                words[r["name"]] = max(-FULL_ODDS, min(FULL_ODDS, math.log((r.i + 1) / (r.o + 1 + pseudo))))
        else:
            tags[r["name"]] = max(TAG_COST[0], min(TAG_COST[1], math.log((r.o + 1) / (r.i + 1))))
    return Weights(words, tags)


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page has an empty text; repeated rows are extracted repeatedly; null ids and
    urls stay null; other columns are not read; an empty table gives an empty result.
    """

    def work(batches):
        for batch in slices(batches):
            texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
