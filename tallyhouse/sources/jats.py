"""Article XML as sections: each block's text with the titles that it stands under, in document order."""

from __future__ import annotations

import itertools
import xml.etree.ElementTree as ET
from collections.abc import Iterator

# Elements whose content is no text of an article's sections.
LEFT_OUT = {"table-wrap", "table-wrap-group", "fig", "fig-group", "supplementary-material", "media", "comment"}
HEADS = {"title", "label", "caption"}


def said(e: ET.Element | None) -> str:
    """An element's text with single spaces, without what is left out."""
    parts: list[str] = []

    def walk(x: ET.Element) -> None:
        if x.tag not in LEFT_OUT:
            parts.append(x.text or "")
            for child in x:
                walk(child)
                parts.append(child.tail or "")
                if child.tag in ("p", "title", "label", "list-item", "def", "term"):
                    parts.append(" ")

    if e is not None:
        walk(e)
    return " ".join("".join(parts).split())


def _lines(e: ET.Element) -> list[str]:
    """The lines of a block: items begin with a dash and are indented below, terms stand before their definitions."""
    if e.tag in LEFT_OUT:
        return []
    if e.tag == "def-item":
        return [f"{said(e.find('term'))}: {' '.join(filter(None, (said(d) for d in e.findall('def'))))}"]
    if e.tag in ("list", "def-list", "boxed-text", "sec", "list-item", "disp-quote"):
        inner = [_lines(child) for child in e]
        own = " ".join((e.text or "").split())
        if e.tag == "list-item":
            flat = [*([own] if own else []), *itertools.chain.from_iterable(inner)]
            return [("- " if k == 0 else "  ") + line for k, line in enumerate(flat)]
        return list(itertools.chain.from_iterable(inner))
    text = said(e)
    return [text] if text else []


def _blocks(e: ET.Element, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str]]:
    for child in e:
        if child.tag == "sec":
            yield from _blocks(child, (*path, said(child.find("title")) or child.get("sec-type") or "section"))
        elif child.tag in ("list", "def-list", "boxed-text"):
            yield path, "\n".join(_lines(child))
        elif child.tag in ("p", "disp-quote", "disp-formula", "preformat", "verse-group"):
            yield path, said(child)
        elif child.tag not in HEADS and child.tag not in LEFT_OUT:
            yield from _blocks(child, path)


def sections(root: ET.Element) -> list[dict]:
    """title and paragraphs of the abstracts and of each stretch of the body under one path of titles; tags have no namespace."""
    out = []
    for abstract in root.iterfind(".//article-meta/abstract"):
        texts = [t for t in (said(p) for p in abstract.iter("p")) if t] or [t for t in [said(abstract)] if t]
        if texts:
            out.append({"title": "Abstract", "paragraphs": texts})
    body = root.find(".//body")
    found = ((p, t) for p, t in _blocks(body, ()) if t) if body is not None else ()
    for path, group in itertools.groupby(found, key=lambda x: x[0]):
        out.append({"title": " > ".join(path) or "Body", "paragraphs": [t for _, t in group]})
    return out


def authors(root: ET.Element) -> list[str]:
    """Names of the authors in order, given names first; groups by their own name."""
    out = []
    for c in root.iterfind(".//contrib-group/contrib"):
        if c.get("contrib-type", "author") == "author":
            name = " ".join(filter(None, (said(c.find(".//given-names")), said(c.find(".//surname"))))) or said(c.find("collab"))
            if name:
                out.append(name)
    return out
