"""Gates before a corpus, its vectors and its settings are used, and what of a run may be shown.

Checks of tables are tables of check and ok; checks of settings name every field that is wrong.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.loading import _table


def corpus_checks(papers: DataFrame, chunks: DataFrame, version: str, most: int, overlap: int, least: int, topics: list[str], papers_between: tuple[int, int]) -> DataFrame:
    """check, ok of papers (paper_id, pmid, pmcid, doi, title, topics, version, source_sha256) and chunks (chunk_id,
    paper_id, section, text, text_sha256, words, version)."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    unique = lambda c: F.count_distinct(c) == F.count(c)
    of_papers = papers.agg(
        F.count("*").between(*papers_between).alias("paper_count_in_target_range"), (F.count_distinct("paper_id") == F.count("*")).alias("paper_ids_unique"),
        (unique("pmid") & F.bool_and(full("pmid"))).alias("pmids_unique_and_present"), (unique("pmcid") & F.bool_and(full("pmcid"))).alias("pmcids_unique_and_present"),
        unique("doi").alias("dois_unique"), F.bool_and(full("title")).alias("required_metadata_present"), F.bool_and(F.col("version") == version).alias("_paper_version"),
        F.bool_and(F.length("source_sha256") == 64).alias("source_hash_present"), (F.size(F.array_except(F.array(*[F.lit(t) for t in topics]), F.flatten(F.collect_set("topics")))) == 0).alias("topic_coverage_present"),
    )
    of_chunks = chunks.agg(
        (F.count_distinct("chunk_id") == F.count("*")).alias("chunk_ids_unique"), F.bool_and(full("text") & (F.col("text_sha256") == F.sha2("text", 256))).alias("chunk_text_and_hash_present"),
        F.bool_and(F.col("words") <= most + overlap).alias("chunk_word_limit_respected"), F.bool_and(F.col("version") == version).alias("_chunk_version"),
    )
    childless = papers.join(chunks, "paper_id", "left_anti").agg((F.count("*") == 0).alias("every_paper_has_chunks"))
    strays = chunks.join(papers, "paper_id", "left_anti").agg((F.count("*") == 0).alias("every_chunk_maps_to_paper"))
    short = chunks.groupBy("paper_id", "section").agg(F.count("*").alias("n"), F.min("words").alias("w")).agg(F.bool_and((F.col("w") >= least) | (F.col("n") == 1)).alias("short_chunks_are_complete_sections"))
    row = of_papers.crossJoin(of_chunks).crossJoin(childless).crossJoin(strays).crossJoin(short)  # one row each
    return _table(row.withColumn("corpus_version_constant", F.col("_paper_version") & F.col("_chunk_version")).drop("_paper_version", "_chunk_version"))


def vector_checks(vectors: DataFrame, chunks: DataFrame, key: str, vector: str, size: int, tolerance: float = 1e-3) -> DataFrame:
    """check, ok: every chunk has one vector, and vectors are whole, finite and of norm one."""
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    own = vectors.agg(
        (F.count_distinct(key) == F.count("*")).alias("one_vector_each"), F.bool_and(F.coalesce(F.size(v) == size, F.lit(False))).alias("size"),
        F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"), F.bool_and(F.coalesce(F.abs(norm - 1) <= tolerance, F.lit(False))).alias("unit_norm"),
    )
    bare = chunks.select(key).join(vectors, key, "left_anti").agg((F.count("*") == 0).alias("every_chunk_has_a_vector"))
    strays = vectors.select(key).join(chunks, key, "left_anti").agg((F.count("*") == 0).alias("every_vector_has_a_chunk"))
    return _table(own.crossJoin(bare).crossJoin(strays))  # one row each


@dataclass(frozen=True)
class RetrievalSettings:
    """Settings of a search; `wrong` names the fields that contradict each other."""

    mode: str = "hybrid"
    depth: int = 50
    top_k: int = 10
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    unit: str = "chunk"
    child_depth: int | None = None
    policy: str = "positive_only"

    def wrong(self) -> list[str]:
        rules = {
            "mode": self.mode in ("hybrid", "dense", "lexical"), "top_k": self.top_k >= 1, "depth": self.depth >= self.top_k, "unit": self.unit in ("chunk", "child"),
            "dense_weight": self.dense_weight > 0 or self.mode == "lexical", "lexical_weight": self.lexical_weight > 0 or self.mode == "dense",
            "child_depth": (self.child_depth is None) == (self.unit == "chunk") and (self.child_depth or self.depth) >= self.top_k, "policy": self.policy in ("positive_only", "retain_zero"),
        }
        return sorted(k for k, ok in rules.items() if not ok)


def file_hash(root: str, name: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file below a folder; a name that leads out of it, by links too, is an error."""
    top = os.path.realpath(root)
    path = os.path.realpath(os.path.join(top, name))
    if os.path.commonpath([top, path]) != top:
        raise ValueError(f"{name} leaves its folder")
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def changed_files(root: str, hashes: dict[str, str]) -> list[str]:
    """Names whose files aren't there or have another hash than was written down."""
    out = []
    for name, told in sorted(hashes.items()):
        try:
            if file_hash(root, name) != told:
                out.append(name)
        except FileNotFoundError:
            out.append(name)
    return out


def differences(a: object, b: object, tolerance: float = 1e-9, at: str = "$") -> Iterable[str]:
    """Places in which two nested values differ; numbers may differ by a tolerance, booleans are no numbers."""
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted({*a, *b}, key=str):
            if k in a and k in b:
                yield from differences(a[k], b[k], tolerance, f"{at}.{k}")
            else:
                yield f"{at}.{k}"
    elif isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        if len(a) != len(b):
            yield f"{at}[]"
        for k, (x, y) in enumerate(zip(a, b, strict=False)):
            yield from differences(x, y, tolerance, f"{at}[{k}]")
    elif isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        if not math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance):
            yield at
    elif a != b or isinstance(a, bool) != isinstance(b, bool):
        yield at


def response_text(body: str | None) -> str | None:
    """The text of a provider's JSON answer in any of its public layouts, without a code fence around it."""
    try:
        said = json.loads(body or "")
    except ValueError:
        return None
    found: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            if isinstance(x.get("output_text"), str):
                found.append(x["output_text"])
            elif isinstance(x.get("text"), str):
                found.append(x["text"])
            elif isinstance(x.get("content"), str):
                found.append(x["content"])
            else:
                for k in ("output", "choices", "message", "content", "parts", "candidates"):
                    walk(x.get(k))

    walk(said)
    text = "".join(found).strip()
    if text.startswith("```") and text.endswith("```") and "\n" in text:
        text = text[text.index("\n") + 1 : -3].strip()
    return text or None


class Unit(NamedTuple):
    """What a unit is called: English nouns in the singular, signs and short forms, and Korean nouns."""

    nouns: str
    signs: str = ""
    korean: str = ""


#: Units by the sign that a quantity gets, kind by kind. Plurals follow by rule.
UNITS = {
    # mass and force
    "g": Unit("gram gramme", "g", "그램"), "kg": Unit("kilogram kilogramme kilo", "kg", "킬로그램 킬로"), "mg": Unit("milligram", "mg", "밀리그램"), "lb": Unit("pound", "lb lbs", "파운드"), "N": Unit("newton", "n", "뉴턴"),
    # length and speed
    "m": Unit("meter metre", "m", "미터"), "cm": Unit("centimeter centimetre", "cm", "센티미터 센치"), "mm": Unit("millimeter millimetre", "mm", "밀리미터"), "km": Unit("kilometer kilometre", "km", "킬로미터"),
    "m/s": Unit("", "m/s"), "km/h": Unit("", "km/h kph"),
    # time
    "s": Unit("second sec", "s", "초"), "min": Unit("minute min", "", "분"), "h": Unit("hour hr", "h", "시간"), "d": Unit("day", "", "일"), "wk": Unit("week wk", "", "주간 주"), "mo": Unit("month", "", "개월 월"), "y": Unit("year yr", "", "년간 년"),
    # electricity and power
    "A": Unit("ampere amp", "a", "암페어"), "V": Unit("volt", "v", "볼트"), "W": Unit("watt", "w", "와트"),
    # counts and shares
    "%": Unit("percent", "%", "퍼센트 프로"), "set": Unit("set", "", "세트"), "rep": Unit("repetition rep time", "", "회 번"), "session": Unit("session", "", "세션"),
}
ACRONYMS = ("e1rm", "1rm", "rir", "rpe")
#: Days that are written in full, whose numbers are no quantities.
DATES = r"(?<![0-9])[0-9]{4}(?:[-/.][0-9]{1,2}[-/.][0-9]{1,2}|\s?년\s?[0-9]{1,2}\s?월\s?[0-9]{1,2}\s?일)(?![0-9])"


def unit_forms() -> dict[str, str]:
    """Every written form of a unit with the unit's sign."""
    forms = {}
    for sign, unit in UNITS.items():
        for noun in unit.nouns.split():
            forms |= {noun: sign, noun + "s": sign}
        forms |= dict.fromkeys([*unit.signs.split(), *unit.korean.split()], sign)
    return forms


def quantities(text: Column) -> Column:
    """Sorted `number unit` of a text, the unit by its sign and power, as it is written if it isn't known, or empty.

    A hyphen or a space may stand before a known unit and ², ^2, ³ or ^3 after it; full dates are left out.
    """
    said = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), DATES, " ")
    forms = unit_forms()
    names = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    known = "|".join(sorted((re.escape(w) for w in forms), key=lambda w: (-len(w), w)))
    found = F.regexp_extract_all(said, F.lit(rf"(?<![0-9a-z.])[0-9]+(?:\.[0-9]+)?(?:[\s-]?(?:{known})(?:[²³]|\^[23])?(?![a-z/])|[a-z°µ][a-z°µ/²³^]*)?"), F.lit(0))

    def one(x: Column) -> Column:
        number = F.regexp_extract(x, r"^[0-9]+(?:\.[0-9]+)?", 0)
        unit = F.regexp_replace(F.regexp_replace(F.substring(x, F.length(number) + 1, F.length(x)), r"^[\s-]", ""), r"\^", "")
        power = F.translate(F.regexp_extract(unit, "[²³23]$", 0), "²³", "23")
        bare = F.regexp_replace(unit, "[²³23]$", "")
        return F.concat_ws(" ", number, F.nullif(F.coalesce(F.concat(F.element_at(names, bare), power), unit), F.lit("")))

    return F.array_sort(F.transform(found, one))


def lost_in_translation(source: Column, translated: Column) -> Column:
    """What a translation doesn't keep: numbers, their units, acronyms; repeats count."""
    numbers = lambda q: F.array_sort(F.transform(q, lambda x: F.substring_index(x, " ", 1)))
    named = lambda t: F.array_sort(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"(?<![a-z0-9])(?:" + "|".join(ACRONYMS) + ")(?![a-z])"), F.lit(0)))
    a, b = quantities(source), quantities(translated)
    return F.array_compact(F.array(F.when(numbers(a) != numbers(b), "number_preservation"), F.when(a != b, "unit_preservation"), F.when(named(source) != named(translated), "acronym_preservation")))


def prepared_query(mode: str, question: Column, generated: Column, translated: Column, problem: Column) -> Column:
    """lexical, dense and fallback: what each search is asked. A mode's own text is used if it is there and nothing is wrong with
    it; else the question, and the reason is told."""
    texts = {"original": (question, question), "generated": (generated, generated), "translated_lexical": (translated, question), "translated_both": (translated, translated)}
    lexical, dense = texts[mode]
    own = generated if mode == "generated" else translated if mode.startswith("translated") else question
    missing = F.coalesce(F.trim(own), F.lit("")) == ""
    fallback = F.when(F.lit(mode == "original"), F.lit(None).cast("string")).when(missing, "missing_output").when(problem.isNotNull(), problem)
    pick = lambda c: F.when(fallback.isNull(), c).otherwise(question)
    return F.struct(pick(lexical).alias("lexical"), pick(dense).alias("dense"), fallback.alias("fallback"))


def grader_disagreement(predicted: Column, gold: Column) -> Column:
    """How a grade and the gold differ: false_sufficient, false_insufficient, unknown where one is missing, or agree."""
    return F.when(predicted.isNull() | gold.isNull(), "unknown").when(predicted & ~gold, "false_sufficient").when(~predicted & gold, "false_insufficient").otherwise("agree")


def eligible_cases(cases: DataFrame) -> DataFrame:
    """Cases with the reason that keeps them out of a held-out measurement: no answer, no required gold, or gold outside the corpus; null: eligible."""
    reason = F.when(~F.coalesce("answerable", F.lit(False)), "unanswerable").when(F.coalesce("required_groups", F.lit(0)) == 0, "no_required_gold").when(F.coalesce("gold_missing", F.lit(0)) > 0, "gold_outside_corpus")
    return cases.withColumn("excluded", reason)


def public_view(rows: DataFrame, allowed: list[str], lists: dict[str, int]) -> DataFrame:
    """The allowed columns in a fixed order, lists cut to what may be shown, each with how many it leaves out; others never appear."""
    out = []
    for c in sorted(set(allowed) & set(rows.columns)):
        n = lists.get(c)
        out += [F.slice(c, 1, n).alias(c), F.greatest(F.size(c) - n, F.lit(0)).alias(f"{c}_omitted")] if n else [F.col(c)]
    return rows.select(*out)


def json_safe(rows: DataFrame) -> Column:
    """A row as JSON with sorted names: decimals as numbers, dates and times in ISO form, nulls kept."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def safe(c: str) -> Column:
        if kinds[c].startswith("decimal"):
            return F.col(c).cast("double").alias(c)
        if kinds[c] == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if kinds[c].startswith("timestamp") else F.col(c)

    return F.to_json(F.struct(*[safe(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One line of JSON with sorted names for each row, in as many files as there are partitions; an existing path is an error."""
    rows.select(json_safe(rows).alias("value")).write.mode("errorifexists").text(path)


def named_nodes(node: Column, aliases: dict[str, str]) -> Column:
    """Node names as they are reported: an alias's own name, others as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), node), node)
