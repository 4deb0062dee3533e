"""Fill-in-the-middle by an Aho-Corasick event scan.

A unit is a word with the white space before it, or white space at the text's end. One automaton
finds the events of a text: the ASCII characters at which the class of characters may change, which
are white space, and the sentinels. Between two events of white space lies a gap without any, so a
gap longer than nothing is a word and ends a unit at its second event: units are counted and looked
up by rank from the events alone, and no letter between them is looked at one by one.

Where a text is cut, and into which form it goes, follows from a hash of its id; a text that has a
sentinel itself stays as it is, so every output can be turned back.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import slices, table

# White space, and the sentinels of prefix, suffix and middle.
SPACE, SENTINELS = " \t\n\x0b\x0c\r", ("<P>", "<S>", "<M>")
#: Of 100 documents, those that are transformed, and of 100 of these, those whose suffix comes first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: Events that are held as Python objects at a time.
EVENTS = 65_536


def event_scan(sentinels: tuple[str, ...] = SENTINELS) -> Callable[[str], tuple[np.ndarray, bool]]:
    """A function of a text that gives the ends of its units (code points, ascending) and whether it has a sentinel."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for x in SPACE:
        machine.add_word(x, 0)
    for x in sentinels:
        machine.add_word(x, 1)
    machine.make_automaton()

    def scan(text: str) -> tuple[np.ndarray, bool]:
        if not text:
            return np.zeros(0, np.int64), False
        events, found, last, marked = machine.iter(text), [], -1, False
        while some := list(itertools.islice(events, EVENTS)):
            at, what = np.array(some, np.int64).T
            marked |= bool(what.any())
            at = at[what == 0]
            if len(at):
                found.append(at[np.diff(at, prepend=last) > 1])
                last = int(at[-1])
        return np.r_[np.concatenate(found), len(text)] if found else np.array([len(text)], np.int64), marked

    return scan


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits; those of a null id are drawn as of an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    A null text is an empty one, an empty text is plain; rows with a null id are all drawn alike,
    and so are rows of one id. Repeated rows are returned repeatedly, an empty table gives none,
    other columns aren't read, and texts are whole, whatever their length.
    """
    p, s, m = sentinels

    def work(batches):
        scan = event_scan(sentinels)
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                ends, marked = scan(text)
                n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
                if not text or marked or h3 % 100 >= rate:
                    out.append((n, "plain", None, None, text))
                    continue
                a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                form = "spm" if h4 % 100 < suffix_first else "psm"
                out.append((n, form, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands after each sentinel; a text that was transformed has none itself."""
        i = F.instr(output, F.lit(second))
        j = F.instr(output, F.lit(m))
        return output.substr(F.lit(len(first) + 1), i - len(first) - 1), output.substr(i + len(second), j - i - len(second)), output.substr(j + len(m), F.length(output))

    suffix, prefix, middle = parts(s, p)
    spm = F.concat(prefix, middle, suffix)
    prefix, suffix, middle = parts(p, s)
    return F.when(form == "spm", spm).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
