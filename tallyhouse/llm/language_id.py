"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (one to three letters of case-folded
words, a word's edges count as a letter) in order. A document's own most frequent n-grams are
compared with each profile by the out-of-place distance: the sum over the document's n-grams of how
far each lies from its place in the profile, or the length of the profile if it isn't there.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallyhouse.llm.common import id_crc, slices, table

#: n-grams of a profile and of a document, and letters of the longest n-gram.
PLACES, LONGEST = 400, 3
#: Profiles are learned from so many documents of each language at most, those with the least hashes of their ids.
LEARN_ROWS = 3000
#: Letters beyond which counting by sorting takes less memory than by a table.
TABLE = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Each code point if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (21 bits a letter) in order of length and code points, and their counts; none without letters."""
    folded = (text or "").lower().encode("utf-32-le", "surrogatepass")
    at = _letters()[np.frombuffer(folded, np.uint32)]
    if not at.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.r_[np.uint32(0), at, np.uint32(0)]
    at = at[np.r_[True, (at[1:] != 0) | (at[:-1] != 0)]]
    known, small = np.unique(at, return_inverse=True)
    # An edge is written as a space, so that a shorter n-gram isn't the same number.
    known, small, width = np.where(known == 0, 32, known).astype(np.int64), small.astype(np.int64), len(known)
    codes, counts = [], []
    for n in range(1, LONGEST + 1):
        packed = small[: len(small) - n + 1].copy()
        for k in range(1, n):
            packed = packed * width + small[k : len(small) - n + 1 + k]
        # An edge stands at an end of an n-gram only, and never alone.
        inner = small[: len(packed)] != 0 if n == 1 else np.ones(len(packed), bool)
        for k in range(1, n - 1):
            inner &= small[k : len(packed) + k] != 0
        packed = packed[inner]
        if width**n <= TABLE:
            table_ = np.bincount(packed, minlength=1)
            found = np.flatnonzero(table_)
            number = table_[found]
        else:
            found, number = np.unique(packed, return_counts=True)
        full = np.zeros(len(found), np.int64)
        for k in range(n - 1, -1, -1):
            full = (full << 21) | known[(found // width**k) % width]
        codes.append(full)
        counts.append(number)
    return np.concatenate(codes), np.concatenate(counts)


def learn(docs: DataFrame, places: int = PLACES, rows: int = LEARN_ROWS) -> dict[str, np.ndarray]:
    """Each language's n-grams, most frequent first (ties: the smaller n-gram), from doc_id, text and non-null lang."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("profiles"))
    ids = docs.select("doc_id", "lang", order.alias("h"))
    # A hash range that holds some more than `rows` of a language leaves few to be ranked.
    n = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, 1.0 if v <= 2 * rows else (1.2 * rows + 200) / v)])
    ids = ids.where(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    # The bound is applied in 64 parts of a language first, so that no task sees a whole language.
    part = W.Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    ids = ids.withColumn("r", F.row_number().over(part)).where(F.col("r") <= rows)
    ids = ids.withColumn("r", F.row_number().over(W.Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= rows)
    # A row for each language, as many as there will be profiles; texts aren't shuffled for the sample.
    last = {r.lang: r.h for r in ids.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return {}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in last.items() for x in kv]), F.col("lang"))
    sample = docs.where((order <= limit) & (F.pmod(order, F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40)))

    def count(batches):
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            found = [ngrams(t) for t in batch.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                mine = [x for x, y in zip(found, langs, strict=True) if y == lang]
                codes, where = np.unique(np.concatenate([c for c, _ in mine]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in mine]), len(codes)).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    totals = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = W.Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram"))
    top = totals.withColumn("place", F.row_number().over(first)).where(F.col("place") <= places)
    out: dict[str, list] = {}
    for r in top.select("lang", "gram", "place").orderBy("lang", "place").collect():  # `places` rows a language
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], places: int = PLACES):
        self.langs, self.places = sorted(profiles), places
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least distance (ties: the first by name), and 1 less the distance's share of the largest one."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        codes = codes[np.argsort(-counts, kind="stable")[: self.places]]
        at = np.searchsorted(self.grams, codes)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != codes)] = len(self.grams)
        rank = self.rank[at]
        away = np.where(rank < 0, self.places, np.abs(rank - np.arange(len(codes))[:, None])).sum(0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.places * len(codes)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row.

    `und` with score 0 for a null text, one without letters, or where nothing was learned. Repeated
    rows are predicted repeatedly; a null id stays null; only doc_id and text are read, whole.
    """
    # Bounded by `places` n-grams for each language.
    known = Profiles(profiles)

    def work(batches):
        for batch in slices(batches):
            found = [known.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """row (all columns of docs), lang_pred and score as of predict(), for each row, so that nothing is joined."""
    known = Profiles(profiles)

    def work(batches):
        for batch in slices(batches):
            found = [known.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["row", "lang_pred", "score"])

    kind = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(work, kind)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    profiles = learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
