"""Phrases that are frequent, from vertical positional inverted lists.

Texts of one language are put together in blocks of bounded size, and a block keeps for each of its
words the ascending list of the places where it stands; the end of a piece takes a place too. The
length of a phrase's list, summed over blocks, is its exact frequency. Frequent phrases are extended
level by level: the list of a phrase is merge-joined with the postings of the words that stand at
its occurrences' next places. A posting is worth keeping for that only where it ends a frequent
phrase of the same length, as all parts of a frequent phrase are frequent.

Only what a block counts leaves it: one shuffle a level brings the counts of a phrase together, and
those that are frequent go back to the blocks that have them. A hot phrase is one row a block there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm.common import dropped, made, slices, staged, table

# What parts pieces, and what parts words in a piece.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text of a block; a longer text is cut at ends of pieces.
BLOCK_BYTES = 8 << 20
#: A phrase is named by the first block that has it and its place there: 36 bits and 27.
PLACE_BITS, BLOCKS_OF_A_TASK = 27, 1 << 16
#: A byte that no text has, in place of every end of a piece.
_END = b"\xff"
_TABLE = bytes(_END[0] if x in PIECE_ENDS else x for x in range(256))


def word_lists(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, how often each stands there, and their places, one word's after another's."""
    # bytes.lower() knows A-Z alone, and bytes.split() no white space but PIECE_ENDS and WORD_ENDS. The end of a piece comes first, so its code is 0.
    raw = (_END + _END.join(texts)).lower().translate(_TABLE).replace(_END, b" " + _END + b" ").split()
    coded = pa.array(raw, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    places = np.argsort(codes, kind="stable")[counts[0] :].astype(np.int32)
    return coded.dictionary[1:].cast(pa.string()), counts[1:].astype(np.int32), places


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about BLOCK_BYTES, which end where pieces end."""
    while len(text) > BLOCK_BYTES:
        end = text.translate(_TABLE).find(_END, BLOCK_BYTES)
        if end < 0:
            break
        yield text[:end]
        text = text[end + 1 :]
    yield text


def _blocks(docs: DataFrame, text: str, group: str, unknown: str) -> DataFrame:
    """block, group, n_words, words, counts, places (32-bit, of one word after another)."""

    def work(batches):
        task, made_ = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal made_
            words, counts, places = word_lists(held.pop(name))
            del sizes[name]
            if not len(words):
                return
            if made_ == BLOCKS_OF_A_TASK:
                raise ValueError("a task has too many blocks; give it less by smaller partitions")
            columns = [pa.array([task * BLOCKS_OF_A_TASK + made_], pa.int64()), pa.array([name], pa.string()), pa.array([len(places)], pa.int64())]
            made_ += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts))]
            yield pa.record_batch([*columns, *lists, pa.array([places.tobytes()], pa.binary())], ["block", "group", "n_words", "words", "counts", "places"])

        for batch in slices(batches):
            for name, whole in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _cut((whole or "").encode()):
                    held.setdefault(name, []).append(part)
                    sizes[name] = sizes.get(name, 0) + len(part)
                    if sizes[name] >= BLOCK_BYTES:
                        yield from block(name)
            while sum(sizes.values()) >= 3 * BLOCK_BYTES:  # texts of many groups are held
                yield from block(max(sizes, key=sizes.get))
        for name in list(held):
            yield from block(name)

    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(unknown)).alias("group"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "block long, group string, n_words long, words array<string>, counts array<int>, places binary")


class Lists:
    """A block's vertical lists: of phrase i its name, its last word's name, and where its occurrences begin."""

    def __init__(self, phrases: np.ndarray, words: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.phrases, self.words, self.counts, self.places = phrases, words, counts, places

    @classmethod
    def of(cls, row) -> Lists:
        kinds = (("phrases", np.int64), ("words", np.int64), ("counts", np.int32), ("places", np.int32))
        return cls(*(np.frombuffer(row[k], t) for k, t in kinds))

    def row(self, block: int) -> dict:
        return {"block": block, "phrases": self.phrases.tobytes(), "words": self.words.tobytes(), "counts": self.counts.astype(np.int32).tobytes(), "places": self.places.astype(np.int32).tobytes()}

    def some(self, at: np.ndarray, phrases: np.ndarray, words: np.ndarray) -> Lists:
        """The lists at ascending `at`, under new names."""
        wanted = np.zeros(len(self.counts), bool)
        wanted[at] = True
        return Lists(phrases, words, self.counts[at], self.places[np.repeat(wanted, self.counts)])

    def extended(self) -> tuple[np.ndarray, np.ndarray, Lists]:
        """The phrases one word longer: names of the phrase extended and of the word, and their lists."""
        which = np.repeat(np.arange(len(self.counts)), self.counts)
        order = np.argsort(self.places, kind="stable")
        places, which = self.places[order], which[order]
        # The merge join: no two phrases of a length begin at one place, so the posting next to an occurrence, if there is one, comes next.
        met = np.flatnonzero(places[1:] == places[:-1] + 1)
        words, word = np.unique(self.words, return_inverse=True)
        key = which[met].astype(np.int64) * max(len(words), 1) + word[which[met + 1]]
        by_key = np.argsort(key, kind="stable")
        found, counts = np.unique(key, return_counts=True)
        left, right = self.phrases[found // max(len(words), 1)], words[found % max(len(words), 1)]
        return left, right, Lists(left, right, counts, places[met[by_key]])


_LISTS = "block long, phrases binary, words binary, counts binary, places binary"


def _kept(counted: DataFrame, key: list[str], least: int) -> DataFrame:
    """block, at, key, total and name of what is counted `least` times or more over all blocks."""
    own = F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("at").cast("long"))
    over = W.Window.partitionBy(*key)
    rows = counted.withColumn("own", own).withColumn("total", F.sum("n").over(over)).withColumn("name", F.min("own").over(over)).where(F.col("total") >= least)
    first = F.col("own") == F.col("name")
    return rows.select("block", "at", *[F.when(first, F.col(k)).alias(k) for k in key], "total", "name", first.alias("first"))


def _named(lists: DataFrame, kept: DataFrame, longer: bool) -> DataFrame:
    """The blocks' lists of kept phrases alone, under their names; `longer`: of the phrases one word longer."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["block", "phrases", "words", "counts", "places"])
        right = right.sort_values("at")
        at, names = right["at"].to_numpy(np.int64), right["name"].to_numpy(np.int64)
        row = left.iloc[0]
        if longer:
            _, words, own = Lists.of(row).extended()
            found = own.some(at, names, words[at])
        else:
            none = np.zeros(0, np.int64)
            found = Lists(none, none, np.asarray(row["counts"], np.int64), np.frombuffer(row["places"], np.int32)).some(at, names, names)
        return pd.DataFrame([found.row(int(row["block"]))])

    return lists.groupBy("block").cogroup(kept.select("block", "at", "name").groupBy("block")).applyInPandas(work, _LISTS)


def _longer(lists: DataFrame) -> DataFrame:
    """block, at, left, word, n of the phrases one word longer."""

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, word, found = Lists.of(row).extended()
                for at in range(0, len(left), 65_536):
                    part = slice(at, at + 65_536)
                    n = len(left[part])
                    yield pa.record_batch([pa.array(np.full(n, row["block"])), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(left[part]), pa.array(word[part]), pa.array(found.counts[part].astype(np.int64))], ["block", "at", "left", "word", "n"])

    # A block is one row; few of them are a batch.
    return lists.mapInArrow(work, "block long, at int, left long, word long, n long")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", group: str = "lang", unknown: str = "und") -> tuple[DataFrame, DataFrame]:
    """(group, phrase, size, a) of all phrases of 1 to `longest` words that stand `least` times or more in a group, and (group, n) of all words."""
    spark = docs.sparkSession

    def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
        return staged(df, tag), made()[-1]

    blocks, blocks_at = written(_blocks(docs, text, group, unknown), "blocks")
    n = staged(blocks.groupBy("group").agg(F.sum("n_words").alias("n")), "group-words")
    words = blocks.select("block", "group", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", "group", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    kept, kept_at = written(_kept(words, ["group", "word"], least), "words-kept")
    last, at = written(kept.where("first").select("name", "group", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("total").alias("a")), "phrases")
    levels, level_paths = [last], [at]
    spoken = last.select(F.col("name").alias("word"), F.col("phrase").alias("next"))
    lists, lists_at = written(_named(blocks.select("block", "counts", "places"), kept, False), "lists")
    dropped(spark, [blocks_at, kept_at])
    for size in range(2, longest + 1):
        kept, kept_at = written(_kept(_longer(lists), ["left", "word"], least), "phrases-kept")
        found = kept.where("first").join(last.select(F.col("name").alias("left"), "group", "phrase"), "left").join(spoken, "word")
        last, at = written(found.select("name", "group", F.concat_ws(" ", "phrase", "next").alias("phrase"), F.lit(size).alias("size"), F.col("total").alias("a")), "phrases")
        levels.append(last)
        level_paths.append(at)
        older = [lists_at, kept_at]
        if size < longest:
            lists, lists_at = written(_named(lists, kept, True), "lists")
        dropped(spark, older)
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    every = staged(every.select("group", "phrase", "size", "a"), "all-phrases")
    dropped(spark, level_paths)
    return every, n


def _floor_share(times: int, a: Column, b: Column) -> Column:
    """floor(times * a / b), exact beyond 64 bits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(times).cast("decimal(19,0)") * wide(a), wide(b))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, absorbed: int = 80, text: str = "text", group: str = "lang", unknown: str = "und") -> DataFrame:
    """group, rank, phrase, a, l, r, n, score: each group's first `top` phrases of 2 to `longest` words.

    A-Z are lower-cased, texts fall into pieces at . , ; : ! ? and line ends, and pieces into words at
    spaces and tabs; a phrase lies within a piece. a counts all its occurrences in the group, l and r
    those of its first and its last words where it is cut, n the group's words. The score is
    floor(2000000 * a / (l + r)) of the cut that gives the least, of equal ones the first. Phrases that
    stand in a longer one of `absorbed` percent of their occurrences or more are left out. Equal scores
    go by larger a, then by the phrase's bytes. A null group is `unknown`; a null or empty text has no
    words; rows are counted as often as they are repeated; an empty table gives none, and columns
    besides the text and the group aren't read.
    """
    every, n = frequent_phrases(docs, least, longest, text, group, unknown)
    some = every.where("size > 1")
    words = F.split("phrase", " ", -1)
    part = lambda begin, size: F.array_join(F.slice(words, begin, size), " ")
    cuts = some.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": part(F.lit(1), F.col("cut")), "tail": part(F.col("cut") + 1, F.col("size") - F.col("cut"))})
    count_of = lambda by, name: every.select("group", F.col("phrase").alias(by), F.col("a").alias(name))
    cuts = cuts.join(count_of("head", "l"), ["group", "head"]).join(count_of("tail", "r"), ["group", "tail"])
    scored = cuts.withColumn("score", _floor_share(2_000_000, F.col("a"), F.col("l") + F.col("r")))
    scored = scored.groupBy("group", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("group", "phrase", "a", "x.l", "x.r", "x.score")
    inner = some.where("size > 2").withColumn("inner_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner_size") + 1)))
    inner = inner.select("group", part(F.col("begin"), F.col("inner_size")).alias("phrase"), F.col("a").alias("longer")).groupBy("group", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    left = scored.join(inner, ["group", "phrase"], "left").where(F.coalesce(wide("longer") * 100 < wide("a") * absorbed, F.lit(True))).join(n, "group")
    rank = F.row_number().over(W.Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("group", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collocations(table(spark, sf_dir, "documents"))
    return rows.select(F.col("group").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, greatest(CAST(len(w) AS BIGINT) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
  FROM cut),
f AS (SELECT lang, phrase, len(string_split(phrase, ' ')) AS k, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
cand AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k BETWEEN 2 AND 4),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT s.lang, s.phrase, s.a, s.c, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * s.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts s JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:s.c], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[s.c + 1:s.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
subs AS (
  SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, k), lambda z: list_transform(range(1, k - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' '))))) AS phrase
  FROM cand WHERE k > 2),
longest AS (SELECT lang, phrase, max(longer) AS longer FROM subs GROUP BY lang, phrase),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
  FROM best b JOIN total t ON t.lang = b.lang LEFT JOIN longest g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.longer IS NULL OR CAST(100 AS HUGEINT) * g.longer < CAST(80 AS HUGEINT) * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
