"""Best-fit packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths (at most as many bars as a sequence has tokens) reaches the
driver. There the configuration program, which asks for the fewest sequences that cover the
histogram, is worked by multiplicative weights. A knapsack dynamic program prices configurations
under the present weights: its table has the best filling of every remaining room, so one program
gives for each length the best configuration that holds it. Configurations that are priced within
TOLERANCE of the best one are taken fractional numbers of times, and the weights of the lengths
that they cover fall. Each program's weights also give a lower bound by duality.

The fractional solution is rounded down, then configurations of large fractions are taken once more
where their pieces are left. The few pieces that remain are a smaller program of the same kind,
which is solved and rounded in the same way until none are left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.llm.common import slices, staged, table
from tallyhouse.llm.tokens import encoder

#: Programs that are priced before each step takes all that it can, the share of the scarcest length that a step
#: takes until then, how fast weights fall, and how far from the best price a configuration may be.
STEPS, SHARE, ETA, TOLERANCE = 12, 0.5, 1.0, 0.02
#: Prices begin as length to this power, so that long pieces are placed early.
POWER = 1.02
#: Rows that are encoded at once.
BATCH_ROWS = 2048
#: Fractions of a piece below this are rounding errors.
TINY = 1e-7


@dataclass
class Program:
    """A fractional solution: configurations (how often each holds each size), how many times each is taken, and the
    largest dual bound on the number of sequences."""

    patterns: np.ndarray
    times: np.ndarray
    bound: float


def _knapsack(sizes: np.ndarray, gain: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every room up to the capacity: the largest gain of sizes that fill it, and one of them (-1: the same as a smaller room)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(sizes[0]), capacity + 1):
        tried = value[c - sizes[: upto[c]]] + gain[: upto[c]]
        k = int(tried.argmax())
        if tried[k] > value[c - 1]:
            value[c], choice[c] = tried[k], k
        else:
            value[c] = value[c - 1]
    return value, choice


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, steps: int = STEPS) -> Program:
    """The configuration program of ascending sizes by multiplicative weights; no size is covered beyond its count.

    After 3 * steps programs what isn't covered is left to the next program."""
    left, weight, bound = counts.astype(float), np.ones(len(sizes)), 0.0
    patterns: dict[tuple[tuple[int, int], ...], float] = {}
    for step in range(3 * steps):
        live = np.flatnonzero(left > TINY)
        if not len(live):
            break
        # The dual price of a size: its length, raised while the program has covered less of it than of others.
        price = weight[live] * sizes[live] ** POWER
        value, choice = _knapsack(sizes[live], price, capacity)
        dual = np.zeros(len(sizes))
        dual[live] = price / value[capacity]
        bound = max(bound, float(counts @ dual))
        share = SHARE if step < steps else 1.0
        rooms, picks, lives, own = value.tolist(), choice.tolist(), live.tolist(), sizes.tolist()
        least = (1 - TOLERANCE) * rooms[capacity]
        taken = np.zeros(len(sizes))
        # Scarce and long sizes first: they have the fewest configurations to lie in.
        for k in range(len(lives) - 1, -1, -1):
            s = lives[k]
            room = capacity - own[s]
            if left[s] <= TINY or float(price[k]) + rooms[room] < least:
                continue
            pattern = {s: 1}
            while room > 0:
                pick = picks[room]
                if pick < 0:
                    room -= 1
                    continue
                t = lives[pick]
                pattern[t] = pattern.get(t, 0) + 1
                room -= own[t]
            scarce = min(pattern, key=lambda t: left[t] / pattern[t])
            times = share * left[scarce] / pattern[scarce]
            if times <= TINY:
                left[scarce] = 0.0  # rounding gives such a rest to the next program
                continue
            for t, n in pattern.items():
                left[t] -= times * n
                taken[t] += times * n
            key = tuple(sorted(pattern.items()))
            patterns[key] = patterns.get(key, 0.0) + times
        weight *= np.exp(-ETA * taken / counts)
        weight /= weight[live].max()
    table = np.zeros((len(patterns), len(sizes)), np.int64)
    for row, key in zip(table, patterns, strict=True):
        for t, n in key:
            row[t] = n
    return Program(table, np.array(list(patterns.values())), bound)


def _fill(pattern: np.ndarray, sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A configuration within the pieces that are left, its room used by the largest of them that fit."""
    pattern = np.minimum(pattern, left)
    room = capacity - int(pattern @ sizes)
    k = np.searchsorted(sizes, room, side="right") - 1
    while k >= 0 and room > 0:
        take = min(int(left[k] - pattern[k]), room // int(sizes[k]))
        if take > 0:
            pattern[k] += take
            room -= take * int(sizes[k])
            k = min(k, int(np.searchsorted(sizes, room, side="right"))) - 1
        else:
            k -= 1
    return pattern


def rounded(program: Program, sizes: np.ndarray, left: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Configurations taken whole numbers of times within the pieces that are left, and what then remains."""
    out, left = [], left.copy()
    whole = np.floor(program.times + TINY).astype(np.int64)
    for k in np.flatnonzero(whole):
        out.append((program.patterns[k], int(whole[k])))
        left -= whole[k] * program.patterns[k]
    rest = program.times - whole
    best: tuple[int, np.ndarray] | None = None
    for k in np.argsort(-rest, kind="stable"):
        wanted = program.patterns[k]
        if rest[k] <= TINY or not left[wanted > 0].any():
            continue
        # Pieces of a configuration that are used up are replaced by others, if that fills it as well.
        pattern = wanted if (wanted <= left).all() else _fill(wanted, sizes, left, capacity)
        size = int(pattern @ sizes)
        if size >= int(wanted @ sizes):
            out.append((pattern, 1))
            left -= pattern
        elif best is None or size > best[0]:
            best = size, pattern
    if not out and best is not None:
        out.append((best[1], 1))
        left -= best[1]
    return out, left


def solve(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """Configurations (size: how often) with how many sequences use each; together they use every piece once."""
    full = histogram.get(capacity, 0)
    sizes = np.array(sorted(s for s, n in histogram.items() if n and s < capacity), np.int64)
    out, left = [({capacity: 1}, full)] if full else [], np.array([histogram[int(s)] for s in sizes], np.int64)
    while left.any():
        live = np.flatnonzero(left)
        mine, n = sizes[live], left[live]
        placed, left[live] = rounded(fractional(mine, n, capacity, steps), mine, n, capacity)
        out += [({int(s): int(k) for s, k in zip(mine, p, strict=True) if k}, times) for p, times in placed]
    return out


def least_sequences(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> int:
    """A lower bound on the number of sequences: the largest of the program's dual bounds, of the tokens, and for each
    least size of the pieces too long to share with it, those that need one sequence of two, and the room they leave."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    if not len(sizes):
        return 0
    best = max(math.ceil(fractional(sizes, counts, capacity, steps).bound - 1e-6), -(-int(sizes @ counts) // capacity))
    for least in [1, *sizes[2 * sizes <= capacity].tolist()]:
        alone, half = sizes > capacity - least, 2 * sizes > capacity
        paired, small = half & ~alone, ~half & (sizes >= least)
        room = int(counts[paired].sum()) * capacity - int(sizes[paired] @ counts[paired])
        more = -(-max(0, int(sizes[small] @ counts[small]) - room) // capacity)
        best = max(best, int(counts[half].sum()) + more)
    return best


@dataclass
class Packing:
    """pieces: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32 and where they were written.
    placements: a row for each piece with its sequence_id and offset."""

    pieces: DataFrame
    placements: DataFrame
    sequences: int

    def filled(self) -> DataFrame:
        """sequence_id, ids: the packed sequences themselves."""
        rows = self.placements.join(self.pieces.select("part", "row", "ids"), ["part", "row"])
        parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
        return parts.select("sequence_id", F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def cut(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """The documents' ids with the end id, in pieces of at most `length`; part and row name each piece, nth counts a
    part's pieces of one length."""

    def pieces(batches):
        part, row, seen = TaskContext.get().partitionId(), 0, {}
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, BATCH_ROWS):
            ids, out = encoder(tokenizer).encode(batch.column("text")), []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                x += end
                for piece, at in enumerate(range(0, len(x), 4 * length)):
                    y = x[at : at + 4 * length]
                    n = len(y) // 4
                    out.append((part, row, doc_id, piece, at // 4, n, seen.get(n, 0), y))
                    seen[n] = seen.get(n, 0) + 1
                    row += 1
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "row", "doc_id", "piece", "start", "length", "nth", "ids"])

    kind = "part long, row long, doc_id long, piece long, start long, length long, nth long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, kind).withColumn("ids_crc32", F.crc32("ids"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, steps: int = STEPS) -> Packing:
    """Pack every document's ids into sequences of at most `length` tokens.

    A null or empty text is the end id alone; a text longer than a sequence is cut into full pieces
    and a last one; repeated rows are packed repeatedly; null ids stay null; columns besides doc_id
    and text are not read; an empty table has no pieces and no sequences.
    """
    pieces = staged(cut(docs, tokenizer, end_id, length), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    per_part = staged(per_part, "piece-lengths")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = solve(histogram, length, steps)
    # For each size, in order: how many of its pieces stand before a configuration's, and where they lie in its sequences.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        place = 0
        for size, k in pattern.items():
            slots.setdefault(size, []).append((taken.get(size, 0), first, k, place))
            taken[size] = taken.get(size, 0) + k * times
            place += k * size
        first += times
    if taken != histogram:
        raise RuntimeError("a piece has no slot")
    # Bounded by the configurations, at most a few for each possible length, whatever the number of documents.
    known = {s: np.array(x, np.int64) for s, x in slots.items()}
    before = W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Parts times lengths grow with the corpus, so the offsets are never broadcast.
    light = pieces.drop("ids").join(offsets.hint("merge"), ["part", "length"])

    def place(batches):
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                rows = known[int(s)]
                rows = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - rows[:, 0]
                sequence[mine] = rows[:, 1] + nth // rows[:, 2]
                offset[mine] = rows[:, 3] + nth % rows[:, 2] * s
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    light = light.select("part", "row", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    placements = light.mapInArrow(place, "part long, row long, doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return Packing(pieces, placements, first)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.placements.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
