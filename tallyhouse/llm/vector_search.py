"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and posts each under the signed axis that it is nearest to. A query looks into the
`probes` axes nearest to it in each of `tables` tables, and into more of the first one's, nearest
first, until those hold EXACT_ROWS vectors; all that it meets there is ranked by the exact inner
product. Where norms differ, a coordinate that makes all norms equal is added for the
hashing, so that the largest inner product stays the nearest direction.

Buckets are compared in blocks of bounded size, so a bucket that holds a third of all vectors is
dealt over many tasks, each of which passes on a query's best `k` alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import slices, staged, table

TABLES, PROBES = 7, 13
#: Vectors that a query's buckets in the first table hold at least (of fewer, all), and candidates and queries of a block.
EXACT_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 512, 2048, 1024
#: Tasks among which one query's partial results are merged first.
MERGE_PARTS = 8


def _signs(table_: int, size: int) -> np.ndarray:
    return np.random.default_rng([table_, size]).choice([-1.0, 1.0], (3, size))


def rotated(x: np.ndarray, table_: int) -> np.ndarray:
    """Rows (of a power of two) turned by one table's pseudo-rotation."""
    size = x.shape[1]
    for signs in _signs(table_, size):
        x = x * signs
        h = 1
        while h < size:  # fast Hadamard transform
            y = x.reshape(len(x), size // (2 * h), 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), size)
            h *= 2
        x = x / np.sqrt(size)
    return x


def axes(x: np.ndarray, table_: int, probes: int) -> np.ndarray:
    """The signed axes (2 * axis + sign) nearest to each row, nearest first."""
    y = rotated(x, table_)
    both = np.stack([-y, y], 2).reshape(len(y), -1)
    return np.argsort(-both, 1, kind="stable")[:, :probes] if probes > 1 else both.argmax(1)[:, None]


def _hashed(x: np.ndarray, top: float, uneven: bool, query: bool) -> np.ndarray:
    """Rows as they are hashed: of unit norm, one coordinate longer if norms are uneven, filled to a power of two."""
    square = (x * x).sum(1)
    x = x / np.sqrt(square if query or not uneven else np.full(len(x), top))[:, None]
    if uneven:
        x = np.c_[x, np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - square / top))]
    width = 1 << (x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def taking_part(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v, dim of rows with an id and a finite vector that isn't zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _codes(batch: pa.RecordBatch, dim: int, plan: dict, probes: int) -> tuple[pa.RecordBatch, np.ndarray, int]:
    """The rows of one length, the buckets of each in every table (nearest first), and how many buckets a table has."""
    part = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
    _, top, uneven = plan[dim]
    x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
    y = _hashed(x, top, uneven, probes > 1)
    size = 2 * y.shape[1]
    return part, np.stack([t * size + axes(y, t, min(probes, size)) for t in range(TABLES)], 1) + (dim << 32), size


def _rows_of(part: pa.RecordBatch, which: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([part.column("vec_id").take(pa.array(which)), part.column("v").take(pa.array(which)), pa.array(bucket)], ["vec_id", "v", "bucket"])


def _posted(rows: DataFrame, plan: dict) -> DataFrame:
    """vec_id, v, bucket: a row for each table."""

    def work(batches):
        for batch in slices(batches, 1024):
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                part, codes, _ = _codes(batch, dim, plan, 1)
                yield _rows_of(part, np.repeat(np.arange(part.num_rows), TABLES), codes.ravel())

    return rows.mapInArrow(work, "vec_id long, v array<double>, bucket long")


def _probing(queries: DataFrame, plan: dict, held: dict[int, int]) -> DataFrame:
    """vec_id, v, bucket: a row for each bucket that a query looks into; `held` has the rows of each bucket."""

    def work(batches):
        for batch in slices(batches, 1024):
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                part, codes, size = _codes(batch, dim, plan, 1 << 30)
                wanted = np.zeros(codes.shape, bool)
                wanted[:, :, :PROBES] = True
                sizes = np.array([held.get((dim << 32) + k, 0) for k in range(size)], np.int64)[codes[:, 0] - (dim << 32)]
                wanted[:, 0] |= np.cumsum(sizes, 1) - sizes < EXACT_ROWS
                which, _, _ = np.nonzero(wanted)
                yield _rows_of(part, which, codes[wanted])

    return queries.mapInArrow(work, "vec_id long, v array<double>, bucket long")


def best_of(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each query's k best other ids and their best exact inner products, best first, ties to the smaller id."""
    out_ids, out_scores = [], []
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    rough = q @ x.T
    rough[queries[:, None] == ids[None, :]] = -np.inf
    # An id takes one of the k places, however many rows it has.
    for i, (row, best) in enumerate(zip(rough, np.maximum.reduceat(rough, starts, 1), strict=True)):
        cut = np.partition(best, -k)[-k] if len(best) > k else -np.inf
        # Rows within rounding of the last place stay until they have been computed one by one.
        near = np.flatnonzero(row >= cut - 1e-9 * max(1.0, abs(cut))) if np.isfinite(cut) else np.flatnonzero(row > -np.inf)
        exact = (x[near] * q[i]).sum(1)
        order = np.lexsort((ids[near], -exact))
        if len(starts) < len(ids):
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])]
        order = order[:k]
        out_ids.append(ids[near][order])
        out_scores.append(exact[order])
    return out_ids, out_scores


def _compared(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, ids, scores of every query in every block of rows that its keys name."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        ids, scores = best_of(left["vec_id"].to_numpy(), np.stack(left["v"]), right["vec_id"].to_numpy(), np.stack(right["v"]), k)
        return pd.DataFrame({"query_id": left["vec_id"], "ids": ids, "scores": scores})

    key = ["bucket", "i", "j"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(compare, "query_id long, ids array<bigint>, scores array<double>")


def _merged(parts: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    grouped = parts.groupBy(*by).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores")).select("query_id", "ids", "scores")

    def merge(batches):
        for batch in slices(batches, 1024):
            ids, scores = [], []
            for a, b in zip(batch.column("ids"), batch.column("scores"), strict=True):
                a, b = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((a, -b))
                first = np.unique(a[order], return_index=True)[1]
                order = order[np.sort(first)][:k]
                ids.append(a[order])
                scores.append(b[order])
            yield pa.record_batch([batch.column("query_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    return grouped.mapInArrow(merge, "query_id long, ids array<bigint>, scores array<double>")


def _blocks(queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with i and j: a bucket's queries are dealt over i, its rows over j, and each goes to every block of the other."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nj"))
    asked = queries.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("ni"))
    # A row for each bucket: tables times twice the padded dimension, for each dimension of vectors there is.
    dealt = staged(sizes.join(asked, "bucket"), "buckets")
    own = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (
        queries.join(dealt, "bucket").withColumn("i", own("ni")).withColumn("j", every("nj")).drop("ni", "nj"),
        rows.join(dealt, "bucket").withColumn("j", own("nj")).withColumn("i", every("ni")).drop("ni", "nj"),
    )


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (double inner product) of each query's k nearest other vectors found.

    `queries` marks the rows that ask. Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; vectors meet those of their own length alone.
    Rows of one id count as that vector's own; a repeated id is returned once, with its best score.
    Ties go to the smaller id. A query that finds fewer than k of what there is asks all rows. An
    empty table gives an empty result; other columns are not read.
    """
    # Rows that are repeated whole would only be compared again.
    rows = staged(taking_part(vectors, key, vector).distinct().withColumn("asks", queries), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.min(norm).alias("low")).collect()  # a row for each length of vector
    plan = {r.dim: (r.n, r.top, r.low < r.top * (1 - 1e-4)) for r in stats}
    asking, posted = rows.where("asks").drop("asks"), _posted(rows.drop("asks"), plan)
    # A number for each bucket: tables times twice the padded length, for each length of vectors there is.
    held = {r.bucket: r.n for r in posted.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    found = _compared(*_blocks(_probing(asking, plan, held), posted), k)
    found = _merged(found, ["query_id", F.pmod(F.hash("ids"), F.lit(MERGE_PARTS))], k)
    found = staged(_merged(found, ["query_id"], k), "found")
    # Where buckets held too little: all rows, in blocks. Of EXACT_ROWS or fewer a query has met all.
    few = asking.join(found.where(F.size("ids") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if plan and min(n for n, _, _ in plan.values()) <= EXACT_ROWS:
        exact = [d for d, (n, _, _) in plan.items() if n <= EXACT_ROWS]
        few = few.where(~F.col("dim").isin(exact))
    if few.take(1):
        one = lambda df: df.select("vec_id", "v", F.shiftleft(F.col("dim").cast("long"), 32).alias("bucket"))
        rest = _merged(_compared(*_blocks(one(few), one(rows)), k), ["query_id"], k)
        found = found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(rest)
    out = found.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)
