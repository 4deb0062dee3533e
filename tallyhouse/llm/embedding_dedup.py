"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own. A pair of centroids, one
of each half, is a cell of the product grid, under which a vector is posted. A vector's search goes
through the cells in the order of how near they can come to it: the distance from one of its halves
to the part of space that is nearest to another centroid is at least the distance to the plane
between the two, and the squares of both halves add up. The multi-sequence traversal merges the two
sorted lists of squares and ends where the sum exceeds a reach. The reach is learned: it is as wide
as the share TARGET of partners at the threshold itself, in directions drawn at random, and every
pair that the sample holds needs. A reach of 2 - 2 * threshold would lose nothing; it is the bound.

What is met is verified by the exact cosine. Equal vectors are one node from the start, however
many copies there are. Cells are compared in blocks of bounded size, so a cell that holds a third of
all vectors is dealt over many tasks; a block passes on what is linear in its rows, the number of
each vector's links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import slices, staged, table
from tallyhouse.llm.near_dedup import components

#: Vectors of each length that codebooks and the reach are learned from at most, those with the least hashes.
SAMPLE = 20_000
#: Vectors of a cell if all were alike full, and the most centroids of a half.
CELL_ROWS, MOST_CENTROIDS = 128, 1024
#: Share of the partners at the threshold, the worst case, that lie within the reach, and how many are drawn to learn it.
TARGET, DRAWN = 0.9999, 40_000
#: Rows and searches of a block.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024
#: Tasks over which a hot key's rows are dealt.
SALTS = 8


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids of some half vectors by Lloyd's rounds from a fixed draw."""
    centroids = x[np.random.default_rng(size).choice(len(x), size, replace=False)].copy()
    for _ in range(rounds):
        label = _squares(x, centroids).argmin(1)
        counts = np.bincount(label, minlength=size)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, x)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


class Grid:
    """The codebooks of one length of vectors and the reach of a search."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float):
        """`sample`: unit vectors; `rows`: how many there are in all."""
        half = sample.shape[1] // 2
        size = max(1, min(MOST_CENTROIDS, len(sample), round(math.sqrt(rows / CELL_ROWS))))
        self.cuts = (slice(0, half), slice(half, None))
        self.books = [codebook(sample[:, c], size if c.stop != 0 else 1) for c in self.cuts]
        self.apart = [np.sqrt(np.maximum(0, _squares(b, b))) for b in self.books]
        self.reach = self._reach(sample, threshold)

    def own(self, x: np.ndarray) -> np.ndarray:
        a, b = (_squares(x[:, c], book).argmin(1) for c, book in zip(self.cuts, self.books, strict=True))
        return a.astype(np.int64) * len(self.books[1]) + b

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half the least squared distance from a vector to what is nearest to each centroid."""
        out = []
        for c, book, apart in zip(self.cuts, self.books, self.apart, strict=True):
            d = _squares(x[:, c], book)
            near = d.argmin(1)
            plane = (d - d[np.arange(len(d)), near][:, None]) / np.maximum(2 * apart[near], 1e-12)
            out.append(np.maximum(0, plane) ** 2)
        return out

    def to(self, bounds: list[np.ndarray], cells: np.ndarray) -> np.ndarray:
        width, at = len(self.books[1]), np.arange(len(cells))
        return bounds[0][at, cells // width] + bounds[1][at, cells % width]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the cells that their searches visit, nearest first."""
        first, second = self.bounds(x)
        order_1, order_2 = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        first, second = np.take_along_axis(first, order_1, 1), np.take_along_axis(second, order_2, 1)
        rows, cells, sums = [], [], []
        # Step r of the traversal takes the r-th nearest part of the first half with all parts of the second that still lie within reach.
        for r in range(first.shape[1]):
            open_ = np.flatnonzero(first[:, r] + second[:, 0] <= self.reach)
            if not len(open_):
                break
            total = first[open_, r][:, None] + second[open_]
            i, j = np.nonzero(total <= self.reach)
            rows.append(open_[i])
            cells.append(order_1[open_[i], r] * np.int64(len(self.books[1])) + order_2[open_[i], j])
            sums.append(total[i, j])
        rows, cells, sums = map(np.concatenate, (rows, cells, sums))
        order = np.lexsort((sums, rows))
        return rows[order], cells[order]

    def _reach(self, sample: np.ndarray, threshold: float) -> float:
        rng = np.random.default_rng(len(sample))
        q = sample[rng.integers(0, len(sample), DRAWN)]
        away = rng.normal(size=q.shape)
        away -= (away * q).sum(1)[:, None] * q
        norm = np.sqrt((away * away).sum(1))[:, None]
        partner = threshold * q + math.sqrt(max(0.0, 1 - threshold**2)) * away / np.where(norm > 0, norm, 1)
        needed = [np.quantile(self.to(self.bounds(q), self.own(partner)), TARGET, method="higher")]
        some, cells = sample[:4096], self.own(sample[:4096])
        i, j = np.nonzero(some @ some.T >= threshold)
        needed.append(self.to([b[i] for b in self.bounds(some)], cells[j]).max(initial=0.0))
        return float(min(max(needed) + 1e-9, max(0.0, 2 - 2 * threshold) + 1e-9))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # squares of very large and very small components stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


def links_of(left: np.ndarray, q: np.ndarray, right: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of q (of nodes `left`) and x (`right`) are linked; a node isn't linked with itself."""
    q, x = _unit(q), _unit(x)
    cosine = q @ x.T
    # Those within rounding of the threshold are computed one by one.
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    cosine[i, j] = (q[i] * x[j]).sum(1)
    return (cosine >= threshold) & (left[:, None] != right[None, :])


def trees(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of two sides' nodes the smallest one that its links reach, itself included."""
    a, b, far = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], far).min(1, initial=far))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], far).min(0, initial=far))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _posted(nodes: DataFrame, grids: dict[int, Grid], search: bool) -> DataFrame:
    """node, copies, v, own (cell), cell: a row under its own cell, or for each cell that its search visits."""

    def work(batches):
        for batch in slices(batches, 1024):
            for dim in np.unique(np.asarray(batch.column("dim"))).tolist():
                part = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
                x = _unit(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                own = grids[dim].own(x) if dim in grids else np.zeros(part.num_rows, np.int64)
                rows, cells = grids[dim].visits(x) if search and dim in grids else (np.arange(part.num_rows), own)
                columns = [part.column(c).take(pa.array(rows)) for c in ("node", "copies", "dim", "v")]
                yield pa.record_batch([*columns, pa.array(own[rows]), pa.array(cells)], ["node", "copies", "dim", "v", "own", "cell"])

    return nodes.select("node", "copies", "dim", "v").mapInArrow(work, "node long, copies long, dim int, v array<double>, own long, cell long")


def _blocks(searches: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with i and j: a cell's searches are dealt over i and its rows over j, and each goes to every block of the other."""
    key = ["dim", "cell"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nj"))
    asked = searches.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("ni"))
    dealt = staged(sizes.join(asked, key), "cells")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (
        searches.join(dealt, key).withColumn("i", own("ni")).withColumn("j", every("nj")).drop("ni", "nj"),
        rows.join(dealt, key).withColumn("j", own("nj")).withColumn("i", every("ni")).drop("ni", "nj"),
    )


def _linked(nodes: DataFrame, grids: dict[int, Grid], threshold: float) -> DataFrame:
    """node, n, root: how many vectors a block has linked with a node, and the smallest node of its tree there."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": [], "n": [], "root": []}, dtype="int64")
        if not len(left) or not len(right):
            return none
        a, b = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
        linked = links_of(a, np.stack(left["v"]), b, np.stack(right["v"]), threshold)
        i, j = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(i):
            return none
        linked, a, b = linked[np.ix_(i, j)], a[i], b[j]
        copies_a, copies_b = left["copies"].to_numpy(np.int64)[i], right["copies"].to_numpy(np.int64)[j]
        grid = grids.get(int(left["dim"].iloc[0]))
        back = np.zeros(len(b), np.int64)
        if grid:
            # A link that the other side's search doesn't meet is counted for both here.
            bounds = grid.bounds(_unit(np.stack(right["v"].iloc[j])))
            at_a, at_b = np.nonzero(linked)
            unseen = grid.to([x[at_b] for x in bounds], left["own"].to_numpy(np.int64)[i][at_a]) > grid.reach
            np.add.at(back, at_b[unseen], copies_a[at_a[unseen]])
        root_a, root_b = trees(a, b, linked)
        return pd.DataFrame({"node": np.r_[a, b], "n": np.r_[linked @ copies_b, back], "root": np.r_[root_a, root_b]})

    key = ["dim", "cell", "i", "j"]
    searches, rows = _blocks(_posted(nodes, grids, True), _posted(nodes, grids, False))
    return searches.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(compare, "node long, n long, root long")


def _grids(nodes: DataFrame, threshold: float) -> dict[int, Grid]:
    """A grid for each length of vectors that more than two cells' rows have; all shorter tables are one cell."""
    grids = {}
    # Few lengths have so many vectors; usually there is one.
    for row in nodes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL_ROWS).collect():
        h = F.pmod(F.xxhash64("v"), F.lit(1_000_000))
        near = nodes.where((F.col("dim") == row.dim) & (h < min(1_000_000, int(1_000_000 * 2 * SAMPLE / row.n) + 1)))
        sample = near.orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").toPandas()
        grids[row.dim] = Grid(_unit(np.stack(sample["v"])), row.n, threshold)
    return grids


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (it is that one).

    Linked are vectors of one length whose cosine in double precision is `threshold` or more. Vectors
    that are null, zero or hold null or non-finite components are linked with nothing and are their own
    component; rows with a null id are linked with nothing, have a null component and are kept.
    Repeated rows are returned repeatedly and count as one vector; different vectors of one id are
    vectors of their own, and each is kept if its component's smallest id is its id. An empty table
    gives an empty result; other columns are not read.
    """
    v = F.col(vector).cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    # Numbers are written so that they read back the same, so equal keys are equal vectors.
    rows = staged(rows.withColumn("set_key", F.when(F.coalesce(good, F.lit(False)), F.unhex(F.sha2(F.to_json("v"), 256)))), "vectors")
    taking = rows.where("set_key IS NOT NULL").groupBy("set_key", "vec_id").agg(F.first("v").alias("v"))
    nodes = taking.groupBy("set_key").agg(F.first("v").alias("v"), F.count("*").alias("copies"))
    nodes = staged(nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v")}), "nodes")
    grids = _grids(nodes, threshold)
    linked = staged(_linked(nodes, grids, threshold), "links")
    edges = staged(linked.where("root < node").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct(), "edges")
    found = nodes.select("set_key", "node", "copies").join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = found.join(linked.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select("set_key", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    found = found.withColumn("salt", F.explode(salts))
    rows = rows.drop("v").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(found, ["set_key", "salt"], "left")
    rows = staged(rows.select("vec_id", "component", "n_links"), "rows")
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least")).withColumn("salt", F.explode(salts))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(least, ["component", "salt"], "left")
    component = F.coalesce("least", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.v AS av, b.v AS bv FROM v a JOIN v b ON len(a.v) = len(b.v) AND (a.vec_id <> b.vec_id OR a.v <> b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
n AS (SELECT a, av, count(*) AS n FROM links GROUP BY a, av)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, least(e.vec_id, coalesce(l.b, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id AND n.av = CAST(e.embedding AS DOUBLE[]) LEFT JOIN least l ON l.a = e.vec_id
"""
