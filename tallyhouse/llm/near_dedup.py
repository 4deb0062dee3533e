"""Near-duplicate classes by a signature-coordinate inverted join.

Each document's set of word shingles gives a signature of `coordinates` minima. Documents are
posted under every (coordinate, value) pair. A pair of documents is a candidate if it collides in
at least `matches` coordinates, which a pair at the threshold misses with a chance of about one in
ten million. Values that one document alone has are skipped; of the rest only a document's rarest
m - matches + 1 are merged (a candidate pair shares one of them at least), and collisions are
counted there on the whole signatures. Candidates are confirmed on full shingle sets, and classes
are the connected components of the confirmed links.

Equal sets are one node from the start, however many copies there are. Posting lists up to
SHORT_LIST documents give their candidate pairs; longer lists are dealt in blocks, a block is
compared in one task with a sparse product of its sets, and only a spanning forest of the links
leaves the task. Blocks are joined by one node of each tree, and only what is then still apart from
its list's largest class is compared with the whole list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import dropped, made, slices, small, staged, table

#: Minima of a signature, and how many of them a candidate pair shares.
COORDINATES, MATCHES = 24, 8
#: Longest posting list whose pairs are listed; longer ones are compared in blocks.
SHORT_LIST = 48
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 2_000_000
#: Copies of a hot key's counterpart, so that its rows are dealt to as many tasks.
SALTS = 8

_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z lower-cased, words apart by ASCII white space.

    A shorter text has its whole word sequence as the one shingle; a null text or one without words has none.
    """
    import xxhash

    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space alone.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(31) + _SEED + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The smallest of the shingles' hashes under each of several hash functions, as 32-bit values."""
    out = np.empty(coordinates, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            salted = (shingles ^ _mix(np.uint64([k + 1]))[0]) * np.uint64(0xFF51AFD7ED558CCD)
            out[k] = (salted ^ (salted >> np.uint64(32))).min()
    return (_mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set, null if empty), signature."""
    import xxhash  # noqa: F401  the workers need it

    def work(batches):
        import xxhash

        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            marks = [signature(s, coordinates) if len(s) else None for s in sets]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_key", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_shingles long, set_key binary, signature array<int>")


def _salted(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join whose hot keys are dealt over SALTS tasks; `right` has a row for each key and is repeated."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return left.join(right, [key, "salt"]).drop("salt")


def _postings(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """node, token, listed: each node's rarest tokens and how many nodes the token's list has."""
    tokens = nodes.select("node", F.posexplode("signature").alias("k", "v")).select("node", (F.col("v").cast("long") * coordinates + F.col("k")).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("listed")).where("listed > 1")
    shared = _salted(tokens, counts, "token", "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("listed", "token"))).alias("x"))
    shared = shared.where(F.size("x") >= matches)
    rarest = shared.select("node", F.explode(F.expr(f"slice(x, 1, size(x) - {matches} + 1)")).alias("y"))
    return rarest.select("node", "y.token", "y.listed")


def _short_lists(postings: DataFrame, nodes: DataFrame, matches: int, percent: int) -> DataFrame:
    """a, b: candidate pairs of the short lists, each found in as many lists as the pair shares."""
    lists = postings.where(F.col("listed") <= SHORT_LIST).join(nodes.select("node", "signature", "n_shingles"), "node")
    lists = lists.groupBy("token").agg(F.collect_list(F.struct("node", "n_shingles", "signature")).alias("x")).where(F.size("x") > 1)

    def pairs(batches):
        for batch in slices(batches, 1024):
            out_a, out_b = [], []
            for members in batch.column("x"):
                rows = members.values
                ids = rows.field("node").to_numpy(zero_copy_only=False)
                sizes = rows.field("n_shingles").to_numpy(zero_copy_only=False)
                marks = rows.field("signature").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                a, b = np.triu_indices(len(ids), 1)
                same = (marks[a] == marks[b]).sum(1) >= matches
                # Sets whose sizes differ by more than the threshold allows can't be linked.
                small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                same &= (small * 100 >= large * percent) & (ids[a] != ids[b])
                out_a.append(np.minimum(ids[a], ids[b])[same])
                out_b.append(np.maximum(ids[a], ids[b])[same])
            yield pa.record_batch([pa.array(np.concatenate(out_a or [np.zeros(0, np.int64)])), pa.array(np.concatenate(out_b or [np.zeros(0, np.int64)]))], ["a", "b"])

    return lists.select("x").mapInArrow(pairs, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def links_of_block(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some documents, each edge to the smallest of its tree."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what one document alone has is in no intersection
    column, where = np.unique(column[shared], return_inverse=True)[1], where[shared]
    width = int(column.max()) + 1 if len(column) else 0
    label = np.arange(len(sets))
    order = np.argsort(column, kind="stable")
    column, where = column[order], where[order]
    strip = max(1, 16_000_000 // max(len(sets), 1))
    for at in range(0, len(sets), 512):
        rows = slice(at, min(at + 512, len(sets)))
        common = np.zeros((rows.stop - at, len(sets)), np.float32)
        for c in range(0, width, strip):
            lo, hi = np.searchsorted(column, [c, c + strip])
            matrix = np.zeros((len(sets), min(strip, width - c)), np.float32)
            matrix[where[lo:hi], column[lo:hi] - c] = 1
            common += matrix[rows] @ matrix.T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (sizes[rows, None] + sizes[None, :] - common)
        for row in linked:
            met = np.unique(label[row])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    out = set()
    for x in np.unique(label):
        members = ids[label == x]
        out.update((int(members.min()), int(y)) for y in members if y != members.min())
    return sorted(out)


def _in_blocks(rows: DataFrame, by: str, nodes: DataFrame, name: str) -> DataFrame:
    """rows with `name`, the number of the block that a node of a list is dealt to, and `name`s, how many blocks its list has."""
    sized = rows.join(nodes.select("node", "n_shingles"), "node")
    dealt = sized.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias(f"{name}s"))
    return _salted(rows, dealt, by, "node").withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"{name}s")).cast("int"))


def _linked(groups: DataFrame, keys: list[str], sets: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links of each group of nodes."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_of_block(group["node"].to_numpy(), list(group["shingles"]), percent), columns=["a", "b"], dtype="int64")

    return groups.select(*keys, "node").distinct().join(sets, "node").groupBy(*keys).applyInPandas(compare, "a long, b long")


def _pairs_of_blocks(some: DataFrame, every: DataFrame) -> DataFrame:
    """token, i, j, node: each block of some nodes of a list beside each block of every node of it."""
    counts = some.select("token", "is").distinct().join(every.select("token", "js").distinct(), "token")
    left = some.select("token", "i", "node").join(counts, "token").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1)))
    right = every.select("token", "j", "node").join(counts, "token").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1)))
    return left.select("token", "i", "j", "node").union(right.select("token", "i", "j", "node"))


def _long_lists(postings: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, known: DataFrame) -> DataFrame:
    """a, b: edges that connect what is linked within the long lists, and the known edges.

    First each node is compared within one block of one of its lists, then the smallest node of
    each tree that this gives with those of the same list's other blocks. A group of near copies is
    one class by then, after work in proportion to its size. What classes a list then still has
    beside its largest one is compared with the whole list, so that no link between two of them is
    missed; only lists of many documents that aren't linked take more than that.
    """
    long = postings.where(F.col("listed") > SHORT_LIST)
    if not long.take(1):
        return known
    own = long.groupBy("node").agg(F.max_by("token", F.struct("listed", "token")).alias("token"))
    own = staged(_in_blocks(own, "token", nodes, "i"), "blocks")
    trees = staged(_linked(own, ["token", "i"], sets, percent), "trees")
    roots = own.select("token", "node").join(trees.select(F.col("b").alias("node")), "node", "left_anti")
    several = roots.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    roots = roots.join(several, "token", "left_semi")
    across = _linked(_pairs_of_blocks(_in_blocks(roots, "token", nodes, "i"), _in_blocks(roots, "token", nodes, "j")), ["token", "i", "j"], sets, percent)
    edges = staged(known.union(trees).union(across).distinct(), "first-links")
    classes = components(edges)
    edges = staged(classes.select(F.col("component").alias("a"), F.col("node").alias("b")), "stars-so-far")
    named = long.select("token", "node").join(edges.withColumnRenamed("b", "node"), "node", "left").select("token", "node", F.coalesce("a", "node").alias("class"))
    named = staged(named, "classes-of-lists")
    largest = named.groupBy("token", "class").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
    named = staged(_salted(named, largest.select("token", "largest"), "token", "node"), "open-lists")
    if not named.take(1):
        return edges
    minor = named.where(F.col("class") != F.col("largest")).select("token", "node")
    rest = _pairs_of_blocks(_in_blocks(minor, "token", nodes, "i"), _in_blocks(named.select("token", "node"), "token", nodes, "j"))
    return edges.union(_linked(rest, ["token", "i", "j"], sets, percent))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of a written table of edges a < b, by alternating stars."""
    spark, last = edges.sparkSession, []
    while True:
        before = set(made())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: a node's larger neighbours move to its smallest one.
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(small, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        new = staged(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "stars")
        dropped(spark, last)  # the round before
        last = [p for p in made() if p not in before]
        # Stars are done when nobody is both a centre and a leaf.
        if not new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1) and not _shared_leaf(new):
            return new.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
        edges = new


def _shared_leaf(edges: DataFrame) -> bool:
    return bool(edges.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").take(1))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is that one).

    Linked are documents with 100 * intersection >= percent * union of their shingle sets. A null
    or empty text, or one without words, has no shingles and is its own class. Rows with a null id
    are linked with nothing, get a null component and are kept. Repeated rows are returned
    repeatedly, each kept if its id is its class's smallest; different texts of one id are one node. Other columns are not read; an empty
    table gives an empty result.
    """
    signed = staged(_signed(docs, words, coordinates), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    nodes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = staged(nodes, "nodes")
    postings = staged(_postings(nodes, coordinates, matches), "postings")
    sets = staged(_sets_of(docs, postings, words), "sets")
    pairs = _short_lists(postings, nodes, matches, percent).distinct()
    known = staged(_confirmed(pairs, sets, percent), "short-links")
    found = components(staged(_long_lists(postings, nodes, sets, percent, known).distinct(), "links"))
    named = nodes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets_of(docs: DataFrame, postings: DataFrame, words: int) -> DataFrame:
    """node, shingles of the nodes that have candidates, from their texts."""

    def work(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    # Texts aren't shuffled while the ids of those that have candidates are few.
    wanted = small(staged(postings.select("node").distinct(), "wanted"))
    return rows.join(wanted, "node", "left_semi").mapInArrow(work, "node long, shingles array<bigint>")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
