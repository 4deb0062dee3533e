"""Where passages stand in texts, and which chunks cover a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a passage's beginning by which places are looked up, and places of a bin in which spans and chunks meet.
ANCHOR, BIN = 8, 256
#: Passages that are sent to every executor at most.
BROADCAST_PASSAGES = 100_000


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")


def located(passages: DataFrame, texts: DataFrame, passage: str, key: str, text: str = "text") -> DataFrame:
    """passage, key, start, end: every place (in words, from 0, end not included) where a text has all words of a passage in order.

    A passage's first ANCHOR words, or all of a shorter one's, are hashed, and so is every window of a
    text that is as long; equal hashes meet, and the whole passage is compared there. Overlapping places
    all count. Passages and texts that are null or without words are found nowhere and hold none.
    """
    sought = passages.select(F.col(passage).alias("_p"), words(text).alias("_sought")).where(F.size("_sought") > 0)
    sought = sought.withColumn("_width", F.least(F.lit(ANCHOR), F.size("_sought"))).withColumn("_h", F.xxhash64(F.slice("_sought", F.lit(1), F.col("_width"))))
    # One row for each length that passages begin with, at most ANCHOR.
    widths = sorted(r[0] for r in sought.select("_width").distinct().collect())
    held = texts.select(F.col(key).alias("_k"), words(text).alias("_w"))
    windows = held.select("_k", "_w", F.explode(F.array(*[F.lit(n) for n in widths] or [F.lit(ANCHOR)])).alias("_width")).where(F.size("_w") >= F.col("_width"))
    windows = windows.select("_k", "_w", "_width", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_width") + 1), lambda i: F.xxhash64(F.slice("_w", i, F.col("_width"))))).alias("start", "_h"))
    few = sought.limit(BROADCAST_PASSAGES + 1).count() <= BROADCAST_PASSAGES
    met = windows.join(F.broadcast(sought) if few else sought, ["_width", "_h"])
    met = met.where(F.slice("_w", F.col("start") + 1, F.size("_sought")) == F.col("_sought"))
    return met.select(F.col("_p").alias(passage), F.col("_k").alias(key), "start", (F.col("start") + F.size("_sought")).alias("end"))


def covered(spans: DataFrame, chunks: DataFrame, span: list[str], key: str) -> DataFrame:
    """Columns of `span`, how and chunks (numbers in order) for each span: start, end of a text against chunks nth, start, end of it.

    `alone`: the first chunk by number that holds the whole span. `together`: the fewest chunks that hold
    it between them, by taking again and again the one that reaches farthest (of several the first).
    `none`: part of the span is in no chunk. Spans and chunks meet in bins of places, each pair in the
    first bin that both have, so a long text isn't all its spans times all its chunks; a span then
    gathers the chunks that overlap it. Empty spans are left out.
    """
    bins = lambda a, z: F.sequence(F.floor(F.col(a) / BIN), F.floor((F.col(z) - 1) / BIN))
    left = spans.where(F.col("start") < F.col("end")).withColumn("_bin", F.explode(bins("start", "end")))
    right = chunks.where(F.col("start") < F.col("end")).select(F.col(key).alias("_k"), F.col("nth").cast("long").alias("nth"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("z")).withColumn("_bin", F.explode(bins("a", "z")))
    met = left.join(right, (F.col(key) == F.col("_k")) & (left["_bin"] == right["_bin"]) & (F.col("a") < F.col("end")) & (F.col("z") > F.col("start")))
    first = F.greatest(F.floor(F.col("start") / BIN), F.floor(F.col("a") / BIN))
    near = met.where(left["_bin"] == first).groupBy(*span, "start", "end").agg(F.array_sort(F.collect_list(F.struct("a", "nth", "z"))).alias("near"))
    rows = spans.where(F.col("start") < F.col("end")).select(*span, "start", "end").distinct().join(near, [*span, "start", "end"], "left")
    rows = rows.withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType)))
    alone = F.array_min(F.transform(F.filter("near", lambda c: (c["a"] <= F.col("start")) & (c["z"] >= F.col("end"))), lambda c: c["nth"]))
    begin = F.struct(F.col("start").cast("long").alias("at"), F.col("start").cast("long").alias("reach"), F.lit(None).cast("long").alias("best"), F.array().cast("array<bigint>").alias("taken"))

    def taken(s: Column) -> Column:
        """The best chunk so far is taken."""
        return F.struct(s["reach"].alias("at"), s["reach"].alias("reach"), s["best"].alias("best"), F.concat(s["taken"], F.array(s["best"])).alias("taken"))

    def step(s: Column, c: Column) -> Column:
        moved = F.when((c["a"] > s["at"]) & (s["reach"] > s["at"]), taken(s)).otherwise(s)
        farther = (c["a"] <= moved["at"]) & (c["z"] > moved["at"]) & ((c["z"] > moved["reach"]) | (c["z"] == moved["reach"]) & (c["nth"] < moved["best"]))
        return F.when(farther, F.struct(moved["at"].alias("at"), c["z"].alias("reach"), c["nth"].alias("best"), moved["taken"].alias("taken"))).otherwise(moved)

    last = F.aggregate("near", begin, step, lambda s: F.when((s["at"] < F.col("end")) & (s["reach"] > s["at"]), taken(s)).otherwise(s))
    rows = rows.withColumns({"_alone": alone, "_last": last})
    how = F.when(F.col("_alone").isNotNull(), "alone").when(F.col("_last.at") >= F.col("end"), "together").otherwise("none")
    found = F.when(F.col("_alone").isNotNull(), F.array("_alone")).when(F.col("_last.at") >= F.col("end"), F.col("_last.taken")).otherwise(F.array().cast("array<bigint>"))
    return rows.select(*span, "start", "end", how.alias("how"), found.alias("chunks"))
