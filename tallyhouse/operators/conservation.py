"""Whether overlapping chunks hold their text's words, all of them, once and in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(text: str | Column) -> Column:
    """Hashes of the words between white space."""
    return F.transform(F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _reached(chunks: Column, source: Column, overlap: int) -> Column:
    """Places of the source that its words can be read up to, chunk by chunk.

    A chunk may begin with words that the chunk before ended with; how many isn't known, as the source
    may repeat itself, so every number that fits gives a place of its own. Places that the chunk's other
    words don't follow are dropped.
    """
    start = F.struct(F.array(F.lit(0)).alias("places"), F.array().cast("array<bigint>").alias("before"))

    def step(a: Column, words: Column) -> Column:
        size, had = F.size(words), F.size(a["before"])
        most = F.least(F.lit(overlap), had, size)
        repeated = F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(a["before"], had - n + 1, n) == F.slice(words, F.lit(1), n))

        def after(n: Column) -> Column:
            rest = F.slice(words, n + 1, size - n)
            return F.transform(F.filter(a["places"], lambda p: F.slice(source, p + 1, size - n) == rest), lambda p: p + size - n)

        return F.struct(F.array_distinct(F.flatten(F.transform(repeated, after))).alias("places"), words.alias("before"))

    return F.aggregate(chunks, start, step)["places"]


def conservation(sources: DataFrame, chunks: DataFrame, key: str, overlap: int, text: str = "text", order: str = "nth") -> DataFrame:
    """key, words, chunks, lost_words, status of each source text.

    `kept`: its chunks, each less what it repeats of the one before (up to `overlap` words), give the
    text's words in order. Else `lost` if a word stands in fewer places of the chunks than of the text
    (lost_words counts those places), `repeated` if leaving out chunks that equal an earlier one mends it,
    and `reordered` for anything else. A text's chunks are one array: they are as long as the text. A
    text without chunks has lost all its words; one without words is kept if it has no chunks with words.
    A null text has no words. Chunks of unknown keys aren't looked at.
    """
    ordered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(_words(text), F.array().cast("array<bigint>")).alias("w")))).alias("c"))
    rows = sources.select(key, F.coalesce(_words(text), F.array().cast("array<bigint>")).alias("source")).join(ordered.select(key, F.transform("c", lambda x: x["w"]).alias("chunks")), key, "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.array().cast("array<array<bigint>>")))
    once = F.filter(F.transform("chunks", lambda w, i: F.when(F.array_position("chunks", w) == i + 1, w)), lambda w: w.isNotNull())
    whole = lambda found: F.array_contains(_reached(found, F.col("source"), overlap), F.size("source"))
    rows = rows.withColumns({"kept": whole(F.col("chunks")), "mended": whole(once)})
    # Words are counted in rows, so that a long text costs what it has.
    counted = lambda c, sign: rows.where("NOT kept").select(key, F.explode(c).alias("w"), F.lit(sign).alias("n"))
    missing = counted("source", 1).union(counted(F.flatten("chunks"), -1)).groupBy(key, "w").agg(F.sum("n").alias("n")).where("n > 0").groupBy(key).agg(F.sum("n").alias("lost_words"))
    rows = rows.join(missing, key, "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    status = F.when(F.col("kept"), "kept").when(F.col("lost_words") > 0, "lost").when(F.col("mended"), "repeated").otherwise("reordered")
    return rows.select(key, F.size("source").alias("words"), F.size("chunks").alias("chunks"), "lost_words", status.alias("status"))
