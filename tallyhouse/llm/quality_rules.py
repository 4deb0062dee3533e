"""Quality rules with DataFrame functions alone: rules within a text, and cross-document line frequency.

A line that stands in many different documents of one host (menus, notices, footers) is counted by
the hash of its normalised form and removed; a document that keeps too little is rejected. Copies
and near copies count as one document, as a copied page doesn't make its own lines boilerplate: near
copies are told by sketches, the least hashes of a text's windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import small, staged, table

#: White space that parts words.
SPACE = " \\t\\n\\x0B\\f\\r"
SYMBOLS = "#*$%&|<>"
#: Words of the window that is looked for a second time in a text.
WINDOW = 8
#: Tasks that the rows of one hot line are dealt to.
SALTS = 16
#: Window hashes in a sketch, and the share of them that a near copy must have in common with other documents of its host.
SKETCH, COPY_SHARE = 32, 2 / 3
#: Shared window hashes that are sent to every executor at most.
SHARED_ROWS = 200_000


@dataclass(frozen=True)
class Rules:
    """Fewest words; largest share of words in repeated windows; different documents of a host above which a line is
    removed, however large the host; max_line_share, which is accepted but no longer read; and the share of its words
    that a document must keep."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_line_docs: int = 20
    max_line_share: float = 0.10
    min_kept_share: float = 0.25


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _windows(words: Column) -> Column:
    """n: words in windows that stand twice or more in the text: windows are hashed, sorted with their places, and the
    places of equal neighbours are joined to runs. sketch: the SKETCH least hashes."""
    width = F.lit(WINDOW)
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))

    def runs(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def equal(s: Column) -> Column:
            n = F.size(s)
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            hit = F.filter(F.transform(s, lambda x, j: F.when((j > 0) & same(j, j - 1) | (j < n - 1) & same(j, j + 1), x["i"])), lambda i: i.isNotNull())
            return _let(F.array_sort(hit), lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(width, F.coalesce(F.get(p, j + 1) - i, width))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed, equal))

    both = lambda h: F.struct(runs(h).cast("long").alias("n"), F.slice(F.sort_array(F.array_distinct(h)), 1, SKETCH).alias("sketch"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("sketch"))
    return F.when(F.size(words) <= width, none).otherwise(_let(hashes, both))


def _without(text: Column, signs: list[str]) -> Column:
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def normalised(line: Column) -> Column:
    """A line by which copies of it are known: lower case, runs of white space one space, digits alike."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(line), f"[{SPACE}]+", " ")), "[0-9]+", "0")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key, the base measures, lines: hash and number of words of each line with a word, and sketch."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(_without(x, [" ", "\t", "\x0b", "\f", "\r"])) > 0)
    counted = lambda x: F.size(words_of(x))
    size = F.length("text")
    base = F.struct(
        _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _windows(w).alias("windows"))).alias("w"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.transform(x, lambda y: F.struct(F.xxhash64(normalised(y)).alias("line"), counted(y).alias("words"))).alias("lines"))).alias("l"),
    )
    rows = rows.select(
        "doc_id", "host", F.xxhash64("text").alias("text_key"),
        F.length(_without(F.col("text"), [" ", "\t", "\n", "\x0b", "\f", "\r"])).cast("long").alias("word_chars"),
        (size - F.length(_without(F.col("text"), list(SYMBOLS)))).cast("long").alias("n_symbols"),
        F.explode(F.array(base)).alias("b"),
    )
    return rows.select("doc_id", "host", "text_key", "b.w.n_words", "word_chars", "n_symbols", "b.l.n_dup_lines", F.col("b.w.windows.n").alias("n_repeat_words"), "b.l.lines", "b.w.windows.sketch")


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Equal keys, of which host may be null."""
    on = a["host"].eqNullSafe(b["host"])
    for k in keys:
        on = on & (a[k] == b[k])
    return on


def _copies(texts: DataFrame) -> DataFrame:
    """host, text_key, group of the near copies among host, text_key, sketch.

    A near copy shares most of its sketch. Its group is the least of its hashes that are shared as widely as the median
    one or more: neither the hashes of its own edits nor, mostly, those of a common line. The copies of one document
    that lack that hash have the next one, so that their groups grow with the logarithm of their number only.
    """
    hashes = texts.select("host", "text_key", F.size("sketch").alias("of"), F.explode("sketch").alias("h"))
    shared = small(staged(hashes.groupBy("host", "h").agg(F.count("*").alias("df")).where("df > 1"), "shared-windows"), SHARED_ROWS)
    met = hashes.join(shared, _same(hashes, shared, "h")).select(hashes.host, "text_key", "of", F.struct("df", hashes.h).alias("x"))
    met = met.groupBy("host", "text_key").agg(F.first("of").alias("of"), F.sort_array(F.collect_list("x")).alias("x"))
    met = met.where(F.size("x") > F.lit(COPY_SHARE) * F.col("of"))
    least = F.element_at("x", F.floor(F.size("x") / 2).cast("int") + 1)["df"]
    return met.select("host", "text_key", F.array_min(F.transform(F.filter("x", lambda x: x["df"] >= least), lambda x: x["h"])).alias("group"))


def frequent_lines(rows: DataFrame, rules: Rules) -> DataFrame:
    """host, line: lines in more different documents of a host than the limit allows, at any size of the host."""
    lines = rows.select("host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).withColumn("at", F.xxhash64("host", "line"))
    # A line of few rows is in few documents: most lines go after one count, and only the others are shuffled with their texts.
    many = small(staged(lines.groupBy("at").agg(F.count("*").alias("rows")).where(F.col("rows") > rules.max_line_docs).select("at"), "many"))
    # A document counts once for a line; counting it in two steps keeps a hot line from meeting in one task.
    once = lines.join(many, "at", "left_semi").groupBy("host", "line", "text_key").agg(F.lit(1).alias("one")).drop("one")
    once = staged(once, "many-lines")
    often = small(staged(once.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > rules.max_line_docs), "often"))
    held = staged(once.join(often, _same(once, often, "line"), "left_semi"), "held")
    # Only texts with such a line may be copies that count too much.
    texts = held.select("host", "text_key").distinct()
    texts = staged(rows.join(texts, _same(rows, texts, "text_key"), "left_semi").groupBy("host", "text_key").agg(F.first("sketch").alias("sketch")), "sketches")
    copies = _copies(texts)
    told = held.join(copies, _same(held, copies, "text_key"), "left").select(held.host, held.line, F.coalesce("group", held.text_key).alias("document"))
    told = told.groupBy("host", "line", "document").agg(F.lit(1).alias("one"))
    return told.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > rules.max_line_docs).select("host", "line")


def _judged_rows(docs: DataFrame, rules: Rules) -> DataFrame:
    rows = staged(measured(docs).withColumn("row", F.monotonically_increasing_id()), "measures")
    frequent = staged(frequent_lines(rows, rules), "frequent-lines")
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    # A frequent line may stand in a third of all documents, so its rows are dealt over SALTS tasks.
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    salted = frequent.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    same = lines.host.eqNullSafe(salted.host) & (lines.line == salted.line) & (lines.salt == salted.salt)
    removed = lines.join(salted, same, "left_semi").groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    rows = rows.drop("lines", "sketch").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < F.lit(rules.min_kept_share) * F.col("n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each document with its measures, removed_words, base_failed and kept.

    A null text is empty and fails, as do texts of fewer than min_words words; a null source is a
    host of its own; repeated rows are judged repeatedly and alike; null ids stay null; an empty
    table gives an empty result; columns besides doc_id, text and source are not read.
    """
    return _judged_rows(docs, rules).drop("row", "removed_lines")


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with all their columns; frequent lines are gone from their texts, and n_chars follows.

    Documents are judged as by judged(): a null text is empty and goes; rows with equal id, source and
    text are treated alike, and repeated rows stay repeatedly. An empty table stays empty, and columns
    of any other name are carried along.
    """
    acted = _judged_rows(docs, rules).where("NOT kept OR removed_lines IS NOT NULL")
    # Texts aren't shuffled while the documents that lose lines or go are few.
    acted = small(staged(acted.groupBy("doc_id", "host", "text_key").agg(F.min("kept").alias("kept"), F.first("removed_lines").alias("lines")), "acted"))
    # The document is one column, so that none of its own can clash.
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    same = F.col("row.doc_id").cast("long").eqNullSafe(acted.doc_id) & F.col("row.source").cast("string").eqNullSafe(acted.host) & (F.xxhash64(F.coalesce(text, F.lit(""))) == acted.text_key)
    rows = rows.join(acted.withColumn("acted", F.lit(True)), same, "left").where(F.col("acted").isNull() | F.col("kept"))
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("lines", F.xxhash64(normalised(x)))), "\n")
    row = F.col("row").withField("text", rest)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(rest).cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.col("lines").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
