"""Order statistics and order-dependent digests of whole tables, without one task that sorts a group or the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tallyhouse.sources.shared import written

#: Values at which a range is cut in one round; each is a range of its own.
CUTS = 32
#: Leaves of a node of the hash tree, and its levels: enough for 10^12 rows, as the table's size may not decide the form.
FAN, LEVELS = 1000, 4


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """ranks (by, and rank from 1, both of a group's rows that have a value) with the value at that rank, exactly.

    A round cuts each range that holds a rank at some of its own values and counts what lies between
    them; prefix sums tell which part holds the rank, and the next round reads that part alone. A cut
    is a part by itself, so a value that a third of all rows have ends the search at once. Counts are
    partial aggregates, a group's parts are at most 2 * CUTS + 1 rows, and rounds grow with the
    logarithm of the number of values. Ranks beyond a group have no row.
    """
    spark = rows.sparkSession
    key = [*by, "rank"]
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("value"))
    kind = values.schema["value"].dataType
    todo = written(ranks.select(*key, F.lit(0).cast("long").alias("before"), F.lit(None).cast(kind).alias("low"), F.lit(None).cast(kind).alias("high")), "ranks")
    found = []
    while True:
        null = [values[c].eqNullSafe(todo[c]) for c in by] or [F.lit(True)]
        inside = F.coalesce(values["value"] >= todo["low"], F.lit(True)) & F.coalesce(values["value"] <= todo["high"], F.lit(True))
        on = inside
        for c in null:
            on = on & c
        part = values.join(F.broadcast(todo) if todo.count() <= 100_000 else todo, on).select(*[todo[c] for c in key], "before", "value")
        cuts = part.groupBy(*key).agg(F.array_sort(F.array_distinct(F.percentile_approx("value", [(k + 0.5) / CUTS for k in range(CUTS)], 10 * CUTS))).alias("cuts"))
        cuts = written(cuts, "cuts")
        same = part[key[0]].eqNullSafe(cuts[key[0]])
        for c in key[1:]:
            same = same & part[c].eqNullSafe(cuts[c])
        placed = part.join(cuts, same).select(*[part[c] for c in key], "before", "value", (2 * F.size(F.filter("cuts", lambda x: x < F.col("value"))) + F.array_contains("cuts", F.col("value")).cast("int")).alias("nth"))
        counts = placed.groupBy(*key, "before", "nth").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.sum("n").over(W.Window.partitionBy(*key).orderBy("nth"))
        counts = counts.withColumn("upto", F.col("before") + upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        step = written(counts.select(*key, (F.col("upto") - F.col("n")).alias("before"), "low", "high"), "parts")
        found.append(step.where("low = high").select(*key, F.col("low").alias("value")))
        todo = step.where("low <> high")
        if not todo.take(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return spark.createDataFrame([], out.schema).union(out)


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group and name the value at place min(n - 1, floor(n * share)) from 0 of its sorted values; `median` as a name is the mean of the middle two.

    Null values are left out, and groups without any have no row.
    """
    sizes = rows.groupBy(*by).agg(F.count(value).alias("n")).where("n > 0")
    place = lambda share: (F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share))) + 1).cast("long")
    wanted = [F.struct(F.lit(name).alias("name"), place(share).alias("rank")) for name, share in shares.items()]
    wanted += [F.struct(F.lit("median").alias("name"), (F.floor((F.col("n") + k) / 2)).cast("long").alias("rank")) for k in (1, 2)]
    ranks = written(sizes.select(*by, F.explode(F.array(*wanted)).alias("x")).select(*by, "x.name", "x.rank"), "wanted")
    values = at_ranks(rows, by, value, ranks.select(*by, "rank").distinct())
    on = ranks["rank"] == values["rank"]
    for c in by:
        on = on & ranks[c].eqNullSafe(values[c])
    told = ranks.join(values, on).select(*[ranks[c] for c in by], "name", "value")
    pick = lambda name: F.avg(F.when(F.col("name") == name, F.col("value"))).alias(name)
    return told.groupBy(*by).agg(*[F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in shares], pick("median"))


def ordered_digest(rows: DataFrame, order: list[str], leaf: Column) -> DataFrame:
    """rows, digest: of a table in an order, by a hash tree whose form follows from the rows' places alone.

    A leaf is the SHA-256 of a row's text, a node that of its up to FAN children's hexadecimal digits one
    after another, and the top is always LEVELS levels up. Rows are sorted by ranges, a row's place is its
    place in its range and the counts of the ranges before, and a node's children meet in one group of
    FAN rows at most. The same table gives the same digest however it is partitioned; rows that change
    places change it. Rows of equal order are put by their leaves. An empty table's digest is that of
    no children.
    """
    leaves = rows.select(*order, F.sha2(F.coalesce(leaf, F.lit("")), 256).alias("leaf"))
    spread = leaves.repartitionByRange(*order, "leaf").sortWithinPartitions(*order, "leaf")
    # Written, so that places don't depend on the ranges being cut alike twice.
    spread = written(spread.select("leaf", F.monotonically_increasing_id().alias("id")), "leaves")
    split = spread.select("leaf", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("nth"))
    counts = split.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("part", F.coalesce(F.sum("n").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    level = split.join(F.broadcast(before), "part").select((F.col("before") + F.col("nth")).alias("place"), F.col("leaf").alias("digest"))
    for _ in range(LEVELS):
        node = F.floor(F.col("place") / FAN)
        level = level.groupBy(node.alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("x"))
        level = level.select(F.col("node").alias("place"), F.sha2(F.array_join(F.transform("x", lambda y: y["digest"]), ""), 256).alias("digest"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    none = F.sha2(F.lit(""), 256)
    return total.crossJoin(level.agg(F.max("digest").alias("digest"))).select("rows", F.coalesce("digest", none).alias("digest"))  # one row each
