"""Loading a cleaned log: typed columns from text, keys, lineage, reconciliation and guards.

Checks are tables of booleans from aggregates, so any number of rows is checked in a few passes;
`required` stops a load when one is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallyhouse.operators.cleaning import collisions, digest, lineage

KEPT, EXACT, SHADOW = "kept", "excluded_exact_duplicate", "excluded_alias_shadow"


def parsed_boolean(text: Column) -> Column:
    """true for the word in any letter case with white space around it, false for anything else that is there."""
    return F.lower(F.trim(text)) == "true"


def typed(staged: DataFrame, kinds: T.StructType) -> DataFrame:
    """Text columns as the types that they are loaded into; empty text is null, and text of another type stops the load."""

    def read(f: T.StructField) -> Column:
        said = F.nullif(F.trim(f.name), F.lit(""))
        if isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        made = parsed_boolean(said) if isinstance(f.dataType, T.BooleanType) else said.try_cast(f.dataType)
        wrong = F.raise_error(F.concat(F.lit(f"{f.name}: "), said)).cast(f.dataType)
        return F.when(said.isNotNull() & made.isNull(), wrong).otherwise(made).alias(f.name)

    return staged.select(*[read(f) for f in kinds])


def cast_failures(staged: DataFrame, kinds: T.StructType) -> DataFrame:
    """column, failures: texts of each column that aren't of its type, without stopping."""
    count = lambda f: F.count_if(F.nullif(F.trim(f.name), F.lit("")).isNotNull() & F.trim(f.name).try_cast(f.dataType).isNull())
    found = [f for f in kinds if not isinstance(f.dataType, (T.StringType, T.BooleanType))]
    counted = staged.agg(*[count(f).alias(f.name) for f in found])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("failures")) for f in found])).alias("x")).select("x.*")


def dimension(rows: DataFrame, name: str, key: str) -> DataFrame:
    """key, name: each distinct name with a key that any load gives it, so that no load has to number all names in one task."""
    return rows.where(F.col(name).isNotNull()).select(name).distinct().select(digest(rows, name).alias(key), name)


def with_key(rows: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """Rows with the key of their name; a name that the dimension lacks stops the load."""
    joined = rows.join(names.select(name, key), name, "left")
    return joined.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit("no key: "), F.coalesce(name, F.lit("null")))).cast("string")).otherwise(F.col(key)))


def processed(raw: DataFrame, raw_key: list[str], set_key: list[str], carried: list[str], row: str = "source_row") -> DataFrame:
    """A row for each set from lineage rows: its id, counts, and the representative's columns."""
    rows = lineage(raw, raw_key, set_key, row)
    count = lambda s: F.count_if(F.col("row_status") == s)
    first = F.min_by(F.struct(*carried), F.col(row))
    out = rows.groupBy("representative_row").agg(first.alias("_c"), F.count("*").alias("raw_rows"), count(EXACT).alias("exact_duplicates"), count(SHADOW).alias("alias_shadows"))
    return out.select(F.format_string("set_%06d", F.col("representative_row").cast("long")).alias("set_id"), "_c.*", "raw_rows", "exact_duplicates", "alias_shadows")


def lineage_mismatches(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """set_id, raw_rows, found: sets whose number of lineage rows isn't the one they were stored with."""
    found = rows.groupBy("set_id").agg(F.count("*").alias("found"))
    return sets.join(found, "set_id", "left").select("set_id", "raw_rows", F.coalesce("found", F.lit(0)).alias("found")).where("raw_rows <> found")


def flags_on_rows(rows: DataFrame, sets: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Raw rows with their set's flags; false where a row has no set."""
    joined = rows.join(sets.select(key, *flags), key, "left")
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def conflicts(children: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Children that disagree with their parent in one of some columns, nulls compared as values: key, child id, column."""
    p = parents.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = children.join(p, children[key] == p["_key"])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return met.withColumn("column", F.explode(differs)).drop("_key", *[f"_{c}" for c in columns])


def _table(one_row: DataFrame) -> DataFrame:
    """check, ok from a row of booleans; a null is a check that failed."""
    pairs = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("ok")) for c in one_row.columns])
    return one_row.select(F.explode(pairs).alias("x")).select("x.*")


def reconciled(raw: DataFrame, sets: DataFrame, rows: DataFrame, aliases: DataFrame, raw_key: list[str], version: str, source_hash: str) -> DataFrame:
    """check, ok: how raw rows, the sets made of them, and their lineage agree.

    raw has source_row and started_at; sets set_id, session_id, raw_rows, exact_duplicates,
    alias_shadows, in_volume, in_e1rm, has_collision, collision_id, version, source_hash; rows (the
    lineage) source_row, set_id, row_status, raw_name, canonical_name, in_volume, in_e1rm (of kept
    rows), version, source_hash; aliases raw_name, canonical_name, decision.
    """
    is_ = lambda s: F.col("row_status") == s
    one = lambda c, value: (F.count_distinct(c) == 1) & (F.min(c) == value) & (F.count(c) == F.count("*"))
    of_raw = raw.agg(F.count("*").alias("raw_n"), F.count_distinct("started_at").alias("raw_sessions"))
    distinct_raw = raw.select(*raw_key).distinct().agg(F.count("*").alias("raw_distinct"))
    of_sets = sets.agg(
        F.count("*").alias("set_n"), F.count_distinct("set_id").alias("set_ids"), F.sum("raw_rows").alias("set_raw"), F.sum("exact_duplicates").alias("set_exact"),
        F.sum("alias_shadows").alias("set_shadow"), F.bool_and(F.col("raw_rows") == 1 + F.col("exact_duplicates") + F.col("alias_shadows")).alias("each_set"),
        F.count_distinct("session_id").alias("set_sessions"), F.count_if("in_e1rm").alias("set_e1rm"), F.count_if("in_volume").alias("set_volume"),
        F.bool_and(~F.col("has_collision") | (F.coalesce("collision_id", F.lit("")) != "")).alias("collisions"), one("version", version).alias("set_version"), one("source_hash", source_hash).alias("set_hash"),
    )
    of_rows = rows.agg(
        F.count("*").alias("row_n"), F.count_distinct("source_row").alias("row_ids"), F.count_if(is_(KEPT)).alias("kept"), F.count_distinct("set_id").alias("row_sets"), F.count_if(is_(EXACT)).alias("row_exact"),
        F.count_if(is_(SHADOW)).alias("row_shadow"), F.count_if(is_(KEPT) & F.col("in_e1rm")).alias("row_e1rm"), F.count_if(is_(KEPT) & F.col("in_volume")).alias("row_volume"),
        one("version", version).alias("row_version"), one("source_hash", source_hash).alias("row_hash"),
    )
    apart = sets.select("set_id").distinct().withColumn("a", F.lit(True)).join(rows.select("set_id").distinct().withColumn("b", F.lit(True)), "set_id", "full_outer").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("apart"))
    told = aliases.select(F.lower(F.trim("raw_name")).alias("_key"), F.trim("raw_name").alias("_own"), F.col("canonical_name").alias("_to"), F.lower(F.trim("decision")).alias("_decision"))
    named = rows.join(told, F.lower(F.trim("raw_name")) == told["_key"]).agg(
        F.count_if((F.col("_decision") == "merge") & ~F.col("canonical_name").eqNullSafe(F.col("_to"))).alias("unmerged"),
        F.count_if((F.col("_decision") == "defer") & ~F.col("canonical_name").eqNullSafe(F.trim(rows["raw_name"]))).alias("merged_too_soon"),
    )
    # One row each.
    all_ = of_raw.crossJoin(distinct_raw).crossJoin(of_sets).crossJoin(of_rows).crossJoin(apart).crossJoin(named)
    c = F.col
    checks = {
        "raw_rows_equal_lineage_rows": c("raw_n") == c("row_n"),
        "source_row_is_unique": c("row_ids") == c("row_n"),
        "processed_set_id_is_unique": c("set_ids") == c("set_n"),
        "kept_rows_equal_processed_rows": c("kept") == c("set_n"),
        "logical_ids_reconcile": c("row_sets") == c("set_n"),
        "every_processed_id_has_lineage": c("apart") == 0,
        "raw_row_counts_reconcile": c("set_raw") == c("raw_n"),
        "collapsed_count_equation": c("set_n") + c("row_exact") + c("row_shadow") == c("raw_n"),
        "per_set_count_equation": c("each_set"),
        "exact_duplicates_match_raw": c("row_exact") == c("raw_n") - c("raw_distinct"),
        "exact_duplicate_aggregates_reconcile": c("set_exact") == c("row_exact"),
        "alias_shadow_aggregates_reconcile": c("set_shadow") == c("row_shadow"),
        "source_hash_is_constant": c("set_hash") & c("row_hash"),
        "preprocessing_version_is_constant": c("set_version") & c("row_version"),
        "session_count_preserved": c("set_sessions") == c("raw_sessions"),
        "metric_flags_reconcile": (c("set_e1rm") == c("row_e1rm")) & (c("set_volume") == c("row_volume")),
        "merge_rules_applied": c("unmerged") == 0,
        "deferred_rules_not_merged": c("merged_too_soon") == 0,
        "collision_ids_present_when_flagged": c("collisions"),
    }
    return _table(all_.select(*[v.alias(k) for k, v in checks.items()]))


def loaded(counts: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """check, expected, found, ok: rows of each loaded table against what was to be loaded; what isn't there has none."""
    rows = None
    for name, wanted in expected.items():
        one = (counts[name].agg(F.count("*").alias("found")) if name in counts else None)
        if one is None:
            raise ValueError(f"nothing was loaded as {name}")
        one = one.select(F.lit(name).alias("check"), F.lit(wanted).cast("long").alias("expected"), "found", (F.col("found") == wanted).alias("ok"))
        rows = one if rows is None else rows.union(one)
    return rows


def required(checks: DataFrame) -> None:
    """Stop, naming every check that failed."""
    failed = sorted(r["check"] for r in checks.where(~F.col("ok")).select("check").collect())  # a row for each check
    if failed:
        raise ValueError("failed: " + ", ".join(failed))


def registered(registry: DataFrame, run: dict[str, object], key: str) -> str:
    """new or same: whether a run is to be written to the registry; a known key with other values is an error that names them."""
    known = registry.where(F.col(key) == run[key]).take(2)
    if len(known) > 1:
        raise ValueError(f"{run[key]} is registered twice")
    if not known:
        return "new"
    differs = sorted(k for k, v in run.items() if known[0].asDict().get(k) != v)
    if differs:
        raise ValueError(f"{run[key]} is registered with other values of " + ", ".join(differs))
    return "same"


def broken_ranks(rows: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """Groups whose ranks aren't 1, 2, ... without a gap or a repeat."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(rank).alias("low"), F.max(rank).alias("high"), F.count_distinct(rank).alias("ranks"))
    return found.where((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") != F.col("n")))


def exactly_one(rows: DataFrame, told: str):
    """The one row that a lookup has to find."""
    found = rows.take(2)
    if len(found) != 1:
        raise ValueError(f"{told}: {'none' if not found else 'several'}")
    return found[0]


def with_details(hits: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Hits with their details; a hit whose details are missing stops the query."""
    d = details.select(key, F.lit(True).alias("_there"), *columns)
    joined = hits.join(d, key, "left")
    missing = F.raise_error(F.concat(F.lit("no details: "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("_there").isNull(), missing).otherwise(True)).drop("_there")


def short_lists(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, found: queries whose ranked lists have fewer than k rows, none included."""
    counted = ranked.groupBy("query_id").agg(F.count("*").alias("found"))
    return queries.select("query_id").join(counted, "query_id", "left").select("query_id", F.coalesce("found", F.lit(0)).alias("found")).where(F.col("found") < k)


def untruncated(rows: DataFrame, limit: int) -> DataFrame:
    """Rows to compute on, unless there are as many as the limit that they were read with: then some may be missing."""
    if len(rows.limit(limit).select(F.lit(1)).take(limit)) >= limit:
        raise ValueError("truncated_records")
    return rows


def collision_flags(sets: DataFrame) -> DataFrame:
    return collisions(sets).select("set_id", "has_collision", F.coalesce("collision_id", F.lit("")).alias("collision_id"))


def ranked_once(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.Window.partitionBy(*by).orderBy(*order)))
