"""Constraints as counts of violations: keys, references, checks, and equality of two builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: how many rows break each check, from one pass; a null result breaks it."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent; null references have none to miss."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def same_build(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each of two builds has that the other lacks, repeats counted."""
    return a.exceptAll(b).agg(F.count("*").alias("only_first")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_second")))  # one row each


def require_none(rows: DataFrame, told: str) -> None:
    """Fail, naming what was told, if there is any row."""
    if rows.take(1):
        raise ValueError(told)
