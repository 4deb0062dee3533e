"""Grades from model outputs, for a table of cases at once; whatever is wrong with an output closes its case as not sufficient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("supported", "missing")
DRAFT = "components array<struct<component_id:string,status:string,anchors:array<string>>>"


def graded(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (case_id, component_id, status, supporting_ids, rejected_ids) and grades (case_id, sufficient, missing, error) of cases.

    cases: case_id, required (component ids), supplied (chunk ids that the model saw), provider_error,
    output (its JSON text). The first error that a case has closes it, with every required component
    missing: provider_failure (an error, or no output), schema_failure (no JSON of the draft's form, or a
    status that isn't known), component_failure (a required component is not told exactly once, or
    another one is told). Otherwise a component is supported if the model says so and one of its anchors
    was supplied; anchors that weren't are rejected, repeats count once. A case is sufficient if no
    required component is missing, so a case without required components is never sufficient.
    """
    none = F.array().cast("array<string>")
    rows = cases.select("case_id", F.array_distinct(F.coalesce("required", none)).alias("required"), F.coalesce("supplied", none).alias("supplied"), "provider_error", "output")
    rows = rows.withColumn("draft", F.from_json("output", DRAFT)["components"])
    ids = F.transform("draft", lambda c: c["component_id"])
    valid = F.try_parse_json("output").isNotNull() & F.col("draft").isNotNull() & F.forall("draft", lambda c: c.isNotNull() & c["component_id"].isNotNull() & F.coalesce(c["status"].isin(*STATUSES), F.lit(False)))
    complete = (F.size(ids) == F.size("required")) & (F.size(F.array_intersect(ids, "required")) == F.size("required"))
    error = (
        F.when(F.col("provider_error").isNotNull() | F.col("output").isNull(), "provider_failure").when(~F.coalesce(valid, F.lit(False)), "schema_failure").when(~F.coalesce(complete, F.lit(False)), "component_failure")
    )
    rows = rows.withColumn("error", error)

    def stands(component):
        told = F.get(F.filter("draft", lambda c: c["component_id"] == component), 0)
        anchors = F.array_distinct(F.coalesce(told["anchors"], none))
        good = F.filter(anchors, lambda a: F.array_contains("supplied", a))
        supported = F.col("error").isNull() & (told["status"] == "supported") & (F.size(good) > 0)
        return F.struct(
            component.alias("component_id"), F.when(F.coalesce(supported, F.lit(False)), "supported").otherwise("missing").alias("status"), F.when(F.coalesce(supported, F.lit(False)), good).otherwise(none).alias("supporting_ids"),
            F.when(F.col("error").isNull(), F.filter(anchors, lambda a: ~F.array_contains("supplied", a))).otherwise(none).alias("rejected_ids"),
        )

    rows = rows.withColumn("x", F.transform("required", stands))
    missing = F.size(F.filter("x", lambda c: c["status"] == "missing"))
    grades = rows.select("case_id", ((missing == 0) & (F.size("required") > 0)).alias("sufficient"), missing.alias("missing"), "error")
    return rows.select("case_id", F.explode("x").alias("c")).select("case_id", "c.*"), grades
