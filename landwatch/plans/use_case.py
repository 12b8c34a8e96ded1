"""Coverage of a use case by the landed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.operators.coverage import coverage_pct, fuzzy_field_match
from landwatch.operators.model import (
    REPLY_SCHEMAS,  # noqa: F401  (documents the reply shapes)
    build_prompts,
    merge_model_rows,
    run_model,
    with_fallbacks,
)


def required_fields(spark: SparkSession, use_case: str, model_fn: Callable[[str], str]) -> DataFrame:
    """Required ``(entity, field)`` rows a model names for a use case; none if unreadable."""
    asked = build_prompts(spark.createDataFrame([(use_case,)], "use_case string"), "requirements", ())
    items = with_fallbacks(run_model(asked, model_fn), "requirements").select(F.explode("items").alias("i"))
    return items.select(
        F.coalesce("i.entity", F.lit("")).alias("entity"), F.explode("i.required_fields").alias("field")
    )


def use_case_coverage(
    required: DataFrame,
    landed: DataFrame,
    model_fn: Callable[[str], str] | None = None,
    active: DataFrame | None = None,
) -> DataFrame:
    """Every required field with the column that covers it, or NULLs.

    With a model each missing field also gets a suggested source type and why; otherwise
    both are empty. ``active`` limits the columns to connections that have synced.
    """
    if active is not None:
        landed = landed.join(active.select("connection_id").distinct(), "connection_id", "left_semi")
    matches = fuzzy_field_match(required, landed)
    if model_fn is None:
        return matches.withColumns({"suggested_connector_type": F.lit(""), "why": F.lit("")})
    missing = matches.filter(~F.col("is_covered")).select("entity", "field")
    said = with_fallbacks(run_model(build_prompts(missing, "missing", ()), model_fn), "missing")
    return merge_model_rows(
        matches, said, ["entity", "field"], {"suggested_connector_type": "", "why": ""}
    )


def coverage_summary(matches: DataFrame) -> DataFrame:
    """One row: counts, share covered, and a sentence."""
    nothing = "No required fields are known for this use case, so nothing was compared."
    return coverage_pct(matches).withColumn(
        "narrative",
        F.when(F.col("total_fields") == 0, nothing).otherwise(
            F.format_string("%d of %d required fields are available.", "covered_fields", "total_fields")
        ),
    )
