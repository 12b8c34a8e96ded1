"""Diagnosis of sync failures."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.operators.failures import (
    connector_status_errors,
    failure_count,
    failure_top_errors,
    severity_from_count,
)
from landwatch.operators.model import build_prompts, run_model, with_fallbacks


_ERRORS = "array<struct<rank:int,error_code:string,count:bigint,sample_message:string>>"


def _error_list(errors: DataFrame, name: str) -> DataFrame:
    """A connection's errors, at most five, as one array."""
    item = F.struct("rank", "error_code", "count", "sample_message")
    return errors.groupBy("connection_id").agg(F.sort_array(F.collect_list(item)).alias(name))


def diagnose_failures(
    ids: DataFrame,
    failures: DataFrame,
    as_of: str | datetime,
    days: int = 7,
    connector_status: DataFrame | None = None,
    model_fn: Callable[[str], str] | None = None,
) -> DataFrame:
    """One row per connection: status, failure_count, top_errors, diagnosis, actions,
    severity, and whether they come from the failure ``log`` or the live ``status``.

    A connection without logged failures takes its errors from ``connector_status`` when
    given; without any error its status is ``no_failures`` and no model is asked.
    """
    wanted = ids.select("connection_id").distinct()
    facts = (
        wanted.join(_error_list(failure_top_errors(failures, as_of, days), "_log"), "connection_id", "left")
        .join(failure_count(failures, as_of, days), "connection_id", "left")
        .withColumn("_live", F.lit(None).cast(_ERRORS))
    )
    if connector_status is not None:
        errors_now = connector_status_errors(connector_status)
        live = _error_list(errors_now, "_live").join(
            errors_now.groupBy("connection_id").agg(F.max("total_errors").alias("_live_count")), "connection_id"
        )
        facts = facts.drop("_live").join(live, "connection_id", "left")
    else:
        facts = facts.withColumn("_live_count", F.lit(None).cast("bigint"))
    errors = F.coalesce("_log", "_live")
    source = F.when(F.col("_log").isNotNull(), "log").when(F.col("_live").isNotNull(), "status")
    facts = facts.withColumns(
        {
            "top_errors": errors,
            "source": source,
            "failure_count": F.coalesce("failure_count", "_live_count", F.lit(0)).cast("bigint"),
            "status": F.when(errors.isNull(), "no_failures").otherwise("failures"),
            "period_days": F.lit(days),
        }
    ).drop("_log", "_live", "_live_count")
    by_count = severity_from_count(F.col("failure_count"))
    failed = F.col("status") == "failures"
    if model_fn is not None:
        asked = build_prompts(facts, "diagnosis").withColumn("prompt", F.when(failed, F.col("prompt")))
        replies = with_fallbacks(run_model(asked, model_fn), "diagnosis").drop("prompt", "raw")
        return replies.withColumns(
            {
                "severity": F.when(failed, F.coalesce("severity", by_count)),
                "diagnosis": F.when(failed, F.col("diagnosis")),
            }
        )
    top = F.col("top_errors")[0]
    text = F.format_string(
        "%d failures; the most frequent error is %s (%d): %s",
        "failure_count", top["error_code"], top["count"], top["sample_message"],
    )
    actions = F.transform(F.col("top_errors"), lambda e: F.concat(F.lit("Resolve "), e["error_code"]))
    return facts.withColumns(
        {
            "diagnosis": F.when(failed, text),
            "recommended_actions": F.coalesce(actions, F.array().cast("array<string>")),
            "severity": F.when(failed, by_count),
        }
    )
