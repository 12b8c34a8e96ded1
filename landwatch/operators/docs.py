"""Plain-language descriptions of landed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.text import name_tokens, table_key
from landwatch.operators.model import (
    build_prompts,
    merge_model_rows,
    run_model,
    with_fallbacks,
)


def default_description(name: Column, data_type: Column, table: Column) -> Column:
    """A sentence from the humanized name, its role, and the table."""
    words = F.array_join(name_tokens(name), " ")
    lowered, kind = F.lower(name), F.upper(data_type)
    lead = (
        F.when((lowered == "id") | lowered.endswith("_id"), "Identifier")
        .when(kind.isin("TIMESTAMP", "DATETIME", "DATE"), "Time")
        .when(kind.startswith("BOOL"), "Flag")
        .when(kind.isin("JSON", "STRUCT"), "Structured value")
        .when(kind.isin("INT64", "FLOAT64", "NUMERIC", "BIGNUMERIC"), "Number")
        .otherwise("Text")
    )
    return F.concat(lead, F.lit(": "), words, F.lit(" of "), F.array_join(name_tokens(table), " "), F.lit("."))


def schema_docs(landed: DataFrame, model_fn: Callable[[str], str] | None = None) -> DataFrame:
    """``(connection_id, table_key, ordinal_position, column_name, data_type, description)``.

    With a model there is one prompt per distinct column of a table name, asked once for all
    connections that have it, and a column it does not describe gets an empty text; without, the description comes from the name and type.
    """
    base = landed.select(
        "connection_id", table_key().alias("table_key"), "ordinal_position", "column_name", "data_type",
        default_description(F.col("column_name"), F.col("data_type"), F.col("table_name")).alias("_default"),
    )
    if model_fn is None:
        return base.withColumnRenamed("_default", "description")
    # The question holds the column's facts; beside it only the place of an answer is needed.
    asked = build_prompts(landed, "docs").select("connection_id", "table_key", "prompt")
    replies = with_fallbacks(run_model(asked, model_fn), "docs")
    said = replies.select("connection_id", "table_key", F.explode("items").alias("i")).select(
        "connection_id", "table_key", F.col("i.column_name").alias("column_name"),
        F.coalesce("i.description", F.lit("")).alias("description"),
    )
    return merge_model_rows(
        base.drop("_default"), said, ["connection_id", "table_key", "column_name"], {"description": ""}
    )
