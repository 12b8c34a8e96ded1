"""Generating a flatten view for one column, with its audit row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.functions.text import stable_id
from landwatch.operators.jsonflat import flatten_view, infer_json_structure
from landwatch.operators.model import build_prompts, run_model


def generate_flattener(
    rows: DataFrame,
    connection_id: str,
    dataset: str,
    table_key: str,
    column: str,
    generated_at: str,
    mode: str = "full",
    order_by: str | list[str] | None = None,
    model_fn: Callable[[str], str] | None = None,
) -> DataFrame:
    """Audit row of a flatten view for one landed column, ready for ``write_flattener_log``,
    with ``estimated_columns`` added.

    The structure is that of all rows unless ``mode="sample"`` is asked for."""
    structure = infer_json_structure(rows, column, mode, order_by)
    base = flatten_view(dataset, table_key, column, structure).select(
        F.lit(connection_id).alias("connection_id"),
        F.lit(table_key).alias("table_name"),
        F.lit(column).alias("column_name"),
        "view_name",
        "view_sql",
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.lit(False).alias("deployed"),
        "estimated_columns",
    )
    if model_fn is not None:
        asked = base.withColumn("keys", F.regexp_extract("view_sql", r"SELECT \* EXCEPT\(.*?\), (.*) FROM ", 1))
        said = run_model(build_prompts(asked, "flatten"), model_fn)
        reply = F.nullif(F.trim("raw"), F.lit(""))
        base = said.withColumn("view_sql", F.coalesce(reply, F.col("view_sql"))).drop("keys", "prompt", "raw")
    log_id = stable_id(*[F.col(c) for c in ("connection_id", "table_name", "column_name", "view_sql", "generated_at")])
    return base.withColumn("log_id", log_id)
