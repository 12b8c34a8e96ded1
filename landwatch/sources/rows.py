"""Reading rows of landed tables and of the failure log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.functions.times import within_window


def json_sample(
    df: DataFrame, column: str, n: int = 5, order_by: str | list[str] | None = None
) -> DataFrame:
    """Up to ``n`` rows with a non-NULL value, as ``(row_no, value)``.

    With ``order_by`` the sample is repeatable: each task keeps its own best ``n`` rows and
    only those are merged. Without it, any ``n`` rows are taken.
    """
    present = df.filter(F.col(column).isNotNull())
    if order_by is None:
        picked = present.select(F.lit(0).alias("_k"), F.col(column).alias("value")).limit(n)
        return picked.select(F.monotonically_increasing_id().alias("row_no"), "value")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    order = F.struct(*keys)
    picked = present.select(order.alias("_k"), F.col(column).alias("value")).orderBy("_k").limit(n)
    # The limit leaves n rows, so numbering them in one partition is bounded.
    return picked.agg(F.sort_array(F.collect_list(F.struct("_k", "value"))).alias("s")).select(
        F.posexplode("s").alias("row_no", "r")
    ).select(F.col("row_no").cast("bigint").alias("row_no"), "r.value")


def failure_window_scan(
    failures: DataFrame, as_of: str | datetime, days: int = 7, ordered: bool = False
) -> DataFrame:
    """Sync failures of the last ``days`` days, newest first when ``ordered``."""
    out = within_window(failures, "failed_at", as_of, days)
    return out.orderBy(F.desc("failed_at"), F.desc("log_id")) if ordered else out


def time_window_filter(
    df: DataFrame, ts: str, as_of: str | datetime, days: int
) -> DataFrame:
    """Rows whose ``ts`` lies at most ``days`` before ``as_of``, inclusive."""
    return within_window(df, ts, as_of, days)
