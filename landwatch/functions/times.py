"""Time rules. The anchor ``as_of`` is always given; nothing reads the wall clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_datetime(as_of: str | datetime) -> datetime:
    return datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def literal_like(df: DataFrame, column: str, value: str | datetime) -> Column:
    """``value`` as a literal of the column's own type, so comparisons need no cast on the
    column and reach the parquet scan."""
    text = as_datetime(value).isoformat(sep=" ")
    return F.lit(text).cast(df.schema[column].dataType)


def within_window(df: DataFrame, ts: str, as_of: str | datetime, days: int) -> DataFrame:
    """Rows whose ``ts`` is at most ``days`` before ``as_of`` (inclusive).

    Adds the same bound on the table's date partition when the frame has one.
    """
    start = as_datetime(as_of) - timedelta(days=days)
    out = df.filter(F.col(ts) >= literal_like(df, ts, start))
    date_column = f"{ts}_date"
    if date_column in df.columns:
        # One day of slack keeps the pruning right for any zone offset of an aware as_of.
        first_day = (start - timedelta(days=1)).date().isoformat()
        out = out.filter(F.col(date_column) >= F.lit(first_day).cast("date"))
    return out


def hours_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, in hours."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(3600.0)
