"""Readiness signals: drift stability and volatility, type suitability, naming, completeness."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.times import within_window
from landwatch.schemas import BREAKING_CHANGE_TYPES

# -- fixed values: semi-structured types, and what makes a name incoherent --------------
SEMI_STRUCTURED_TYPES = ("JSON", "STRUCT")
SHORT_NAME = 3
NUMERIC_SUFFIX = r"[\p{Nd}]+$"


#: Registers of a distinct-count sketch, as a power of two: 4096 give a relative error of about 1.7 %.
SKETCH_BITS = 12


def _breaking() -> Column:
    return F.count_if(F.col("change_type").isin(*BREAKING_CHANGE_TYPES))


def _percent(part: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.round(F.col(part) / F.col(total) * 100, 1)).otherwise(F.lit(0.0))


def drift_stability(
    ids: DataFrame, events: DataFrame, as_of: str | datetime, days: int = 30
) -> DataFrame:
    """Total and breaking changes per connection in the window, zeros when there are none.
    Every remediation status counts."""
    counts = (
        within_window(events, "detected_at", as_of, days)
        .groupBy("connection_id")
        .agg(F.count(F.lit(1)).alias("total_changes"), _breaking().alias("breaking_changes"))
    )
    return (
        ids.select("connection_id")
        .distinct()
        .join(counts, "connection_id", "left")
        .fillna(0, ["total_changes", "breaking_changes"])
    )


def drift_volatility(
    events: DataFrame, as_of: str | datetime, days: int = 30, ordered: bool = False
) -> DataFrame:
    """Changes, breaking changes and changes per week of each connection with any event."""
    out = (
        within_window(events, "detected_at", as_of, days)
        .groupBy("connection_id")
        .agg(F.count(F.lit(1)).alias("total_changes"), _breaking().alias("breaking_changes"))
        .withColumn("changes_per_week", F.round(F.col("total_changes") / F.lit(days / 7.0), 2))
    )
    return out.orderBy(F.desc("changes_per_week"), "connection_id") if ordered else out


def type_suitability(landed: DataFrame, prefix_match: bool = False) -> DataFrame:
    """Share of semi-structured columns per connection. The type must equal JSON or STRUCT in
    any case; ``prefix_match`` also counts parameterized forms such as ``STRUCT<a INT64>``."""
    kind = F.upper("data_type")
    semi = kind.isin(*SEMI_STRUCTURED_TYPES)
    if prefix_match:
        semi = reduce(lambda a, t: a | kind.startswith(f"{t}<"), SEMI_STRUCTURED_TYPES, semi)
    return (
        landed.groupBy("connection_id")
        .agg(
            F.count(F.lit(1)).alias("total_columns"),
            F.count_if(semi).alias("semi_structured_columns"),
        )
        .withColumn("semi_structured_pct", _percent("semi_structured_columns", "total_columns"))
    )


def _incoherent() -> Column:
    return (F.length("column_name") <= SHORT_NAME) | F.col("column_name").rlike(NUMERIC_SUFFIX)


def naming_coherence(landed: DataFrame) -> DataFrame:
    """Share of names that are very short or end in digits, per connection."""
    return (
        landed.groupBy("connection_id")
        .agg(F.count(F.lit(1)).alias("total_columns"), F.count_if(_incoherent()).alias("incoherent_names"))
        .withColumn("incoherent_pct", _percent("incoherent_names", "total_columns"))
    )


def schema_signals(landed: DataFrame, prefix_match: bool = False) -> DataFrame:
    """Type suitability and naming coherence in one pass over the landed columns."""
    kind = F.upper("data_type")
    semi = kind.isin(*SEMI_STRUCTURED_TYPES)
    if prefix_match:
        semi = reduce(lambda a, t: a | kind.startswith(f"{t}<"), SEMI_STRUCTURED_TYPES, semi)
    return (
        landed.groupBy("connection_id")
        .agg(
            F.count(F.lit(1)).alias("total_columns"),
            F.count_if(semi).alias("semi_structured_columns"),
            F.count_if(_incoherent()).alias("incoherent_names"),
        )
        .withColumns(
            {
                "semi_structured_pct": _percent("semi_structured_columns", "total_columns"),
                "incoherent_pct": _percent("incoherent_names", "total_columns"),
            }
        )
    )


def column_profiles(df: DataFrame) -> DataFrame:
    """``(column_name, total_rows, null_count, blank_count, distinct_sketch)`` of every column, in one pass.

    The sketch can be merged with those of other days or partitions (``merge_profiles``), so a
    profile of the whole history does not need the history again. Maps and variants have none.
    """
    aggregates = [F.count(F.lit(1)).alias("total_rows")]
    for i, field in enumerate(df.schema.fields):
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        blank = F.trim(c) == "" if kind in ("string", "varchar", "char") else F.lit(False)
        aggregates += [F.count_if(c.isNull()).alias(f"n{i}"), F.count_if(blank).alias(f"b{i}")]
        if kind in ("map", "variant"):
            aggregates.append(F.lit(None).cast("binary").alias(f"s{i}"))
        else:
            plain = c if kind in ("string", "binary") else F.to_json(F.struct(c)) if kind in ("array", "struct") else c.cast("string")
            aggregates.append(F.hll_sketch_agg(plain, F.lit(SKETCH_BITS)).alias(f"s{i}"))
    per_column = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("null_count"), F.col(f"b{i}").alias("blank_count"), F.col(f"s{i}").alias("distinct_sketch"))
        for i, f in enumerate(df.schema.fields)
    ])
    return df.agg(*aggregates).select("total_rows", F.explode(per_column).alias("c")).select("c.column_name", "total_rows", "c.null_count", "c.blank_count", "c.distinct_sketch")


def merge_profiles(profiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One profile per column (and key) from any number of them. Which rows went into which does
    not matter, as long as each went into one; merging merged profiles is the same again."""
    counts = [F.sum(c).alias(c) for c in ("total_rows", "null_count", "blank_count")]
    sketch = F.when(F.count("distinct_sketch") > 0, F.hll_union_agg("distinct_sketch")).alias("distinct_sketch")
    return profiles.groupBy(*keys, "column_name").agg(*counts, sketch)


def completeness_of(profiles: DataFrame) -> DataFrame:
    """The columns of ``column_completeness`` from stored profiles."""
    total, missing = F.col("total_rows"), F.col("null_count") + F.col("blank_count")
    rest = [c for c in profiles.columns if c != "distinct_sketch"]
    return (
        profiles.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("approx_distinct"))
        .withColumn("missing_pct", F.when(total > 0, F.round(missing / total * 100, 2)).otherwise(F.lit(0.0)))
        .withColumn("is_empty", (total > 0) & (F.col("null_count") == total))
    )


def column_completeness(df: DataFrame) -> DataFrame:
    """NULL and blank share and approximate distinct count of every column, in one pass.

    A column that is entirely NULL usually was dropped at the source but kept in the landed
    schema, which a schema diff cannot see; ``is_empty`` marks it.
    """
    aggregates = [F.count(F.lit(1)).alias("total_rows")]
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        blank = F.trim(c) == "" if field.dataType.typeName() in ("string", "varchar", "char") else F.lit(False)
        aggregates += [F.count_if(c.isNull()).alias(f"n{i}"), F.count_if(blank).alias(f"b{i}")]
        if field.dataType.typeName() in ("map", "variant"):
            aggregates.append(F.lit(None).cast("bigint").alias(f"d{i}"))
        else:
            aggregates.append(F.approx_count_distinct(c).alias(f"d{i}"))
    one = df.agg(*aggregates)
    per_column = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.col(f"n{i}").alias("null_count"),
                F.col(f"b{i}").alias("blank_count"),
                F.col(f"d{i}").alias("approx_distinct"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    total, missing = F.col("total_rows"), F.col("null_count") + F.col("blank_count")
    return (
        one.select("total_rows", F.explode(per_column).alias("c"))
        .select("c.column_name", "total_rows", "c.null_count", "c.blank_count", "c.approx_distinct")
        .withColumn("missing_pct", F.when(total > 0, F.round(missing / total * 100, 2)).otherwise(F.lit(0.0)))
        .withColumn("is_empty", (total > 0) & (F.col("null_count") == total))
    )
