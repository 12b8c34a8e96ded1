"""Use-case coverage: which required fields the landed columns can supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.functions.text import match_token, required_token, table_key


#: Length of the pieces that containment is looked up by.
GRAM = 4


def _containing(holders: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of a ``holder`` and a ``held`` text that is contained in it and not empty.

    A text of at least ``GRAM`` characters is looked up by its first ``GRAM`` ones among the
    pieces of that length of each holder, and the match is then verified; a shorter text equals a
    piece of its own length. So a holder of n characters becomes fewer than ``GRAM`` * n rows.
    """
    pieces = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("holder") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("holder"), i, n)
    )
    by_length = [pieces(n) for n in range(1, GRAM + 1)]
    cut = holders.select("*", F.explode(F.array_distinct(F.flatten(F.array(*by_length)))).alias("piece"))
    wanted = held.filter(F.length("held") > 0).withColumn("piece", F.substring("held", 1, GRAM))
    return cut.join(wanted, "piece").filter(F.contains("holder", "held")).drop("piece")


def fuzzy_field_match(required: DataFrame, landed: DataFrame) -> DataFrame:
    """First landed column matching each required ``(entity, field)``, NULL without one.

    Names match when one contains the other, case and underscores aside; an empty name matches
    all. "First" is by connection, schema, table and ordinal.

    Columns are first reduced to distinct names, each with its first position (combined on the
    map side). Containment is looked up by short pieces instead of comparing every pair, and only
    the first position per required name is moved on.
    """
    position = F.struct(
        "connection_id", "table_schema", "table_name", F.col("ordinal_position").cast("bigint").alias("ordinal_position"),
        "column_name", "data_type",
    )
    names = landed.groupBy(match_token(F.col("column_name")).alias("name")).agg(F.min(position).alias("at"))
    fields = required.select("entity", "field").distinct()
    tokens = fields.select(required_token(F.col("field")).alias("token")).distinct()

    of_names = _containing(names.withColumnRenamed("name", "holder"), tokens.withColumnRenamed("token", "held"))
    by_column = of_names.groupBy(F.col("held").alias("token")).agg(F.min("at").alias("at"))
    of_tokens = _containing(tokens.withColumnRenamed("token", "holder"), names.withColumnRenamed("name", "held"))
    by_field = of_tokens.groupBy(F.col("holder").alias("token")).agg(F.min("at").alias("at"))
    first = names.agg(F.min("at")).scalar()
    unnamed = names.filter(F.col("name") == "").agg(F.min("at")).scalar()

    return (
        fields.withColumn("token", required_token(F.col("field")))
        .join(by_column.withColumnRenamed("at", "at_column"), "token", "left")
        .join(by_field.withColumnRenamed("at", "at_field"), "token", "left")
        .withColumn("at", F.least("at_column", "at_field", F.when(F.col("token") == "", first), unnamed))
        .select(
            "entity",
            "field",
            F.col("at.connection_id").alias("connection_id"),
            F.when(F.col("at").isNotNull(), table_key("at.table_schema", "at.table_name")).alias("table_key"),
            F.col("at.column_name").alias("column_name"),
            F.col("at.data_type").alias("data_type"),
            F.col("at").isNotNull().alias("is_covered"),
        )
    )


def coverage_pct(matches: DataFrame) -> DataFrame:
    """Required and covered fields and the share covered, to one decimal; 0 without fields."""
    total, covered = F.col("total_fields"), F.col("covered_fields")
    return matches.agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if("is_covered").alias("covered_fields")
    ).withColumn(
        "coverage_pct", F.when(total > 0, F.round(covered / total * 100, 1)).otherwise(F.lit(0.0))
    )
