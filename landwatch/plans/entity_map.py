"""Entities found in several connections, or cataloged within one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.functions.text import stable_id, table_key
from landwatch.operators.entities import MIN_CONFIDENCE, connection_digests, entity_occurrences, entity_of_table, merged_names
from landwatch.operators.model import build_prompts, run_model, with_fallbacks
from landwatch.session import materialize

# Columns of a table in one question.
COLUMNS_ASKED = 50


def entity_overlaps(
    landed: DataFrame,
    model_fn: Callable[[str], str] | None = None,
    active: DataFrame | None = None,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per entity occurrence: ``entity_name, connection_id, table_key, join_key_col,
    confidence, conflicts, analysis_mode``.

    With two or more connections an entity must occur in at least two of them and an
    occurrence must reach ``min_confidence``. With one connection every entity is cataloged.
    With none the result is empty. A model, told a table's columns, may rename the entity and
    choose another join key and confidence; names that it shows to be the same are merged.
    """
    if active is not None:
        landed = landed.join(active.select("connection_id").distinct(), "connection_id", "left_semi")
    if model_fn is None:
        found = entity_occurrences(landed)
        # Where each entity occurs comes from two columns of the input rather than from the
        # occurrences, which cost two joins.
        places = landed.select("connection_id", "table_name")
    else:
        found = places = _with_model(landed, model_fn)
    # Digests are combined per name before the entities of the names are worked out.
    ends = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    by = "table_name" if model_fn is None else "entity"
    met = places.select(by, *connection_digests()).groupBy(by).agg(*ends("_conn_a"), *ends("_conn_b"))
    if model_fn is None:
        met = met.withColumn("entity", entity_of_table(F.col("table_name")))
    several = [F.min(f"{c}_min") != F.max(f"{c}_max") for c in ("_conn_a", "_conn_b")]
    spread = materialize(met.groupBy("entity").agg((several[0] | several[1]).alias("is_spread")), "entity-spread")
    single = landed.agg(F.min("connection_id") == F.max("connection_id")).scalar()
    catalog = F.coalesce(single, F.lit(True))
    return (
        found.join(spread, "entity")
        .withColumn("_catalog", catalog)
        .filter(F.col("_catalog") | (F.col("is_spread") & (F.col("confidence") >= min_confidence)))
        .select(
            F.initcap("entity").alias("entity_name"),
            "connection_id",
            "table_key",
            "join_key_col",
            # Nothing is shared across connections when there is only one: the name decides.
            F.when(F.col("_catalog"), F.greatest("confidence", F.lit(min_confidence))).otherwise(F.col("confidence")).alias("confidence"),
            "conflicts",
            F.when(F.col("_catalog"), "single_connection").otherwise("cross_connection").alias("analysis_mode"),
        )
    )


def entity_questions(landed: DataFrame) -> DataFrame:
    """(connection_id, table_key, table_name, columns): a table's columns with their types, in
    pieces of ``COLUMNS_ASKED`` places, so that a question stays short however wide the table is."""
    piece = F.floor((F.col("ordinal_position") - 1) / COLUMNS_ASKED).alias("piece")
    column = F.struct("ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"))
    return landed.groupBy("connection_id", table_key().alias("table_key"), "table_name", piece).agg(
        F.transform(F.array_sort(F.collect_set(column)), lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"))).alias("columns")
    )


def _with_model(landed: DataFrame, model_fn: Callable[[str], str]) -> DataFrame:
    """Entity occurrences under the names a model gives, names of one entity merged.

    A question holds a table's name and columns but not its connection, so equal tables are one
    question. Of the answers for the pieces of a table, and of a table name, the surest counts.
    Names belong to one entity if the rule and the model give them to one table name, or if the
    tables they are given to are joined by the same key, unless that key is merely an id.
    """
    asked = entity_questions(landed)
    prompts = build_prompts(asked, "entity", told=("table_name", "columns"))
    said = with_fallbacks(run_model(prompts.drop("columns"), model_fn), "entity")
    sure = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), F.lower(F.trim("entity_name")).alias("e"))
    answers = said.where(F.length(F.trim("entity_name")) > 0)
    per_table = materialize(
        answers.groupBy("connection_id", "table_key", "table_name").agg(
            F.max(sure)["e"].alias("name"), F.max_by("join_key", sure).alias("join_key"), F.max("confidence").alias("said_confidence")
        ), "entity-answers",
    )
    ruled = entity_of_table(F.col("table_name"))
    key = F.lower("join_key")
    named = per_table.select("name", "table_name", F.when(~key.isin("id", "uuid", "key"), key).alias("key"))
    links = named.select(F.col("name").alias("a"), ruled.alias("b")).union(
        named.where("key IS NOT NULL").groupBy("key").agg(F.min("name").alias("b")).join(named, "key").select(F.col("name").alias("a"), "b")
    )
    merged = merged_names(links, named.select(ruled.alias("name")))
    # Tables without an answer go by the rule's name, or by what the answers have merged it with.
    place = ["connection_id", "table_key"]
    tables = landed.select("connection_id", table_key().alias("table_key"), ruled.alias("_ruled")).distinct()
    called = tables.join(per_table.select(*place, "name"), place, "left").select(*place, F.coalesce("name", "_ruled").alias("name"))
    names = called.join(merged, "name", "left").select(*place, F.coalesce("entity", "name").alias("entity"))
    found = entity_occurrences(landed, materialize(names, "entity-names"))
    has = landed.select("connection_id", table_key().alias("table_key"), F.col("column_name").alias("join_key")).distinct()
    chosen = per_table.select("connection_id", "table_key", "join_key", "said_confidence")
    keyed = chosen.join(has.withColumn("_has", F.lit(True)), ["connection_id", "table_key", "join_key"], "left")
    return found.join(keyed, ["connection_id", "table_key"], "left").select(
        "entity", "connection_id", "table_key",
        F.when(F.col("_has"), F.col("join_key")).otherwise(F.col("join_key_col")).alias("join_key_col"),
        F.coalesce("said_confidence", "confidence").alias("confidence"), "conflicts",
    )


def entity_map_rows(overlaps: DataFrame, detected_at: str | datetime) -> DataFrame:
    """Rows for the entity map: one run id for all, built from the time of the run."""
    text = detected_at if isinstance(detected_at, str) else detected_at.isoformat(sep=" ")
    return overlaps.select(
        stable_id(F.lit("entity_map"), F.lit(text)).alias("detection_id"),
        "entity_name",
        "connection_id",
        F.col("table_key").alias("table_name"),
        "join_key_col",
        "confidence",
        "conflicts",
        F.lit(text).cast("timestamp").alias("detected_at"),
    )
