"""Classification of candidate changes, and the compatibility shims they call for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landwatch.functions.text import name_similarity
from landwatch.functions.types import spark_type_of
from landwatch.operators.drift import (
    COLLATERAL_CONFIDENCE,
    attribute_collateral_reorder,
    REVIEW_THRESHOLD,
    digest,
    ordinal_delta,
)
from landwatch.operators.model import build_prompts, run_model, validate_classification
from landwatch.schemas import CHANGE_TYPES
from landwatch.session import materialize

# Downstream readers of a table that a question names.
CONSUMERS_TOLD = 20
# Rows of readers of a table up to which all of its names are gathered at once.
NAMES_GATHERED = 4096

_TABLE = ["connection_id", "table_schema", "table_name"]


def shim_sql(changes: DataFrame, dataset: str = "table_schema") -> DataFrame:
    """Add ``remediation_sql``: a view that keeps the old contract readable.

    A rename keeps the old name, a type change keeps the old type under ``<col>_legacy``, a
    dropped column stays as a typed NULL. New and moved columns need no shim.
    """
    return changes.withColumn("remediation_sql", shim_text(F.col(dataset)))


def shim_text(dataset: Column) -> Column:
    table = F.col("table_name")
    old, new = F.col("before.column_name"), F.col("after.column_name")
    old_type = F.col("before.data_type")

    def view(expression: Column) -> Column:
        return F.concat(
            F.lit("CREATE OR REPLACE VIEW "), dataset, F.lit("."), table,
            F.lit("_shim AS SELECT *, "), expression, F.lit(" FROM "), dataset, F.lit("."), table,
        )

    return (
        F.when(F.col("change_type") == "RENAME", view(F.concat(new, F.lit(" AS "), old)))
        .when(
            F.col("change_type") == "TYPE_PROMOTION",
            view(F.concat(F.lit("CAST("), new, F.lit(" AS "), old_type, F.lit(") AS "), new, F.lit("_legacy"))),
        )
        .when(
            F.col("change_type") == "DEPRECATION",
            view(F.concat(F.lit("CAST(NULL AS "), old_type, F.lit(") AS "), old)),
        )
        .otherwise(F.lit(""))
    )


def apply_shim(df: DataFrame, changes: Iterable[dict]) -> DataFrame:
    """Apply one table's shims to its rows as a projection (no shuffle).

    ``changes`` is the reviewed list for this table: ``change_type``, ``old_name``,
    ``new_name`` and ``old_type`` (a warehouse type). Bad values become NULL. A type with no
    Spark counterpart leaves its column untouched.
    """
    added: dict[str, Column] = {}
    for change in changes:
        kind, old, new = change["change_type"], change.get("old_name"), change.get("new_name")
        if kind not in CHANGE_TYPES:
            raise ValueError(f"unknown change type: {kind}")
        spark_type = spark_type_of(change.get("old_type") or "")
        if kind == "RENAME":
            added[old] = F.col(f"`{new}`")
        elif kind == "TYPE_PROMOTION" and spark_type:
            added[f"{new or old}_legacy"] = F.col(f"`{new or old}`").try_cast(spark_type)
        elif kind == "DEPRECATION" and spark_type:
            added[old] = F.lit(None).cast(spark_type)
    present = {c.lower() for c in df.columns}
    clash = sorted(name for name in added if name.lower() in present)
    if clash:
        raise ValueError(f"shim columns already exist: {clash}")
    return df.select("*", *[c.alias(n) for n, c in added.items()])


def create_shim_view(df: DataFrame, table_name: str, changes: Iterable[dict]) -> str:
    """Register the shimmed rows as the temporary view ``<table>_shim``; returns its name."""
    name = f"{table_name}_shim"
    apply_shim(df, changes).createOrReplaceTempView(name)
    return name


def classify_changes(
    changes: DataFrame,
    model_fn: Callable[[str], str] | None = None,
    keys: tuple[str, ...] = ("connection_id",),
    consumers: DataFrame | None = None,
) -> DataFrame:
    """Final change type, confidence, rationale and shim for every candidate.

    ``consumers`` tells what reads a table downstream: connection_id, table_schema, table_name,
    consumer. Each change then has ``downstream_consumers``, the first ``CONSUMERS_TOLD`` names in
    order, and ``n_consumers``, all of them; the rules' rationale counts them, and a model is told both.

    Without a model the rules decide: the candidate type stands; a rename's confidence is
    the similarity of the names; a collateral reorder gets a low one; others are certain.
    With ``model_fn`` each candidate becomes one prompt and its reply is validated; a row
    whose reply breaks the contract has ``is_valid`` false and ``error`` set, and the other
    rows are unaffected.
    """
    beside = attribute_collateral_reorder(changes, keys) if consumers is None else _with_consumers(changes, consumers, keys)
    described = ordinal_delta(beside)
    if model_fn is None:
        return classify_by_rules(described)
    prompts = build_prompts(described, "change", keys)
    replies = validate_classification(run_model(prompts, model_fn)).drop("prompt", "raw")
    # A rename the model is unsure of must not put one column's values under another's name.
    doubtful = (F.col("change_type") == "RENAME") & (F.col("classification_conf") < REVIEW_THRESHOLD)
    return replies.withColumn("remediation_sql", F.when(doubtful, F.lit("")).otherwise(F.col("remediation_sql")))


def _readers(consumers: DataFrame) -> DataFrame:
    """What reads each table: the first ``CONSUMERS_TOLD`` names and their number, under the table's digest.

    Names are gathered by table in one move. Of the few tables that more than ``NAMES_GATHERED``
    rows name, the first names are cut before they are moved, so none of them is a long group;
    these tables are counted by their digests and stored first. Both ways give the same.
    """
    group = ["_digest", *_TABLE]
    named = consumers.select(digest(_TABLE).alias("_digest"), *_TABLE, "consumer").where("consumer IS NOT NULL")
    busy = materialize(named.groupBy("_digest").agg(F.count("*").alias("n")).filter(F.col("n") > NAMES_GATHERED).select("_digest"), "busy-tables")
    if busy.isEmpty():
        return _gathered(named, group)
    many = named.join(busy, "_digest", "left_semi").distinct()
    first = F.row_number().over(Window.partitionBy(*group).orderBy("consumer"))
    told = many.withColumn("_n", first).where(F.col("_n") <= CONSUMERS_TOLD).groupBy(*group).agg(F.array_sort(F.collect_list("consumer")).alias("downstream_consumers"))
    counted = told.join(many.groupBy(*group).agg(F.count("*").alias("n_consumers")), group)
    return _gathered(named.join(busy, "_digest", "left_anti"), group).unionByName(counted)


def _gathered(named: DataFrame, group: list[str]) -> DataFrame:
    names = named.repartition(*group).groupBy(*group).agg(F.collect_set("consumer").alias("_names"))
    return names.select(
        *group, F.slice(F.array_sort("_names"), 1, CONSUMERS_TOLD).alias("downstream_consumers"), F.size("_names").cast("bigint").alias("n_consumers")
    )


def _with_consumers(changes: DataFrame, consumers: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The readers of each change's table, and ``is_collateral`` as ``attribute_collateral_reorder``
    gives it: both are looked up by table, so the changes are brought together once for them."""
    columns = changes.columns
    group = ["_digest", *dict.fromkeys([*keys, *_TABLE])]
    marked = changes.withColumn("_digest", digest(_TABLE))
    promoted = marked.filter(F.col("change_type") == "TYPE_PROMOTION").select(*group).distinct().withColumn("_promoted", F.lit(True))
    is_move = F.coalesce(F.col("change_type") == "REORDER", F.lit(False))
    beside = marked.join(promoted, group, "left").join(_readers(consumers), ["_digest", *_TABLE], "left")
    return beside.select(
        *columns, (is_move & F.col("_promoted").isNotNull()).alias("is_collateral"),
        F.coalesce("downstream_consumers", F.array().cast("array<string>")).alias("downstream_consumers"),
        F.coalesce("n_consumers", F.lit(0).cast("bigint")).alias("n_consumers"),
    )


def classify_by_rules(described: DataFrame) -> DataFrame:
    """``classify_changes`` by the rules for changes that have ``is_collateral`` already; a projection."""
    similarity = name_similarity(F.col("before.column_name"), F.col("after.column_name"))
    old, new = F.col("before.column_name"), F.col("after.column_name")
    confidence = (
        F.when(F.col("change_type") == "RENAME", similarity)
        .when(F.col("is_collateral"), F.lit(COLLATERAL_CONFIDENCE))
        .otherwise(F.lit(1.0))
    )
    rationale = (
        F.when(
            F.col("change_type") == "RENAME",
            F.concat(old, F.lit(" was dropped and "), new, F.lit(" of the same type appeared.")),
        )
        .when(
            F.col("change_type") == "TYPE_PROMOTION",
            F.concat(
                new, F.lit(" changed type from "), F.col("before.data_type"), F.lit(" to "), F.col("after.data_type"), F.lit(".")
            ),
        )
        .when(F.col("is_collateral"), F.concat(new, F.lit(" moved because its table was rewritten by a type change.")))
        .when(F.col("change_type") == "REORDER", F.concat(new, F.lit(" moved to another position.")))
        .when(F.col("change_type") == "NEW_FIELD", F.concat(new, F.lit(" is new.")))
        .otherwise(F.concat(old, F.lit(" was dropped.")))
    )
    if "n_consumers" in described.columns:
        read = F.when(F.col("n_consumers") > 0, F.concat(F.lit(" Downstream readers of the table: "), F.col("n_consumers").cast("string"), F.lit(".")))
        rationale = F.concat(rationale, F.coalesce(read, F.lit("")))
    return described.withColumns(
        {
            "classification_conf": confidence.cast("double"),
            "rationale": rationale,
            "remediation_sql": F.when(
                (F.col("change_type") == "RENAME") & (similarity < REVIEW_THRESHOLD), F.lit("")
            ).otherwise(shim_text(F.col("table_schema"))),
            "is_valid": F.lit(True),
            "error": F.lit(None).cast("string"),
        }
    )
