"""Semi-structured columns: detection, structure inference, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.json_text import (
    JSON_KINDS,
    KIND_TO_SPARK,
    KIND_TO_WAREHOUSE,
    json_kind,
    json_object_map,
    variant_text,
)
from landwatch.functions.text import table_key
from landwatch.session import materialize
from landwatch.sources.rows import json_sample

# -- fixed values: names that suggest a structured payload, and the empty structure -----
PAYLOAD_NAME = "(?i)(metadata|properties|attributes|payload|details|extras|config|context)"
EMPTY_STRUCTURE = ("_unknown_key", "str")
SAMPLE_ROWS = 5
#: Room for the keys of one row in ``key_order``.
KEYS_OF_A_ROW = 100_000_000


def detect_json_columns(landed: DataFrame) -> DataFrame:
    """Columns of type JSON, or STRING columns whose name suggests a payload, with the reason."""
    kind = F.upper("data_type")
    reason = F.when(kind == "JSON", "data_type=JSON").when(
        (kind == "STRING") & F.col("column_name").rlike(PAYLOAD_NAME),
        F.concat(
            F.lit("STRING column name matches structured-payload pattern ("), F.col("column_name"), F.lit(")")
        ),
    )
    return (
        landed.select(
            "connection_id", table_key().alias("table_key"), "column_name", "data_type", reason.alias("reason")
        ).filter(F.col("reason").isNotNull())
    )


def infer_json_structure(
    df: DataFrame,
    column: str,
    mode: str = "sample",
    order_by: str | list[str] | None = None,
    n: int = SAMPLE_ROWS,
) -> DataFrame:
    """Top-level keys with their kind: ``(key, json_type, key_order)``.

    ``sample`` looks at up to ``n`` rows and takes the first kind seen for a key, a JSON null
    included. ``full`` reads every row, combining keys on the map side, and takes the widest
    kind that is not null: JSON text (dict) when a nested value meets another kind, float
    when only numbers meet, else text. Rows that are not objects are skipped; no key at all gives one placeholder.
    """
    if mode == "sample":
        rows = json_sample(df, column, n, order_by)
    elif mode == "full":
        rows = df.filter(F.col(column).isNotNull()).select(F.lit(0).alias("row_no"), F.col(column).alias("value"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    keys = rows.select("row_no", F.posexplode(json_object_map(F.col("value"))).alias("pos", "key", "v")).select(
        "key", F.struct("row_no", "pos").alias("at"), json_kind(F.col("v")).alias("kind")
    )
    if mode == "sample":
        found = keys.groupBy("key").agg(F.min_by("kind", "at").alias("json_type"), F.min("at").alias("at"))
    else:
        # The kinds seen, one bit each.
        bits = F.create_map(*[F.lit(x) for i, k in enumerate(JSON_KINDS) for x in (k, 1 << i)])
        has = {k: F.col("mask").bitwiseAND(1 << i) > 0 for i, k in enumerate(JSON_KINDS)}
        n_kinds = sum((has[k].cast("int") for k in JSON_KINDS if k != "NoneType"), F.lit(0))
        only_numbers = ~has["str"] & ~has["bool"]
        widest = (
            F.when(n_kinds == 0, "NoneType")
            .when(n_kinds == 1, F.coalesce(*[F.when(has[k], k) for k in JSON_KINDS if k != "NoneType"]))
            .when(has["dict"] | has["list"], "dict")
            .when(only_numbers, "float")
            .otherwise("str")
        )
        found = keys.groupBy("key").agg(F.bit_or(bits[F.col("kind")]).alias("mask"), F.min("at").alias("at")).select(
            "key", widest.alias("json_type"), "at"
        )
    placeholder = found.sparkSession.range(1).select(
        F.lit(EMPTY_STRUCTURE[0]).alias("key"), F.lit(EMPTY_STRUCTURE[1]).alias("json_type"), F.lit(0).cast("bigint").alias("key_order")
    )
    n_found = found.agg(F.count(F.lit(1))).scalar()
    out = found.select("key", "json_type", (F.col("at.row_no").cast("bigint") * KEYS_OF_A_ROW + F.col("at.pos")).alias("key_order"))
    return out.unionByName(placeholder.filter(n_found == 0))


def structure_to_list(structure: DataFrame) -> list[tuple[str, str]]:
    """The structure as an ordered list, for ``flatten_json``.

    Collects one row per key: call it where the payload is a record whose keys become columns.
    For a payload that is a map, with keys as many as its data, use ``flatten_json_long``.
    """
    return [(r["key"], r["json_type"]) for r in structure.orderBy("key_order", "key").collect()]


def _column_names(keys: list[str], taken: list[str]) -> list[str]:
    """Column names for keys, with a numeric suffix where Spark would see a duplicate."""
    used = {t.lower() for t in taken}
    out = []
    for key in keys:
        name, i = key, 2
        while name.lower() in used:
            name, i = f"{key}_{i}", i + 1
        used.add(name.lower())
        out.append(name)
    return out


def flatten_json(df: DataFrame, column: str, structure: list[tuple[str, str]]) -> DataFrame:
    """Replace a JSON text column by one typed column per top-level key of a given list.

    The text is parsed once per row into a map; each key is cast safely (a value that does
    not fit gives NULL). Lists and objects stay JSON text, and a nested value under a scalar
    key gives NULL. A projection only: no shuffle.
    """
    keys = list(structure)
    kept = [c for c in df.columns if c != column]
    names = _column_names([k for k, _ in keys], kept)
    parsed = df.withColumn("_object", json_object_map(F.col(f"`{column}`")))
    fields = []
    for (key, kind), name in zip(keys, names):
        value = F.col("_object")[key]
        text = variant_text(value)
        if kind not in ("list", "dict"):
            # A nested value is not a scalar. Only text that looks nested needs the kind.
            looks_nested = text.rlike(r"^[\[{]")
            text = F.when(~looks_nested | ~json_kind(value).isin("list", "dict"), text)
        fields.append(text.try_cast(KIND_TO_SPARK[kind]).alias(name))
    return parsed.select(*[F.col(f"`{c}`") for c in kept], *fields)


def flatten_json_long(df: DataFrame, column: str) -> DataFrame:
    """Replace a JSON text column by ``key``, ``json_type`` and ``value``, one row per top-level key.

    Every key of every row is there, whatever their number, and none is known beforehand:
    nothing is sampled, collected or shuffled. ``value`` is text; nested values stay JSON. Rows
    that hold no object, or an empty one, give no rows.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != column]
    taken = {c.lower() for c in df.columns if c != column} & {"key", "json_type", "value"}
    if taken:
        raise ValueError(f"columns already exist: {sorted(taken)}")
    pairs = df.select(*kept, F.explode(json_object_map(F.col(f"`{column}`"))).alias("key", "_v"))
    return pairs.select(*kept, "key", json_kind(F.col("_v")).alias("json_type"), variant_text(F.col("_v")).alias("value"))


def _view_item(column: str, key: Column, kind: Column) -> Column:
    """How the warehouse reads one key of the payload."""
    quoted = F.replace(F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit('\\"'))
    path = F.concat(F.lit("'$.\""), quoted, F.lit("\"'"))
    name = F.concat(F.lit(" AS `"), key, F.lit("`"))
    scalar = F.concat(F.lit(f"JSON_VALUE({column}, "), path, F.lit(")"))
    types = F.create_map(*[F.lit(x) for pair in KIND_TO_WAREHOUSE.items() for x in pair])
    return F.concat(
        F.when(kind.isin("list", "dict"), F.concat(F.lit(f"JSON_QUERY({column}, "), path, F.lit(")")))
        .when(kind.isin("str", "NoneType"), scalar)
        .otherwise(F.concat(F.lit("SAFE_CAST("), scalar, F.lit(" AS "), types[kind], F.lit(")"))),
        name,
    )


def flatten_view(dataset: str, table: str, column: str, structure: DataFrame) -> DataFrame:
    """One row with the warehouse view that does the same: ``view_name``, ``view_sql``, ``estimated_columns``.

    The text is that of ``flatten_view_parts``, put together from its parts, and is as long as the
    payload has keys; use the parts themselves where that is more than a view can have.
    """
    parts = flatten_view_parts(dataset, table, column, structure)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return parts.agg(texts.alias("texts"), F.sum("n_columns").cast("int").alias("estimated_columns"), F.first("view_name").alias("view_name")).select(
        "view_name", F.array_join("texts", "").alias("view_sql"), "estimated_columns"
    )


def flatten_view_parts(dataset: str, table: str, column: str, structure: DataFrame, keys_per_part: int = 1000) -> DataFrame:
    """The same view in pieces, ``(view_name, part, text, n_columns)``: the texts joined in the order of ``part``.

    The keys are sorted over all partitions and numbered inside each, so a part has at most
    ``keys_per_part`` keys and no task holds more, however many keys the payload has.
    """
    source = f"{dataset}.{table.split('.', 1)[-1]}"
    view = f"{source}_flat"
    n = int(structure.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [F.col("key_order").cast("bigint"), F.col("key")]
    ordered = structure.repartitionByRange(n, *place).sortWithinPartitions(*place).withColumn("_at", F.monotonically_increasing_id())
    # The number has the partition in its upper bits and the row of the partition below.
    part = F.shiftright("_at", 33) * F.lit(1 << 33) + F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / keys_per_part) + 1
    items = F.sort_array(F.collect_list(F.struct("_at", _view_item(column, F.col("key"), F.col("json_type")).alias("text"))))
    parts = ordered.groupBy(part.cast("bigint").alias("part")).agg(items.alias("items")).select(
        "part", F.array_join(F.transform("items", lambda x: x["text"]), ", ").alias("text"), F.size("items").cast("bigint").alias("n_columns")
    )
    parts = materialize(parts, "view-parts")  # the cut of a sort is not the same twice
    first = parts.agg(F.min("part")).scalar()
    body = parts.withColumn("text", F.concat(F.when(F.col("part") > first, ", ").otherwise(""), F.col("text")))
    edge = lambda at, text: structure.sparkSession.range(1).select(F.lit(at).cast("bigint").alias("part"), F.lit(text).alias("text"), F.lit(0).cast("bigint").alias("n_columns"))
    head = edge(0, f"CREATE OR REPLACE VIEW {view} AS SELECT * EXCEPT({column}), ")
    return head.unionByName(body).unionByName(edge((1 << 62), f" FROM {source}")).withColumn("view_name", F.lit(view))
