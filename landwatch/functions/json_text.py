"""Reading JSON out of text: model replies and payload objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: JSON value kinds as reported for payload keys -----------------------
JSON_KINDS = ("str", "int", "float", "bool", "list", "dict", "NoneType")

# Spark type a flattened key of each kind is cast to; lists and objects stay JSON text.
KIND_TO_SPARK = {
    "str": "string",
    "int": "bigint",
    "float": "double",
    "bool": "boolean",
    "list": "string",
    "dict": "string",
    "NoneType": "string",
}
_VARIANT_KINDS = {
    "VOID": "NoneType",
    "OBJECT": "dict",
    "ARRAY": "list",
    "BIGINT": "int",
    "BOOLEAN": "bool",
    "DECIMAL": "float",
    "DOUBLE": "float",
    "FLOAT": "float",
}
KIND_TO_WAREHOUSE = {"str": "STRING", "int": "INT64", "float": "FLOAT64", "bool": "BOOL", "NoneType": "STRING"}


def extract_json(text: Column) -> Column:
    """Trimmed reply without one optional surrounding code fence."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    body = F.regexp_extract(trimmed, r"(?s)^```(?:json)?\s*(.+?)\s*```$", 1)
    return F.when(trimmed.rlike(r"(?s)^```(?:json)?\s*(.+?)\s*```$"), body).otherwise(trimmed)


def json_object_map(text: Column) -> Column:
    """Top-level object as an ordered map of key to variant; NULL for anything else."""
    return F.from_json(text, "map<string,variant>")


def json_kind(value: Column) -> Column:
    """Kind of a variant value, one of JSON_KINDS. A NULL variant is a JSON null."""
    names = F.create_map(*[F.lit(x) for pair in _VARIANT_KINDS.items() for x in pair])
    # The part before any parameters: OBJECT<a: BIGINT> is an OBJECT.
    kind = names[F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)]
    return F.when(value.isNull(), "NoneType").otherwise(F.coalesce(kind, F.lit("str")))


def variant_text(value: Column) -> Column:
    """A scalar variant as text, an object or list as JSON text."""
    return F.try_variant_get(value, "$", "string")
