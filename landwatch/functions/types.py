"""Mapping between warehouse type names and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# -- fixed values: warehouse type names ------------------------------------------------
_WAREHOUSE_TO_SPARK = {
    "INT64": "bigint",
    "STRING": "string",
    "BOOL": "boolean",
    "FLOAT64": "double",
    "NUMERIC": "decimal(38,9)",
    "BIGNUMERIC": "string",
    "TIMESTAMP": "timestamp",
    "DATETIME": "timestamp_ntz",
    "DATE": "date",
    "BYTES": "binary",
    "JSON": "string",
}


def spark_type_of(warehouse_type: str) -> str | None:
    """Spark DDL type for a warehouse type name, or None when there is no mapping.

    ``NUMERIC(p,s)`` and ``BIGNUMERIC(p,s)`` of at most 38 digits become decimals; a wider
    one, and plain ``BIGNUMERIC``, stays text, since no Spark number holds all its values.
    ``STRING(n)`` and ``BYTES(n)`` drop the length.
    """
    name = warehouse_type.strip().upper()
    base, _, args = name.partition("(")
    if base in ("NUMERIC", "BIGNUMERIC", "DECIMAL") and args:
        sizes = [int(x) for x in args.rstrip(")").split(",")]
        precision, scale = sizes[0], sizes[1] if len(sizes) > 1 else 0
        return f"decimal({precision},{scale})" if precision <= 38 else "string"
    return _WAREHOUSE_TO_SPARK.get(base)


def warehouse_type_of(data_type: T.DataType) -> str:
    """Warehouse type name for a Spark type, used when metadata is built from a schema."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT64"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "FLOAT64"
    if isinstance(data_type, T.DecimalType):
        return "NUMERIC" if data_type.scale <= 9 else "BIGNUMERIC"
    if isinstance(data_type, T.TimestampNTZType):
        return "DATETIME"
    if isinstance(data_type, T.ArrayType):
        return f"ARRAY<{warehouse_type_of(data_type.elementType)}>"
    if isinstance(data_type, (T.StructType, T.MapType)):
        return "STRUCT"
    if isinstance(data_type, T.VariantType):
        return "JSON"
    simple = {
        T.StringType: "STRING",
        T.BooleanType: "BOOL",
        T.DateType: "DATE",
        T.TimestampType: "TIMESTAMP",
        T.BinaryType: "BYTES",
    }
    for cls, name in simple.items():
        if isinstance(data_type, cls):
            return name
    return data_type.simpleString().upper()
