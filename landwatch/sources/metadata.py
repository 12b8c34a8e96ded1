"""Landed column metadata: from the catalog, from metadata rows, and connection lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.functions.text import blank_to, table_key
from landwatch.functions.types import warehouse_type_of
from landwatch.schemas import LANDED_COLUMNS


def landed_columns(spark: SparkSession, datasets: dict[str, str]) -> DataFrame:
    """Columns of every table in the given databases (``connection_id -> database``).

    Only the session catalog knows these schemas, so the driver walks its entries and never
    reads table data: meant for a handful of datasets. ``landed_columns_from_footers`` reads the
    tables' own files with many tasks, ``landed_columns_from_rows`` metadata stored as rows.
    System columns are included.
    """
    rows = []
    for connection_id, database in datasets.items():
        for table in spark.catalog.listTables(database):
            if table.isTemporary:
                continue
            fields = spark.table(f"`{database}`.`{table.name}`").schema.fields
            rows += [
                (connection_id, database, table.name, f.name, warehouse_type_of(f.dataType), i, f.nullable)
                for i, f in enumerate(fields, start=1)
            ]
    return spark.createDataFrame(rows, LANDED_COLUMNS)


def normalize_column_rows(rows: DataFrame) -> DataFrame:
    """Metadata rows with ``is_nullable`` as boolean (from YES/NO in any case, or boolean)
    and ``ordinal_position`` as a long."""
    nullable = F.col("is_nullable")
    if rows.schema["is_nullable"].dataType.typeName() != "boolean":
        nullable = F.upper(nullable) == "YES"
    return rows.withColumns(
        {
            "is_nullable": F.coalesce(nullable, F.lit(False)),
            "ordinal_position": F.col("ordinal_position").cast("bigint"),
        }
    )


def landed_columns_from_rows(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """Landed columns of the whole fleet from stored metadata rows."""
    out = normalize_column_rows(rows).select(*LANDED_COLUMNS.names)
    if ordered:
        out = out.orderBy("connection_id", "table_schema", "table_name", "ordinal_position")
    return out


def schema_by_table(landed: DataFrame) -> DataFrame:
    """One row per table with its columns in ordinal order.

    The group is one landed table, whose width the warehouse limits (10,000 columns in the
    common ones), so the array is bounded whatever the size of the fleet.
    """
    column = F.struct("ordinal_position", "column_name", "data_type", "is_nullable")
    return landed.groupBy("connection_id", table_key().alias("table_key")).agg(
        F.sort_array(F.collect_list(column)).alias("columns")
    )


def resolve_destination(
    df: DataFrame, connections: DataFrame, default: str | None = "public"
) -> DataFrame:
    """Add ``destination_schema``: the connection's ``config_schema``, else its
    ``schema_prefix``, else ``default``; empty strings count as missing.

    ``connections`` has one row per connection_id. Spark broadcasts it while it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle.
    """
    fallback = F.lit(default or "public")
    lookup = connections.select(
        "connection_id",
        blank_to(F.col("config_schema"), F.nullif(F.col("schema_prefix"), F.lit(""))).alias("_dest"),
    )
    return df.join(lookup, "connection_id", "left").select(
        *df.columns, F.coalesce("_dest", fallback).alias("destination_schema")
    )


def active_connections(sync_log: DataFrame, ordered: bool = False) -> DataFrame:
    """Connections that have synced at least once."""
    out = sync_log.select("connection_id").distinct()
    return out.orderBy("connection_id") if ordered else out


def is_system_column(name: Column, prefix: str, suffix: str) -> Column:
    return F.startswith(name, F.lit(prefix)) | F.endswith(name, F.lit(suffix))


def exclude_system_columns(landed: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Drop the loader's bookkeeping columns: names starting with ``prefix`` or ending with
    ``suffix``. A name that merely contains either is kept. The affixes depend on the
    loader in use and have no default."""
    return landed.filter(~is_system_column(F.col("column_name"), prefix, suffix))
