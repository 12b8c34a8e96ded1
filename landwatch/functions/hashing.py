"""Content hash of a set of landed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = ("table_schema", "table_name", "column_name", "data_type", "ordinal_position")
#: Version of the digest, kept in front of each hash. A stored hash of another version differs
#: from every new one, so its snapshot is compared by content once and then replaced.
VERSION = "2"
#: The lowest 30 bits.
_LOW = (1 << 30) - 1


def _row_text() -> Column:
    """One column's parts, each after its length, so no two columns share a text."""
    parts = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in _PARTS]
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def content_hash(landed: DataFrame, by: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    """``(by..., content_hash, column_count)`` over landed columns.

    The digest merges: it is made from the count and from sums of the columns' own digests, so
    partial results combine before the shuffle and no group, however large, is collected or
    sorted. Order and nullability are not part of it; any other change of the set of columns
    changes it. Columns are summed per table first: a connection with a third of all columns
    reaches its last sum as one row per table.
    """
    digest = F.md5(_row_text())
    rows = landed.select(*by, "table_schema", "table_name", digest.alias("_d"))
    numbers = [F.conv(F.substring("_d", at, 15), 16, 10).cast("bigint") for at in (1, 17)]
    # Sums of long decimals are slow to keep, so both ends of each 60-bit number are summed as
    # numbers of 30 bits, which leave room for 2^33 columns.
    ends = [end for n in numbers for end in (F.shiftright(n, 30), n.bitwiseAND(F.lit(_LOW)))]
    parts = [f"_s{i}" for i in range(len(ends))]
    tables = rows.groupBy(*by, "table_schema", "table_name").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(end).alias(s) for s, end in zip(parts, ends)]
    )
    whole = tables.groupBy(*by).agg(F.sum("_n").alias("column_count"), *[F.sum(s).alias(s) for s in parts])
    sums = [_whole(F.col(high), F.col(low)) for high, low in (parts[:2], parts[2:])]
    return whole.select(*by, _text(F.col("column_count"), *sums).alias("content_hash"), "column_count")


def _whole(high: Column, low: Column) -> Column:
    exact = "decimal(38,0)"
    return (high.cast("decimal(27,0)") * F.lit(_LOW + 1).cast("decimal(10,0)") + low.cast("decimal(37,0)")).cast(exact)


def _text(count: Column, *sums: Column) -> Column:
    return F.concat(F.lit(f"{VERSION}:"), F.sha2(F.concat_ws("|", count.cast("string"), *[s.cast("string") for s in sums]), 256))


def empty_hash() -> Column:
    """Hash of a connection with no landed columns."""
    return _text(F.lit(0), F.lit(0), F.lit(0))
