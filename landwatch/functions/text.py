"""Small string and null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to(value: Column, default: Column | str) -> Column:
    """``value`` unless it is NULL or the empty string, else ``default``."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def table_key(schema: str = "table_schema", table: str = "table_name") -> Column:
    return F.concat_ws(".", F.col(schema), F.col(table))


def stable_id(*parts: Column) -> Column:
    """Deterministic row id, so a replayed batch writes the same ids again.

    Parts are length-prefixed: no choice of separator inside a value can make two
    different part lists collide.
    """
    pieces = []
    for part in parts:
        text = part.cast("string")
        pieces.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.sha2(F.concat(*pieces), 256)


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of a column or table name, split on anything but letters and digits."""
    return F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def match_token(name: Column) -> Column:
    """Column name for fuzzy matching: lower case, underscores removed."""
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def required_token(name: Column) -> Column:
    """Required field for fuzzy matching: as ``match_token`` with spaces removed too."""
    return F.replace(match_token(name), F.lit(" "), F.lit(""))


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two names in [0, 1]: the better of edit similarity and token overlap."""
    la, lb = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    edit = F.when(longest > 0, 1.0 - F.levenshtein(la, lb) / longest).otherwise(F.lit(1.0))
    ta, tb = F.array_distinct(name_tokens(a)), F.array_distinct(name_tokens(b))
    union = F.size(F.array_union(ta, tb))
    overlap = F.when(union > 0, F.size(F.array_intersect(ta, tb)) / union).otherwise(F.lit(0.0))
    return F.round(F.greatest(edit, overlap), 4)
