"""Connected components by alternating large and small stars, every round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge that is not the smallest of its component.

    An id that is missing is its own component. Loops, repeated edges and NULL ends are ignored.
    Neighbour minima are combined before their shuffle and joined back to the edges, so a node
    with most edges is split by adaptive execution and never collected. Rounds grow with the
    logarithm of the longest path.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _signature(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").where(F.col("w") != F.col("m"))
        large = stage(large.select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = stage(small.where(F.col("u") != F.col("v")).distinct(), "small-star")
        last, seen = seen, _signature(now)
        if last == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
