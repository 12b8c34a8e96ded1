"""Packing into optimal length buckets.

The global histogram of segment lengths (at most ``max_len`` + 1 values) is counted in Spark.
Dynamic programming over it chooses the bucket boundaries with the least padding. Inside each
bucket, segments fill batches of a token budget: a bucket of width w takes budget // w of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landwatch.llm.common import stage

#: Rows a numbering task should hold; each bucket is numbered in so many shards.
SHARD_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text") -> Column:
    """Words of a text as its length; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` ascending bucket widths with the least total padding.

    ``counts[n]``: segments of length n. The last width is the longest length present. The widths
    are lengths that occur; among equal choices the smaller one is taken. No rows: one width of 1.
    """
    counts = np.array(counts)
    if len(counts) > 1:  # no bucket is narrower than 1: empty segments fill the width-1 places
        counts[1], counts[0] = counts[1] + counts[0], 0
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return [1]
    n = np.concatenate(([0], np.cumsum(counts[lengths])))
    k = min(k, len(lengths))
    # Padding is (sum of widths) - (sum of lengths), and the latter is fixed.
    # cost[j]: least sum of widths for the first j lengths with the buckets used so far.
    cost = np.concatenate(([0.0], n[1:] * lengths.astype(float)))
    choice = []
    for _ in range(k - 1):
        best, at = cost.copy(), np.full(len(cost), -1)
        for j in range(1, len(cost)):
            total = cost[:j] + (n[j] - n[:j]) * float(lengths[j - 1])
            i = int(total.argmin())
            if total[i] < best[j]:
                best[j], at[j] = total[i], i
        choice.append(at)
        cost = best
    widths, j = [], len(lengths)
    for at in reversed(choice):
        if at[j] >= 0:
            widths.append(int(lengths[j - 1]))
            j = int(at[j])
            if j == 0:
                break
    if j:
        widths.append(int(lengths[j - 1]))
    return sorted(max(1, w) for w in set(widths))


def segments(documents: DataFrame, length: Column, max_len: int, key_col: str = "doc_id") -> DataFrame:
    """doc_id, segment, n_tokens: documents cut into pieces of at most ``max_len``; an empty one has one empty piece."""
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    pieces = F.greatest(F.ceil(n / max_len).cast("long"), F.lit(1))
    return (
        documents.select(F.col(key_col).alias("doc_id"), n.alias("_n"), pieces.alias("_pieces"))
        .select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)).alias("segment"))
        .select("doc_id", "segment", F.least(F.col("_n") - F.col("segment") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"))
    )


def pack(pieces: DataFrame, max_len: int, n_buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """doc_id, segment, n_tokens, bucket, width, batch, slot: every segment in one slot of one batch.

    ``pieces``: doc_id, segment, n_tokens (0 to ``max_len``). Batches are numbered from 0 in each
    bucket and all but a bucket's last are full. The order inside a bucket is by a hash of
    (doc_id, segment, row), so a batch mixes documents; repeated rows take one slot each. No row is
    dropped. Slots come from counts per (bucket, shard) and a running sum over shards, so a bucket
    with most rows is numbered by many tasks. ``pieces`` is read twice: pass a stored table where
    its lengths are costly. ``stored_segments`` numbers its rows, so that rows with one id, or with
    NULL, spread over the shards too. An empty table gives no rows; columns of other names are not read.
    """
    if budget < max_len:
        raise ValueError("a batch must hold at least one longest segment")
    counts = np.zeros(max_len + 1, np.int64)
    for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect():  # at most max_len + 1 rows
        counts[r["n_tokens"]] = r["n"]
    widths = best_boundaries(counts, n_buckets)
    shards = 1 << max(9, int(np.ceil(np.log2(max(1, counts.sum()) / SHARD_ROWS + 1))))
    bucket = sum((F.when(F.col("n_tokens") > w, 1).otherwise(0) for w in widths), F.lit(0))
    order = F.xxhash64("doc_id", "segment", *(["row"] if "row" in pieces.columns else []))
    rows = pieces.select("doc_id", "segment", "n_tokens", bucket.cast("int").alias("bucket"), order.alias("_o")).withColumn(
        "_shard", F.pmod("_o", F.lit(shards)).cast("int")
    )
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("bucket") + 1)
    before = (
        rows.groupBy("bucket", "_shard").agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(W.partitionBy("bucket").orderBy("_shard")) - F.col("_rows")).drop("_rows")
    )
    number = F.row_number().over(W.partitionBy("bucket", "_shard").orderBy("_o", "doc_id", "segment")) - 1  # equal rows may trade places
    return (
        rows.withColumn("_number", number).join(before, ["bucket", "_shard"])
        .select("doc_id", "segment", "n_tokens", "bucket", width.cast("long").alias("width"), (F.col("_number") + F.col("_before")).alias("_at"))
        .withColumn("_each", F.floor(F.lit(budget) / F.col("width")))
        .select("doc_id", "segment", "n_tokens", "bucket", "width", F.floor(F.col("_at") / F.col("_each")).cast("long").alias("batch"),
                (F.col("_at") % F.col("_each")).cast("long").alias("slot"))
    )


def stored_segments(documents: DataFrame, length: Column, max_len: int, key_col: str = "doc_id") -> DataFrame:
    """``segments`` and a ``row`` number as a table in the shared folder, so the texts are measured once.

    Whole texts are measured, whatever their length; NULL is empty. Repeated rows stay apart.
    """
    return stage(segments(documents, length, max_len, key_col).withColumn("row", F.monotonically_increasing_id()), "segments")
