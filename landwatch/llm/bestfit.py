"""Best-fit packing: as few sequences of at most ``capacity`` tokens as the best-two-fit rule finds.

Pieces of equal length are interchangeable, so the rule works on the global histogram of lengths
(at most ``capacity`` numbers, whatever the corpus) and describes equal sequences once, with their
number. Pieces then take the places planned for their length by rank: each encoding task counts its
own pieces of each length, and a running sum over the tasks gives the rank. Nothing is sorted, and
a length, source or id with most rows is spread over all the tasks that read it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landwatch.llm.common import stage
from landwatch.llm.wordcache import ByteLevel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


@cache
def encoder(vocabulary: str) -> ByteLevel:
    """Loaded once in each worker."""
    return ByteLevel(vocabulary)


def pieces(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its place among its task's pieces of that length.

    A document is its ids and ``end_id``; NULL and empty texts are that id alone. A document of more
    than ``capacity`` ids is cut into pieces of ``capacity``, the first of which may be shorter. Texts
    are encoded whole, whatever their length. Repeated rows and NULL ids give pieces of their own;
    other columns are not read. The vocabulary must be readable under its path on every executor.
    """

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen = encoder(vocabulary).parsed, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            rows, keys = [], []
            for key, text in zip(pdf["k"], pdf["t"]):
                ids = np.append(encode(text if isinstance(text, str) else ""), end_id).astype("<u4")
                stops = np.arange((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for k, stop in enumerate(stops.tolist()):
                    n = stop - start
                    rows.append((k, start, n, zlib.crc32(ids[start:stop].tobytes()), task, int(seen[n])))
                    keys.append(key)
                    seen[n] += 1
                    start = stop
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "task", "nth"])
            out.insert(0, "doc_id", pd.array([None if pd.isna(k) else int(k) for k in keys], dtype="Int64"))
            yield out

    return documents.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInPandas(cut, PIECES)


def best_two(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths x <= y with the largest sum of at most ``room``; the smallest x among equals."""
    if room < 2:
        return None
    fits = np.flatnonzero(left[: room + 1])
    fits = fits[fits * 2 <= room]
    if not len(fits):
        return None
    most = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))  # longest unpacked length up to each
    y = most[room - fits]
    y = np.where((y == fits) & (left[fits] < 2), most[fits - 1], y)  # a single piece is no pair
    total = np.where(y >= fits, fits + y, 0)
    k = int(total.argmax())
    return (int(fits[k]), int(y[k])) if total[k] else None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit over a histogram: [(length, pieces) ...] of a sequence, and how many sequences are like it.

    A sequence is filled with the longest piece that fits, again and again. If room is left, its
    smallest piece goes back where two unpacked pieces fill the widened gap more tightly. The same
    sequence follows as long as the pieces it took last, so the steps grow with the number of
    lengths and not with the number of pieces.
    """
    left = np.array(counts, np.int64)
    out = []
    while (lengths := np.flatnonzero(left)).size:
        gap, took = capacity, {}
        i = len(lengths) - 1
        while i >= 0 and gap:  # greedily, the longest first
            n = int(lengths[i])
            k = min(int(left[n]), gap // n)
            if k:
                took[n], gap = k, gap - k * n
            i = min(i - 1, int(np.searchsorted(lengths, gap, "right")) - 1)
        most = dict(took)
        if gap:
            small = min(took)
            for n, k in took.items():
                left[n] -= k
            two = best_two(left, gap + small)
            for n, k in took.items():
                left[n] += k
            if two and sum(two) > small:
                took[small] -= 1
                for n in two:
                    took[n] = took.get(n, 0) + 1
                    most[n] = max(most.get(n, 0) + 1, took[n])
        took = {n: k for n, k in took.items() if k}
        times = max(1, min(int(left[n]) // k for n, k in most.items()))
        for n, k in took.items():
            left[n] -= k * times
        out.append((sorted(took.items(), reverse=True), times))
    return out


class Places:
    """Where the piece of a length and rank goes, as sorted arrays."""

    def __init__(self, steps: list[tuple[list[tuple[int, int]], int]], capacity: int):
        given = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for took, times in steps:
            offset = 0
            for n, k in took:
                rows.append((n, given[n], sequence, offset, k))
                given[n] += k * times
                offset += n * k
            sequence += times
        rows.sort()
        self.n_sequences = sequence
        self.length, self.rank, self.sequence, self.offset, self.each = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.first = np.searchsorted(self.length, np.arange(capacity + 2))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            lo, hi = self.first[n], self.first[n + 1]
            at[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], "right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece once, sequences without gaps.

    ``cut``: a stored table of ``pieces``. Pieces of equal length take their places in the order of
    task and row. Only the histogram (``capacity`` numbers) reaches the driver, and the plan that
    goes back has a size bounded by ``capacity`` too. An empty table gives no rows.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    places = Places(plan(counts, capacity), capacity)
    before = (
        cut.groupBy("length", "task").agg(F.count("*").alias("_n"))
        .select("length", "task", (F.sum("_n").over(W.partitionBy("length").orderBy("task")) - F.col("_n")).alias("_before"))
    )

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["sequence_id"], pdf["offset"] = places.of(pdf["length"].to_numpy(), pdf.pop("rank").to_numpy())
            yield pdf

    ranked = cut.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_before")).alias("rank")
    )
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` of the ``pieces`` of ``documents``, which are encoded once and stored."""
    return pack(stage(pieces(documents, capacity, vocabulary), "pieces"), capacity)
