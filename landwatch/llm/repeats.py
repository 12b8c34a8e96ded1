"""Suffix-array deduplication: remove every byte of a fixed-length string that also starts earlier.

Ranks come from prefix doubling: the name of 2k bytes is made from the names of k bytes at p and
at p + k, from single bytes up to ``GRAM``, and longer strings are named by the pair (or tuple)
of names at growing offsets. Spark sorts (name, position) rows and reranks them; what is unique
drops out before the next, longer round:

1. Names of ``GRAM`` bytes. Sorting all positions would move many times the corpus, so a round
   takes one position for each run of windows: the leftmost smallest name inside a window of
   ``length`` bytes. Equal windows have it at the same place, so no repeat is lost.
2. Among equal names, the name of all the bytes its windows cover. Where these agree, all but the
   first occurrence repeat; a name that occurs once drops out.
3. What agrees in round 1 but not in round 2 lies at the edge of a repeat: the windows of the
   first occurrence of each variant are named at full ``length`` and sorted once more. A string's
   first occurrence is always among them, so the answer is exact for every position.

Before each shuffle a task keeps one row of equal names (the others are known to repeat), so a
passage in a third of all documents reaches the sort a few times per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage

GRAM = 32
#: Windows named at once: bounds the memory of a very long text.
BLOCK = 1 << 20
#: Rows a task combines before it sends them.
FLUSH = 1 << 20
LEVELS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
STEP = np.uint64(0xE7037ED1A0B428DB)


def gram_names(raw: np.ndarray) -> np.ndarray:
    """Names of the ``GRAM`` bytes at each position, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * STEP
    k = 1
    for factor in LEVELS:
        left = h[:-k] * factor
        left += h[k:]
        left ^= left >> np.uint64(29)
        h, k = left, 2 * k
    return h * STEP ^ (h >> np.uint64(32))


def joined_names(names: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, parts: int) -> np.ndarray:
    """Names of longer strings, from the names of their pieces at growing offsets; ``parts`` * ``GRAM`` covers the longest."""
    out = np.asarray(lengths, np.uint64) * STEP + np.zeros(len(starts), np.uint64)
    for j in range(parts):
        out = (out ^ names[starts + np.minimum(j * GRAM, lengths - GRAM)]) * STEP
        out ^= out >> np.uint64(31)
    return out


def anchors(names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same leftmost smallest name: its place, the first window and how many."""
    span = length - GRAM + 1
    low, at, width = names, np.arange(len(names), dtype=np.int32), 1
    while width < span:
        k = min(width, span - width)
        first = low[:-k] <= low[k:]
        low, at, width = np.where(first, low[:-k], low[k:]), np.where(first, at[:-k], at[k:]), width + k
    start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    return at[start].astype(np.int64), start, np.diff(np.append(start, len(at)))


def runs_of(raw: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, whole name, first window, windows) of each run of a text, in blocks; a border splits a run in two."""
    for lo in range(0, len(raw) - length + 1, BLOCK):
        names = gram_names(raw[lo : lo + BLOCK + length - 1])
        at, start, n = anchors(names, length)
        covered = n + length - 1
        whole = joined_names(names, start, covered, -(-2 * length // GRAM)) ^ ((at - start).astype(np.uint64) * LEVELS[0])
        yield names[at], whole, start + lo, n


def _first_rows(rows: dict[str, np.ndarray]) -> pd.DataFrame:
    """The rows with ``at`` doubled, plus one where equal names stand earlier among them.

    Such a row is settled: its names are blanked. Rows keep their order, document by document,
    which is how they shuffle smallest.
    """
    order = np.lexsort((rows["at"], rows["doc_id"], rows.get("whole", rows["name"]), rows["name"]))
    out = {c: x[order] for c, x in rows.items()}
    later = np.zeros(len(order), bool)
    if len(order):
        same = out["name"][1:] == out["name"][:-1]
        if "whole" in out:
            same &= out["whole"][1:] == out["whole"][:-1]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
        later[order] = (out["doc_id"] != out["doc_id"][head]) | (out["at"] != out["at"][head])
    names = {c: np.where(later, 0, rows[c]) for c in ("name", "whole") if c in rows}
    return pd.DataFrame({**names, "doc_id": rows["doc_id"], "at": rows["at"] * 2 + later})


def _combined(parts: Iterable[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p["at"])
        if n >= FLUSH:
            yield _first_rows({c: np.concatenate([h[c] for h in held]) for c in p})
            held, n = [], 0
    if held:
        yield _first_rows({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def rerank(rows: DataFrame) -> DataFrame:
    """doc_id, at, status of the rows that aren't unique: 1 if equal (name, whole) stand earlier, 2 if only the name repeats.

    ``rows``: name, perhaps whole, doc_id and at as ``_first_rows`` gives them. They are sorted by
    Spark and read as a stream: a name with very many rows is never held.
    """
    spread = F.when(F.col("at") % 2 == 1, F.xxhash64("doc_id", "at")).otherwise(F.col("name"))

    def scan(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        head = None  # (name, whole, doc_id, at) of the first row of the current (name, whole)
        waiting = None  # (doc_id, at) of the first row of the current name, while it has one variant only
        for pdf in batches:
            doc, at = pdf["doc_id"].to_numpy(), pdf["at"].to_numpy() >> 1
            later = pdf["at"].to_numpy() % 2 == 1
            out = [(doc[later], at[later], np.ones(int(later.sum()), np.int32))]
            name, doc, at = pdf["name"].to_numpy()[~later], doc[~later], at[~later]
            whole = pdf["whole"].to_numpy()[~later] if "whole" in pdf else np.zeros(len(name), np.int64)
            if len(name):
                if head is not None:
                    name, whole = np.append(head[0], name), np.append(head[1], whole)
                    doc, at = np.append(head[2], doc), np.append(head[3], at)
                same_name = np.concatenate(([False], name[1:] == name[:-1]))
                same = same_name & np.concatenate(([False], whole[1:] == whole[:-1]))
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
                status = np.where(same, np.where((doc != doc[first]) | (at != at[first]), 1, 3), np.where(same_name, 2, 0))
                run = np.cumsum(~same_name) - 1
                mixed = np.bincount(run, status == 2) > 0
                if head is not None:
                    if mixed[0] and waiting is not None:
                        out.append((np.array([waiting[0]]), np.array([waiting[1]]), np.array([2], np.int32)))
                        waiting = None
                    if run[-1] > 0:
                        waiting = None
                    status[0] = -1  # told of before
                status[(status == 0) & mixed[run]] = 2
                if status[np.flatnonzero(~same_name)[-1]] == 0:  # the last name's only variant so far
                    k = np.flatnonzero(~same_name)[-1]
                    waiting = (doc[k], at[k])
                elif run[-1] > 0:
                    waiting = None
                status = np.where(status == 3, status[first], status)  # a repeated row shares its twin's status
                tell = (status == 1) | (status == 2)
                out.append((doc[tell], at[tell], status[tell].astype(np.int32)))
                k = first[-1]
                head = (name[k], whole[k], doc[k], at[k])
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("doc_id", "at", "status"))})

    return (
        rows.repartition(spread).sortWithinPartitions(*rows.columns)
        .mapInPandas(scan, "doc_id long, at long, status int")
    )


def _utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def _packed(documents: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """doc_id and the text's bytes compressed, which is how texts are shuffled."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=1)
        return pd.Series([z.compress(_utf8(t)) for t in texts])

    return documents.select(F.col(key_col).cast("long").alias("doc_id"), pack(F.col(text_col)).alias("packed"))


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def _encode(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A run of windows as one number that sorts by its first window; a run has fewer than 2 ** 12 windows."""
    return (start << 12) | n


def removal_runs(documents: DataFrame, length: int = 100, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, run): runs of windows, each with an equal string earlier; run = first window * 4096 + number of windows."""
    if not 2 * GRAM <= length < 2048:
        raise ValueError(f"length must be from {2 * GRAM} to 2047")
    texts = documents.where(F.col(key_col).isNotNull() & F.col(text_col).isNotNull())

    def first_round(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        def parts():
            for pdf in batches:
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    raw = np.frombuffer(_utf8(text), np.uint8)
                    for name, whole, start, n in runs_of(raw, length):
                        yield {"name": name.view(np.int64), "whole": whole.view(np.int64), "doc_id": np.full(len(n), doc, np.int64), "at": _encode(start, n)}

        return _combined(parts())

    rows = texts.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        first_round, "name long, whole long, doc_id long, at long"
    )
    ranked = stage(rerank(rows), "repeat-runs")
    edges = ranked.where("status = 2").groupBy("doc_id").agg(F.collect_list("at").alias("runs"))

    def last_round(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        def parts():
            for pdf in batches:
                for doc, packed, runs in zip(pdf["doc_id"], pdf["packed"], pdf["runs"]):
                    raw = np.frombuffer(_unpacked(packed), np.uint8)
                    runs = np.unique(np.asarray(runs, np.int64))
                    start, n = runs >> 12, runs & 4095
                    fits = start + n + length - 1 <= len(raw)  # always, where an id has one text
                    for lo in range(0, len(raw), BLOCK):
                        own = fits & (start >= lo) & (start < lo + BLOCK)
                        if own.any():
                            names = gram_names(raw[lo : lo + BLOCK + 4096 + length])
                            at = np.concatenate([np.arange(s, s + k) for s, k in zip(start[own], n[own])])
                            full = joined_names(names, at - lo, length, -(-length // GRAM))
                            yield {"name": full.view(np.int64), "doc_id": np.full(len(at), doc, np.int64), "at": _encode(at, np.ones(len(at), np.int64))}

        return _combined(parts())

    windows = _packed(texts, text_col, key_col).join(edges, "doc_id").mapInPandas(last_round, "name long, doc_id long, at long")
    return ranked.where("status = 1").select("doc_id", F.col("at").alias("run")).union(
        rerank(windows).where("status = 1").select("doc_id", F.col("at").alias("run"))
    )


def spans_of(runs: np.ndarray, length: int, n_bytes: int) -> np.ndarray:
    """Maximal removed byte spans, as rows (start, end), of encoded runs of windows."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    runs = np.sort(runs)
    start, end = runs >> 12, np.minimum((runs >> 12) + (runs & 4095) - 1 + length, n_bytes)
    end = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return np.stack((start[new], end[last]), 1)


def remove_repeats(documents: DataFrame, length: int = 100, text_col: str = "text", key_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row, and ``kept`` (binary) ``with_text``.

    Texts are UTF-8 bytes; NULL is empty. A byte goes if a string of ``length`` bytes over it also
    starts earlier, in a smaller doc_id or before in the same document; overlaps count and strings
    are judged on the input. Texts below ``length`` bytes stay. A doc_id names one text: equal
    rows repeated under one id each get that document's result. A row with a NULL doc_id is kept
    whole and makes no other row shorter. Long texts are read whole, in blocks; an empty table
    gives no rows. Strings are compared by 64-bit names and not byte by byte: among m windows that
    share their anchor with others but not its run, about m * m / 2 ** 65 pairs have equal names by
    chance (0.00006 for the 46 million windows of 0.5 GB; at 10 ** 13 windows some million).
    """
    runs = removal_runs(documents, length, text_col, key_col).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def cut(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for packed, found in zip(pdf["packed"], pdf["runs"]):
                raw = _unpacked(packed)
                spans = spans_of(np.asarray(found if found is not None else [], np.int64), length, len(raw))
                kept, at = [], 0
                for lo, hi in spans.tolist():
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy() if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy())
            yield frame if with_text else frame.drop(columns="kept")

    return _packed(documents, text_col, key_col).join(runs, "doc_id", "left").mapInPandas(cut, schema)
