"""Token counts by offset-mapped attribution.

A whole document is encoded once. The byte spans of its tokens are joined with the byte spans of
its sections by interval: both lists are ordered and cover the text, so one merge finds the
section of each token. A token that crosses a boundary belongs to the section that holds its
first byte (``rule="start"``), its last byte (``"end"``), or most of its bytes, the earlier
section on a tie (``"most"``). Every token is counted once, so the sections add up to the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before byte-pair merging; fixed by the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(vocabulary: str):
    """The encoder and the byte length of each of its tokens; loaded once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("table", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, starts: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token. ``bounds``: the sections' first bytes, ascending, beginning with 0."""
    first = np.searchsorted(bounds, starts, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "end":
        return last
    best, most = first.copy(), np.zeros(len(starts), np.int64)
    for i in np.flatnonzero(first != last):  # the few tokens that cross a boundary
        for s in range(first[i], last[i] + 1):
            to = ends[i] if s + 1 == len(bounds) else min(ends[i], bounds[s + 1])
            held = to - max(starts[i], bounds[s])
            if held > most[i]:
                best[i], most[i] = s, held
    return best


def section_bounds(raw: bytes, separator: bytes) -> np.ndarray:
    """First byte of each section; a separator ends its section and belongs to it."""
    at, found = [0], raw.find(separator)
    while found >= 0:
        at.append(found + len(separator))
        found = raw.find(separator, found + len(separator))
    if len(at) > 1 and at[-1] == len(raw):
        at.pop()  # the text ends with a separator: no empty section after it
    return np.array(at, np.int64)


def section_tokens(documents: DataFrame, separator: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY,
                   text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per document and section: doc_id, section (from 0), start_byte, end_byte, n_tokens, n_crossing.

    ``n_crossing``: counted tokens that also reach into another section. NULL and empty texts have
    one empty section. Each row of ``documents`` is handled alone, so repeated rows give repeated
    rows; other columns are not read, and an empty table gives no rows. Texts are encoded whole,
    whatever their length. The vocabulary's path must be readable on every executor.
    """
    if rule not in ("start", "end", "most"):
        raise ValueError(f"unknown rule: {rule}")
    sep = separator.encode()

    def encode(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        enc, lengths = encoder(vocabulary)
        for pdf in batches:
            keys, parts = [], []
            for key, text in zip(pdf["k"], pdf["t"]):
                text = text or ""
                raw = text.encode("utf-8", "replace")
                bounds = section_bounds(raw, sep)
                ends = np.cumsum(lengths[np.array(enc.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
                starts = np.concatenate((np.zeros(1, np.int64), ends))[:-1]
                owner = attribute(ends, starts, bounds, rule)
                stops = np.append(bounds[1:], len(raw))
                crossing = (starts < bounds[owner]) | (ends > stops[owner])
                keys.append(np.full(len(bounds), -1 if pd.isna(key) else key, object if pd.isna(key) else np.int64))
                parts.append(np.stack([
                    np.arange(len(bounds)), bounds, stops, np.bincount(owner, minlength=len(bounds)),
                    np.bincount(owner, crossing, len(bounds)).astype(np.int64),
                ], 1))
            if parts:
                cols = np.concatenate(parts)
                out = pd.DataFrame(cols, columns=["section", "start_byte", "end_byte", "n_tokens", "n_crossing"])
                key_col_values = pd.array(np.concatenate([k.astype(object) for k in keys]), dtype="Int64")
                nulls = np.repeat(pdf["k"].isna().to_numpy(), [len(k) for k in keys])
                key_col_values[nulls] = pd.NA
                out.insert(0, "doc_id", key_col_values)
                yield out

    return documents.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInPandas(
        encode, "doc_id long, section long, start_byte long, end_byte long, n_tokens long, n_crossing long"
    )


def document_tokens(sections: DataFrame) -> DataFrame:
    """Sections summed per document: doc_id, n_sections, n_tokens, n_crossing."""
    return sections.groupBy("doc_id").agg(
        F.count("*").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_crossing").alias("n_crossing")
    )
