"""Alignment of two tokenizers over a corpus, by external spill counting.

Both tokenizers cover the same bytes. Offsets where a token of each side ends cut a text into
groups, and each such offset links the two tokens that end there. Every encoding task collects
records (pair of ids, document, links) and spills them as sorted zstd runs, one for each radix of
the second side's id. Runs hold two parts: links per pair, and links per pair and document.

Counting reads the first parts only: k-way merges of at most ``FAN`` runs, level by level until one
run is left for each radix. Runs are in side-major order (second id, then first id), so the last
merge meets all pairs of an id together and marks those with the highest count as it passes them.
The second parts are then read once more beside the counts of their radix, and what each document's
links contribute is streamed back and summed. A pair, id or source with most links only makes its
runs longer, at most as long as one spill; the number of runs is the same for every radix.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage
from landwatch.llm.wordcache import ByteLevel, Ragged, Words, byte_lengths, word_sizes

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Runs of one merge.
FAN = 32
#: Records a task holds before it spills them.
SPILL = 1_000_000
#: Entries of a run that a merge holds at a time, and pairs in one row of final counts.
BLOCK, CHUNK = 1 << 14, 1 << 20
#: A pair as one number in side-major order: radix, second id, first id.
RADIX_BITS, ID_BITS = 4, 28
RADIXES = 1 << RADIX_BITS


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    b = b.astype(np.uint64)
    return (b % np.uint64(RADIXES)) << np.uint64(2 * ID_BITS) | b << np.uint64(ID_BITS) | a.astype(np.uint64)


def second_id(code: np.ndarray) -> np.ndarray:
    return code >> np.uint64(ID_BITS)  # with its radix, which the id determines


class Pieces:
    """A sentence-piece encoder, with the bytes of each piece; it puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        #: Whether no piece holds a blank after another character, so that words can be encoded alone.
        self.by_word = not any(re.search("[^▁]▁", p) for k, p in enumerate(pieces) if not self.model.is_byte(k))

    def __call__(self, text: str) -> np.ndarray | None:
        """Ids of a text, or None if their bytes are not a blank and the text."""
        ids = self.model.encode(text, num_threads=1)
        if b"".join(map(self.bytes.__getitem__, ids)) != b" " + text.encode():
            return None
        return np.array(ids, np.int64)


class Aligned:
    """What one text has: tokens of each side, the pairs of ids at common ends, and the groups as text."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.ends = ends
        self.to_a, self.to_b = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        self.pairs = pair_code(a[self.to_a - 1], b[self.to_b - 1])
        self.a, self.b = a, b

    def groups(self) -> list[str]:
        """Each group as ``a1,a2|b1``."""
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        out, i, j = [], 0, 0
        for p, q in zip(self.to_a.tolist(), self.to_b.tolist()):
            out.append(f"{a[i]}|{b[j]}" if p - i == 1 == q - j else f"{','.join(a[i:p])}|{','.join(b[j:q])}")
            i, j = p, q
        return out


class Aligner:
    """Both tokenizers, with the alignment of each word remembered."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        self.first, self.second = ByteLevel(byte_vocabulary), Pieces(piece_vocabulary)
        self.words = Words(self._learn, self._forget)

    def _forget(self) -> None:
        self.pairs, self.text = Ragged(np.uint64), []
        self.sizes = Ragged()  # tokens of the first side, of the second side; -1 where they do not cover the word

    def align(self, text: str) -> Aligned | None:
        """A blank and the text, encoded whole by both sides; None where their bytes differ from it."""
        b = self.second(text)
        if b is None:
            return None
        a = self.first.plain(" " + text)
        return Aligned(a.astype(np.int64), b, np.cumsum(self.first.lengths[a]), np.cumsum(self.second.lengths[b]))

    def _learn(self, words: list[str], joined: bool) -> None:
        whole = self.align(" ".join(words)) if joined else None
        if whole is None:
            parts = [self.align(w) for w in words]
            self.pairs.append(np.concatenate([p.pairs if p else np.zeros(0, np.uint64) for p in parts]), np.array([len(p.pairs) if p else 0 for p in parts]))
            self.text += [";".join(p.groups()) if p else "" for p in parts]
            self.sizes.append(np.array([x for p in parts for x in ((len(p.a), len(p.b)) if p else (-1, -1))]), np.full(len(parts), 2))
            return
        word_ends = np.cumsum(byte_lengths(words) + 1)
        sizes = word_sizes(whole.ends, word_ends)
        self.pairs.append(whole.pairs, sizes)
        groups, at = whole.groups(), 0
        for n in sizes.tolist():
            self.text.append(";".join(groups[at : at + n]))
            at += n
        to = np.cumsum(sizes) - 1
        counts = np.stack((np.diff(whole.to_a[to], prepend=0), np.diff(whole.to_b[to], prepend=0)), 1)
        self.sizes.append(counts.ravel(), np.full(len(words), 2))

    def many(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, str] | None]:
        """Of each text the tokens of each side, pair codes of all links, and the groups as text; None without tokens."""
        numbers = self.words.of(texts) if self.second.by_word else [None] * len(texts)
        for text, at in zip(texts, numbers):
            if at is not None:
                n = self.sizes.gather(at).reshape(-1, 2)
                if (n >= 0).all():
                    yield int(n[:, 0].sum()), int(n[:, 1].sum()), self.pairs.gather(at), ";".join(map(self.text.__getitem__, at.tolist()))
                    continue
            whole = self.align(text)
            yield None if whole is None else (len(whole.a), len(whole.b), whole.pairs, ";".join(whole.groups()))


def portions(texts: Iterable[str | None], chars: int = 1_000_000) -> Iterator[list[str | None]]:
    """Texts a few at a time, so that their words take little memory."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


@cache
def aligner(byte_vocabulary: str, piece_vocabulary: str) -> Aligner:
    """Loaded once in each worker."""
    return Aligner(byte_vocabulary, piece_vocabulary)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its length and type, compressed."""
    parts = [b"%c%c%c" % (x.dtype.kind.encode(), 48 + x.dtype.itemsize, 10) + len(x).to_bytes(8, "little") + x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        dtype, n = np.dtype(raw[at : at + 2].decode()), int.from_bytes(raw[at + 3 : at + 11], "little")
        out.append(np.frombuffer(raw, dtype, n, at + 11))
        at += 11 + n * dtype.itemsize
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences, which compress better; ``np.cumsum`` gives the values back."""
    return np.diff(values, prepend=values.dtype.type(0))


def least_type(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


class Spill:
    """Records of a task, cut into runs: (radix, run, base row, links per pair, links per pair and document)."""

    def __init__(self, task: int):
        self.task, self.number, self.records = task, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []

    def add(self, row: int, codes: np.ndarray) -> None:
        if len(codes):
            pairs, n = np.unique(codes, return_counts=True)
            self.parts.append((pairs, n, row))
            self.records += len(pairs)

    def runs(self) -> list[tuple[int, int, int, bytes, bytes]]:
        if not self.parts:
            return []
        base = self.parts[0][2]
        codes = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(codes, kind="stable")  # rows stay ascending within a pair
        codes = codes[order]
        rows = np.concatenate([np.full(len(p[0]), p[2] - base, np.int64) for p in self.parts])[order]
        n = np.concatenate([p[1] for p in self.parts])[order]
        bounds = np.searchsorted(codes, np.arange(RADIXES + 1).astype(object) << 2 * ID_BITS)
        out = []
        for radix, lo, hi in zip(range(RADIXES), bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            own = codes[lo:hi]
            first = np.flatnonzero(np.diff(own, prepend=own[:1] - np.uint64(1)))
            links = np.add.reduceat(n[lo:hi], first)
            docs = np.diff(np.append(first, hi - lo))
            counts = packed(steps(own[first]), least_type(links))
            out.append((radix, (self.task << 32) + self.number, base, counts, packed(least_type(docs), steps(rows[lo:hi].astype(np.uint32)), least_type(n[lo:hi]))))
        self.parts, self.records, self.number = [], 0, self.number + 1
        return out


ENCODED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "radix int, run long, base long, counts binary, records binary")
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``ENCODED``."""
    names, kinds = zip(*(c.split(" ") for c in ENCODED.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, ARROW[kind]) for x, kind in zip(columns, kinds)], list(names))


def encode(documents: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
           text_col: str = "text", key_col: str = "doc_id", spill_at: int = SPILL) -> DataFrame:
    """Rows of two kinds: documents (``radix`` NULL) with what needs no counts, and runs of their links.

    ``row`` names a document row within the stored result, so repeated rows and NULL ids stay apart.
    """

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, nth = aligner(byte_vocabulary, piece_vocabulary), TaskContext.get().partitionId(), 0
        spill = Spill(task)

        def aligned(texts: list[str | None]) -> Iterator[tuple | None]:
            for part in portions(texts):
                found = both.many([t for t in part if t])
                yield from (next(found) if t else None for t in part)

        for batch in batches:
            rows = []
            for key, found in zip(batch.column(0).to_pylist(), aligned(batch.column(1).to_pylist())):
                row = (task << 40) + nth
                nth += 1
                if found is None:
                    rows.append((row, key, 0, 0, 0, 0, "", *[None] * 5))
                    continue
                n_a, n_b, pairs, groups = found
                rows.append((row, key, n_a, n_b, len(pairs), len(pairs), hashlib.sha256(groups.encode()).hexdigest(), *[None] * 5))
                spill.add(row, pairs)
                if spill.records >= spill_at:
                    yield record_batch([(*[None] * 7, *run) for run in spill.runs()])
            yield record_batch(rows)
        yield record_batch([(*[None] * 7, *run) for run in spill.runs()])

    return documents.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(align, ENCODED)


def blocks(blob: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair codes, links) of a run in bounded pieces."""
    gaps, links = unpacked(blob)
    codes, links = np.cumsum(gaps, dtype=np.uint64), links.astype(np.int64)
    for at in range(0, len(codes), BLOCK):
        yield codes[at : at + BLOCK], links[at : at + BLOCK]


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of sorted runs, the links of equal pairs summed.

    The heap holds one block per run by its last code; all that is not above the least of them is
    complete, so it is merged and given out, and that run's next block takes its place.
    """
    heap: list[tuple[int, int]] = []
    now: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(k: int) -> None:
        block = next(runs[k], None)
        if block is None:
            now.pop(k, None)
        else:
            now[k] = block
            heapq.heappush(heap, (int(block[0][-1]), k))

    for k in range(len(runs)):
        take(k)
    while heap:
        limit, _ = heap[0]
        ready = []
        for k, (codes, links) in list(now.items()):
            cut = int(np.searchsorted(codes, np.uint64(limit), "right"))
            if cut:
                ready.append((codes[:cut], links[:cut]))
                now[k] = codes[cut:], links[cut:]
        while heap and heap[0][0] <= limit:
            take(heapq.heappop(heap)[1])
        codes = np.concatenate([c for c, _ in ready])
        order = np.argsort(codes, kind="stable")
        codes, links = codes[order], np.concatenate([n for _, n in ready])[order]
        first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - np.uint64(1)))
        yield codes[first], np.add.reduceat(links, first)


def one_run(blobs: Iterable[bytes]) -> bytes:
    parts = list(merged([blocks(b) for b in blobs]))
    return packed(steps(np.concatenate([c for c, _ in parts])), least_type(np.concatenate([n for _, n in parts])))


def counted(runs: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """(radix, run, counts): merged runs, about ``fan`` of them in a merge, level by level until a radix has no more.

    ``runs``: radix, run, counts; ``n_runs`` is the largest number of runs of a radix.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"radix": pdf["radix"].iloc[:1], "run": pdf["run"].iloc[:1], "counts": [one_run(pdf["counts"])]})

    level = 0
    while n_runs > fan:
        groups = -(-n_runs // fan)
        part = F.pmod(F.xxhash64("run", F.lit(level)), F.lit(groups))
        runs = stage(runs.groupBy("radix", part.alias("part")).applyInPandas(merge, "radix int, run long, counts binary"), "merged-runs")
        n_runs, level = groups, level + 1
    return runs


def totals(runs: DataFrame) -> DataFrame:
    """(radix, codes, links, best) in rows of at most about ``CHUNK`` pairs, from the last runs of each radix.

    Side-major order brings all pairs of a second id together: at most as many as there are first ids.
    ``best`` marks those with the id's highest count, ties included.
    """

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, held = [], [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(codes: np.ndarray, links: np.ndarray) -> None:
            first = np.flatnonzero(np.diff(second_id(codes), prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
            most = np.repeat(np.maximum.reduceat(links, first), np.diff(np.append(first, len(codes))))
            ready.append((codes, links, links == most))

        def flush() -> None:
            codes, links, best = (np.concatenate(x) for x in zip(*ready))
            rows.append((int(pdf["radix"].iloc[0]), packed(steps(codes), least_type(links), best)))
            ready.clear()

        for codes, links in merged([blocks(b) for b in pdf["counts"]]):
            codes, links = np.concatenate((held[0], codes)), np.concatenate((held[1], links))
            cut = int(np.searchsorted(second_id(codes), second_id(codes[-1:])[0]))  # the last id may go on
            if cut:
                settle(codes[:cut], links[:cut])
            held = [codes[cut:], links[cut:]]
            if sum(len(r[0]) for r in ready) >= CHUNK:
                flush()
        if len(held[0]):
            settle(*held)
        if ready:
            flush()
        return pd.DataFrame(rows, columns=["radix", "totals"])

    return runs.groupBy("radix").applyInPandas(last, "radix int, totals binary")


def contributions(runs: DataFrame, counts: DataFrame, n_runs: int, fan: int = FAN) -> DataFrame:
    """(row, n_best, count_sum) of the documents of each run; several rows per document.

    Runs of a radix are spread over groups of about ``fan``, each beside its own copy of the radix's
    counts; inside a group one run is read at a time.
    """
    groups = max(1, -(-n_runs // fan))

    def stream(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        chunks = []
        for blob in known["totals"]:
            gaps, links, best = unpacked(blob)
            chunks.append((np.cumsum(gaps, dtype=np.uint64), links, best))
        out = []
        for base, counts_blob, records in zip(pdf["base"], pdf["counts"], pdf["records"]):
            codes = np.cumsum(unpacked(counts_blob)[0], dtype=np.uint64)
            docs, gaps, n = unpacked(records)
            rows = np.cumsum(gaps, dtype=np.uint32)
            count, is_best = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
            for known_codes, links, best in chunks:
                at = np.searchsorted(known_codes, codes)
                hit = at < len(known_codes)
                hit[hit] = known_codes[at[hit]] == codes[hit]
                count[hit], is_best[hit] = links[at[hit]], best[at[hit]]
            n = n.astype(np.int64)
            best_sum, count_sum = np.zeros(int(rows.max()) + 1, np.int64), np.zeros(int(rows.max()) + 1, np.int64)
            np.add.at(best_sum, rows, n * np.repeat(is_best, docs))
            np.add.at(count_sum, rows, n * np.repeat(count, docs))
            held = np.flatnonzero(count_sum)
            out.append(pd.DataFrame({"row": base + held, "n_best": best_sum[held], "count_sum": count_sum[held]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "n_best": [], "count_sum": []}, dtype="int64")

    spread = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("part"), "base", "counts", "records")
    copies = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "totals")
    return spread.groupBy("radix", "part").cogroup(copies.groupBy("radix", "part")).applyInPandas(stream, "row long, n_best long, count_sum long")


def align_tokens(documents: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
                 text_col: str = "text", key_col: str = "doc_id", spill_at: int = SPILL, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per row of ``documents``.

    NULL and empty texts, and texts whose tokens do not spell a blank and the text (such as those
    that hold U+2581), have zeros and an empty digest and add no links. Texts are encoded whole,
    whatever their length; a task holds the links of ``spill_at`` records and a text. Ties for the highest count all count as best. Repeated rows count as
    often as they occur; an empty table gives no rows. Other columns are not read.
    """
    encoded = stage(encode(documents, byte_vocabulary, piece_vocabulary, text_col, key_col, spill_at), "aligned")
    runs = encoded.where(F.col("radix").isNotNull())
    sizes = runs.groupBy("radix").agg(F.count("*").alias("n")).agg(F.max("n")).first()
    n_runs = sizes[0] or 0
    counts = stage(totals(counted(runs.select("radix", "run", "counts"), n_runs, fan)), "pair-counts")
    sums = contributions(runs, counts, n_runs, fan).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (
        encoded.where(F.col("radix").isNull()).join(sums, "row", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
    )
