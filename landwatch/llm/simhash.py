"""SimHash near duplicates by vantage-point trees.

The fingerprints' 32-bit halves are indexed apart: two fingerprints that differ in at most 3 bits
differ in at most 1 bit of some half. Over each half stands a tree whose levels are fixed vantage
points and whose branches are Hamming distances to them. By the triangle bound a half one bit
away lies in the neighbouring branch at every level, so a fingerprint can only meet its partners
in its own leaf and in the leaves of its one-bit neighbours: it is sent to those boundary leaves
(at most 32, whatever the corpus) and all others are pruned. Leaves are dealt over the cluster,
compared exactly, and each gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage
from landwatch.llm.components import components
from landwatch.llm.groups import sorted_groups

SEED = 42
#: 32-bit vantage points, from a fixed generator; a tree uses as many as it needs levels.
VANTAGE = np.random.default_rng(2024).integers(0, 1 << 32, 8, dtype=np.uint64)
#: Fingerprints of one half a leaf should hold.
LEAF = 512
#: Shingles hashed at once: bounds the memory of a very long text.
CHUNK = 1 << 16
NEVER = 255


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> Iterable[np.ndarray]:
    """XXH64 of the space-joined ``k``-word shingles, in chunks; fewer words: the whole sequence; none: nothing."""
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    starts, ends = starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[lo : lo + CHUNK], ends[lo : lo + CHUNK])], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """64 bits, each set where more than half of the hashes have it; no hash: 0."""
    total, n = np.zeros(64, np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):
            total += bits[lo : lo + 255].sum(0, dtype=np.uint8)
        n += len(h)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(shingle_words: int = 3) -> Callable[[Column], Column]:
    """Column function ``text -> long``: the 64-bit SimHash of the text's word shingles."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(majority(shingle_hashes(words_of(t), shingle_words))) for t in texts], dtype="int64")

    return simhash


def leaf_keys(half: np.ndarray, levels: int) -> np.ndarray:
    """Path of each 32-bit half through the tree: its distances to the vantage points, as one number."""
    key = np.zeros(half.shape, np.int64)
    for v in VANTAGE[:levels]:
        key = key * 40 + np.bitwise_count(half ^ v).astype(np.int64)
    return key


def visits(half: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every boundary leaf a half must be looked up in.

    Halves one bit apart have bit counts of different parity, so only the even one goes visiting.
    """
    even = np.flatnonzero(np.bitwise_count(half) % 2 == 0)
    keys = leaf_keys(half[even, None] ^ (np.uint64(1) << np.arange(32, dtype=np.uint64)), levels)
    keys.sort(axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    at = np.nonzero(new)
    return even[at[0]], keys[at]


def levels_for(n: int) -> int:
    """Levels at which an average leaf holds about ``LEAF`` of ``n`` halves: a level has some 12 branches in use."""
    return min(len(VANTAGE), max(1, math.ceil(math.log(max(n, 2) / LEAF + 1) / math.log(11.7))))


def forest(own: dict[str, np.ndarray], guests: dict[str, np.ndarray], distance, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest of the links in a leaf, closest pairs first (Boruvka's rounds, a block of rows at a time).

    ``distance(a, b)``: matrix of numbers up to 255 between rows of a and of b. Rows are the leaf's
    own followed by its guests; a link joins any row with one of the leaf's own. Returns row, row, distance.
    """
    rows = {c: np.concatenate((own[c], guests[c])) for c in own}
    n_own, n = len(next(iter(own.values()))), len(next(iter(rows.values())))
    block = max(1, (1 << 21) // n_own)
    comp, active = np.arange(n), np.arange(n)
    out_i, out_j, out_d = [], [], []
    while len(active):
        best, near = np.full(len(active), NEVER, np.int64), np.zeros(len(active), np.int64)
        for lo in range(0, len(active), block):
            part = active[lo : lo + block]
            d = distance({c: x[part] for c, x in rows.items()}, own)
            d[comp[part][:, None] == comp[:n_own]] = NEVER
            k = d.argmin(1)
            best[lo : lo + block], near[lo : lo + block] = d[np.arange(len(part)), k], k
        linked = best <= most
        if not linked.any():
            break
        active, best, near = active[linked], best[linked], near[linked]  # rows without a link left have none later
        order = np.lexsort((near, active, best))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        done: set[int] = set()
        for i, j, d, c in zip(active[order].tolist(), near[order].tolist(), best[order].tolist(), comp[active[order]].tolist()):
            if c in done:
                continue
            done.add(c)
            a, b = root(c), root(int(comp[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out_i.append(i)
                out_j.append(j)
                out_d.append(d)
        names = np.arange(n)
        for x in list(parent):
            names[x] = root(x)
        comp = names[comp]
    return np.array(out_i, np.int64), np.array(out_j, np.int64), np.array(out_d, np.int64)


def _leaf_rows(codes: DataFrame, index: list[str], carried: list[str], levels: int) -> DataFrame:
    """(leaf, guest, id, code, carried...) for both halves of every index fingerprint of every row."""
    schema = "leaf long, guest boolean, id long, code long" + "".join(f", {c} long" for c in carried)

    def deal(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for at, name in enumerate(index):
                code = pdf[name].to_numpy(np.int64).view(np.uint64)
                for side, half in enumerate((code & np.uint64(0xFFFFFFFF), code >> np.uint64(32))):
                    tree = (2 * at + side) * 40 ** len(VANTAGE)
                    row, leaf = visits(half, levels)
                    rows = np.concatenate((np.arange(len(half)), row))
                    leaves = np.concatenate((leaf_keys(half, levels), leaf)) + tree
                    yield pd.DataFrame({
                        "leaf": leaves, "guest": np.arange(len(rows)) >= len(half), "id": pdf["id"].to_numpy()[rows],
                        "code": code.view(np.int64)[rows], **{c: pdf[c].to_numpy()[rows] for c in carried},
                    })

    return codes.select("id", *index, *carried).mapInPandas(deal, schema)


def tree_links(codes: DataFrame, index: list[str], distance, most: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Links (a, b, d) between rows of ``codes`` (id, index fingerprints and carried columns, all long).

    ``distance`` gets dicts of uint64 columns (code and carried). Every pair within ``most`` that
    is at most one bit apart in some half of an index fingerprint is linked, directly or over
    other links of the same leaf. A leaf is compared in blocks of bounded memory; rows are
    numbers only.
    """
    levels = levels_for(codes.count())
    names = ["code", *carried]

    def compare(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        found: list[np.ndarray] = []
        for g in sorted_groups(batches, "leaf"):
            guest = g["guest"]
            if len(guest) < 2 or guest.all():
                continue
            order = np.argsort(guest, kind="stable")
            n_own = int(len(guest) - guest.sum())
            cols = {c: g[c].astype(np.int64).view(np.uint64)[order] for c in names}
            i, j, d = forest({c: x[:n_own] for c, x in cols.items()}, {c: x[n_own:] for c, x in cols.items()}, distance, most)
            if len(i):
                ids = g["id"][order]
                found.append(np.stack((ids[i], ids[j], d)))
            if len(found) >= 1000:
                yield pd.DataFrame(np.concatenate(found, 1).T, columns=["a", "b", "d"])
                found = []
        if found:
            yield pd.DataFrame(np.concatenate(found, 1).T, columns=["a", "b", "d"])

    rows = _leaf_rows(codes, index, list(carried), levels)
    return rows.repartition("leaf").sortWithinPartitions("leaf").mapInPandas(compare, "a long, b long, d long")


def within_bits(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    return np.bitwise_count(a["code"][:, None] ^ b["code"])


def simhash_groups(documents: DataFrame, shingle_words: int = 3, max_bits: int = 3, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row; fingerprints link at ``max_bits`` (3 at most) or fewer.

    Equal fingerprints are one class and enter the trees once, by their smallest doc_id, however
    many rows share them. NULL, empty and blank texts have fingerprint zero and link like any
    other. A NULL doc_id gets the class of its fingerprint. Repeated rows are kept. Long texts are
    hashed whole, in chunks; a bit set in exactly half of the hashes is 0. An empty table gives no rows.
    """
    if max_bits > 3:
        raise ValueError("halves one bit apart find pairs of at most 3 differing bits")
    prints = stage(documents.select(F.col(key_col).cast("long").alias("doc_id"), fingerprint(shingle_words)(F.col(text_col)).alias("code")), "fingerprints")
    classes = stage(prints.groupBy("code").agg(F.min("doc_id").alias("id")), "classes")
    found = components(tree_links(classes.where("id IS NOT NULL"), ["code"], within_bits, max_bits))
    named = stage(classes.join(found, "id", "left").select("code", F.coalesce("component", "id").alias("component_id")), "components")
    hexed = F.lpad(F.lower(F.hex("code")), 16, "0")
    return prints.join(named, "code").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Texts whose shingles tell frequent from rare (so many, and a twelfth of a large corpus), and the most frequent ones
#: kept: they shape the work, not the result.
SAMPLE, SAMPLED_SHARE, FREQUENT = 4096, 12, 1 << 18
#: Compared pairs for each row left, above which links to one text of each group are tried before all pairs, as long as
#: a turn of them leaves at most this share of the pairs.
PAIRS, PROGRESS = 20, 0.5
#: Bits of the fixed-size table that tells shingles of several texts from most others.
MARKS = 26
#: Shingles of the rows given to Spark at once.
BLOCK = 1 << 17
PREFIXES = "id long, digest long, digest2 long, code long, n int, tokens array<long>"


def shingles_of(words: list[bytes], k: int) -> np.ndarray:
    return np.unique(np.concatenate(list(shingle_hashes(words, k))))


def fewest(n: np.ndarray, similarity: float) -> np.ndarray:
    """The fewest common shingles of a set of ``n`` and a set as similar as ``similarity``; rounding only ever lowers it."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles that decide: the first of the set in the global order from rare to frequent.

    Of two similar sets, one lacks at most n - ``fewest`` of the other's n shingles, so among one
    more than that, taken from the front, both hold the first shingle they share. Any order that is the same for all sets will do.
    """
    order = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        order = np.where(frequent[at] == shingles, rank[at], 0)
    return shingles[np.lexsort((shingles, order))][: len(shingles) - int(fewest(np.int64(len(shingles)), similarity)) + 1]


def _frequent(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of texts in order of their number, and how often each occurs there."""

    def sampled(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["text"]:
                words = words_of(t)
                if words:
                    yield pd.DataFrame({"token": shingles_of(words, k).view(np.int64)})

    spread = F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1 << 32))
    share = max(SAMPLE / max(1, rows.count()), 1 / SAMPLED_SHARE)
    some = rows.where(spread < share * (1 << 32)).mapInPandas(sampled, "token long")
    counts = some.groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token = counts["token"].to_numpy().view(np.uint64)
    by_token = np.argsort(token)
    return token[by_token], counts["n"].to_numpy()[by_token]


def prefixes(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """The SimHash and the prefix shingles, from rare to frequent, of every text with a word; digests name the word sequence."""
    frequent, rank = _frequent(rows, k)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: list[tuple] = []
        size, names = 0, [c.split(" ")[0] for c in PREFIXES.split(", ")]
        for pdf in batches:
            for doc, t in zip(pdf["doc_id"], pdf["text"]):
                words = words_of(t)
                if not words:
                    continue
                joined = xxhash.xxh128_intdigest(b" ".join(words))
                hashes = list(shingle_hashes(words, k))
                shingles = np.unique(np.concatenate(hashes))
                first = prefix(shingles, frequent, rank, similarity)
                code = signed(majority(hashes))
                held.append((doc, signed(joined & ((1 << 64) - 1)), signed(joined >> 64), code, len(shingles), first.view(np.int64)))
                size += len(first)
                if size >= BLOCK:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return rows.mapInPandas(cut, PREFIXES)


def _shared(classes: DataFrame) -> DataFrame:
    """(token, id, n, pos) of the prefix shingles that several classes have.

    Most shingles have one class only. A table of bits, whose size is fixed, drops most of those
    before anything but the shingles' counts is moved; the rest go in an exact join.
    """
    often = stage(classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "shared-shingles")
    place = F.pmod("token", F.lit(1 << MARKS))
    table = often.select((place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b"))
    table = table.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2 ** (MARKS - 6) rows at most
    marks = np.zeros(1 << (MARKS - 6), np.int64)
    marks[table["w"].to_numpy()] = table["b"].to_numpy()

    def marked(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        bits = marks.view(np.uint64)
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = np.array([len(t) for t in pdf["tokens"]])
            token = np.concatenate([np.asarray(t, np.int64) for t in pdf["tokens"]])
            at = token & ((1 << MARKS) - 1)
            keep = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pd.DataFrame({
                "token": token[keep], "id": np.repeat(pdf["id"].to_numpy(), sizes)[keep], "n": np.repeat(pdf["n"].to_numpy(), sizes)[keep],
                "pos": (np.arange(len(token)) - starts)[keep].astype(np.int32),
            })

    rows = classes.select("id", "n", "tokens").mapInPandas(marked, "token long, id long, n int, pos int")
    return rows.join(often, "token", "left_semi").distinct()


def _may_be_similar(similarity: float) -> Column:
    """Whether x and y can still be similar if the shingle they share here is their first: sizes, and shingles left from there on."""
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    near = (F.col("y.n") >= similarity * F.col("x.n") - 1e-6) & (F.col("x.n") >= similarity * F.col("y.n") - 1e-6)
    return near & (left >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6)


def similar_pairs(edges: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts' sets of ``k``-word shingles have at least the Jaccard ``similarity``, read in full."""

    def shingles(packed: bytes) -> np.ndarray:
        return shingles_of(zstandard.ZstdDecompressor().decompress(packed).split(), k)

    def compare(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        last, v = None, None
        for pdf in batches:
            keep = []
            for b, x, y in zip(pdf["b"], pdf["x"], pdf["y"]):
                if b != last:
                    last, v = b, shingles(y)
                u = shingles(x)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    x = texts.select(F.col("id").alias("a"), F.col("packed").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    return edges.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


def fingerprint_pairs(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b) of classes (id, code) that are near by fingerprint: each class with the smallest of its own
    fingerprint, and the links of the vantage-point trees between the fingerprints."""
    least = stage(classes.groupBy("code").agg(F.min("id").alias("id")), "fingerprint-classes")
    same = classes.join(least.withColumnRenamed("id", "first"), "code").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    trees = tree_links(least, ["code"], within_bits, max_bits)
    return same.union(trees.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def _joined(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``x`` and ``y`` that agree on the columns, as x and y."""
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    return x.alias("x").join(y.alias("y"), same)


def _open(held: DataFrame, found: DataFrame) -> DataFrame:
    """The prefix rows with their present component c, of the shingles that still stand in two components."""
    now = held.join(found, "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    shared = now.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    return stage(now.join(shared, "token"), "open-prefixes")


def similar_groups(documents: DataFrame, similarity: float = 0.8, shingle_words: int = 5, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) of the documents that are not the smallest doc_id of their group.

    Two texts are similar if their sets of ``shingle_words``-word shingles (A-Z lower-cased) have
    a Jaccard similarity of at least ``similarity``. Every link is checked on the whole texts
    before it joins anything: first those of the SimHash trees (``simhash_groups``) over the same
    shingles. At 0.8 fingerprints lose pairs, so an exact search follows for what the trees left
    apart. Similar texts share a shingle of their prefixes, so it loses no pair: links to one text
    of each shingle and size, then all pairs that share a prefix shingle, may be similar by size
    and place, and are in two components still. Equal word
    sequences are one class. Texts without a word, and rows with a NULL doc_id, are in no group;
    rows repeated under one doc_id are one document.
    """

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=1)
        return pd.Series([z.compress(b" ".join(words_of(t))) for t in texts])

    rows = documents.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stage(prefixes(rows, shingle_words, similarity), "prefixes")
    named_rows = every.select(F.col("id").alias("doc_id"), "digest", "digest2")
    one = F.min_by(F.struct("id", "code", "n", "tokens"), "id").alias("one")
    whole = stage(every.groupBy("digest", "digest2").agg(one).select("digest", "digest2", "one.*"), "classes")
    classes = whole.select("digest", "digest2", "id")
    held = stage(_shared(whole), "shared-prefixes")
    ends = held.select(F.col("id").alias("doc_id")).distinct()
    texts = stage(rows.select("doc_id", pack("text").alias("packed")).join(ends, "doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.first("packed").alias("packed")), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return stage(similar_pairs(stage(pairs.distinct(), f"{name}-pairs"), texts, shingle_words, similarity), f"{name}-links")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        return verified(pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")), name)

    # A class that shares no prefix shingle has no similar text, whatever its fingerprint: its text is not kept.
    links = verified(fingerprint_pairs(whole.select("id", "code")), "tree")
    found = stage(components(links), "found")
    near = _may_be_similar(similarity)
    size = F.floor(F.log("n") / -math.log(similarity)) if similarity < 1 else F.col("n")
    still, before = _open(held, found), float("inf")
    for turn in range(8):
        per = still.groupBy("token", "c").agg(F.count("*").cast("double").alias("m")).groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
        n, pairs = per.agg(F.sum("m"), F.sum(F.col("m") * F.col("m") - F.col("own")) / 2).first()
        if turn and (not n or pairs <= PAIRS * n or pairs > PROGRESS * before):
            break
        before = pairs
        sized = still.withColumn("size", size)
        # Another text each turn, so that what is far from one can be near the next.
        one = F.min_by(F.struct("id", "n", "pos", "c"), F.xxhash64("c", F.lit(turn)) if turn else F.col("id"))
        star = sized.groupBy("token", "size").agg(one.alias("y")).select("token", "size", "y.*")
        new = checked(_joined(sized, star, ["token", "size"]).where(F.col("x.c") != F.col("y.c")).where(near), "star")
        if new.isEmpty():
            break
        links = links.union(new)
        found = stage(components(links), "found")
        still = _open(held, found)
    pairs = _joined(still, still, ["token"]).where(F.col("x.c") != F.col("y.c")).where(near).where("x.n > y.n OR x.n = y.n AND x.id > y.id")
    found = components(links.union(checked(pairs, "all")))
    named = stage(classes.join(found, "id", "left").select("digest", "digest2", F.coalesce("component", "id").alias("component_id")), "components")
    return named_rows.join(named, ["digest", "digest2"]).where(F.col("doc_id") != F.col("component_id")).select("doc_id", "component_id")


def drop_similar(documents: DataFrame, similarity: float = 0.8, shingle_words: int = 5, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """``documents`` with one document of each group of similar texts, the one with the smallest doc_id; columns stay."""
    gone = stage(similar_groups(documents, similarity, shingle_words, text_col, key_col).select("doc_id").distinct(), "similar")
    return documents.join(gone, documents[key_col].cast("long") == gone["doc_id"], "left_anti")
