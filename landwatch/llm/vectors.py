"""Near duplicates of embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated so that the leading dimensions hold most of their
spread. The dot product of two vectors is that of their leading dimensions plus a rest no larger
than the product of their suffix norms, so a pair is given up as soon as the two cannot reach the
threshold. The same bound, taken over whole tiles, skips pairs of tiles. Tiles are blocks of the cells
of a k-d tree over the leading dimensions, of bounded size however many vectors there are; the
tree's cuts are set from a sample and only shape the work.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.llm.common import stage
from landwatch.llm.components import components
from landwatch.llm.groups import runs

#: Vectors of a block, cells of the tree at most (a cell has as many blocks as it needs), and blocks a task cuts at once.
TILE, MOST_CELLS, HELD_TILES = 2048, 4096, 4
#: Vectors the cuts of the k-d tree are set from.
SAMPLE = 20_000
#: Leading dimensions that place a vector in a tile.
LEADING = 8
SLACK = 1e-9


def usable(col: str) -> Column:
    """Whether a vector can be compared: not NULL, empty or zero, all components finite."""
    finite = F.forall(col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(col, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix whose columns are principal directions, largest spread first, over all vectors.

    Each task sums its outer products; ``dim`` ** 2 sums reach the driver.
    """

    def moments(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = unit(np.stack(pdf["v"]))
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(dim * dim), "s": total.ravel()})

    sums = vectors.select("v").mapInPandas(moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    m = np.zeros(dim * dim)
    for r in sums:
        m[r["at"]] = r["s"]
    m = m.reshape(dim, dim)
    return np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])


def keys_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Leading dimensions and the norm of the rest: closer in these than the vectors themselves are."""
    y = x @ q
    lead = y[:, :LEADING]
    return np.concatenate((lead, np.sqrt((y[:, LEADING:] ** 2).sum(1, keepdims=True))), 1)


class Cells:
    """Cuts of a k-d tree of ``depth`` levels, as one array of dimensions and one of places."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self._split(points, 1, depth)

    def _split(self, points: np.ndarray, node: int, depth: int) -> None:
        if not depth:
            return
        if len(points):
            d = int(np.ptp(points, axis=0).argmax())
            self.dim[node], self.cut[node] = d, np.median(points[:, d])
            low = points[:, d] < self.cut[node]
            self._split(points[low], 2 * node, depth - 1)
            self._split(points[~low], 2 * node + 1, depth - 1)

    def tile(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] >= self.cut[node])
        return node - (1 << self.depth)


def close_pairs(x: np.ndarray, y: np.ndarray, q: np.ndarray, threshold: float) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows with cosine at or above the threshold, a block of rows at a time.

    Leading dimensions are accumulated in growing steps; pairs whose bound falls short stop there.
    What is left is decided by the whole product in double precision.
    """
    a, b = x @ q, y @ q
    dim = q.shape[0]
    steps = [d for d in (16, 32) if d < dim]
    rest = {d: [np.sqrt((z[:, d:] ** 2).sum(1)) for z in (a, b)] for d in steps}
    for lo in range(0, len(a), 512):
        part = a[lo : lo + 512]
        if steps:
            d = steps[0]
            dot = part[:, :d] @ b[:, :d].T
            i, j = np.nonzero(dot >= threshold - SLACK - rest[d][0][lo : lo + 512, None] * rest[d][1])
            dot = dot[i, j]
        else:
            i, j = (m.ravel() for m in np.indices((len(part), len(b))))
            d, dot = 0, np.zeros(len(i))
        for end in [*steps[1:], dim]:
            far = []
            for at in range(0, len(i), 1 << 16):
                u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                far.append(np.einsum("ij,ij->i", part[u, d:end], b[v, d:end]))
            dot = dot + np.concatenate(far) if far else dot
            d = end
            least = threshold - SLACK - (rest[d][0][lo + i] * rest[d][1][j] if d < dim else 0.0)
            i, j, dot = i[dot >= least], j[dot >= least], dot[dot >= least]
        exact = np.concatenate([np.einsum("ij,ij->i", x[lo + i[at : at + (1 << 16)]], y[j[at : at + (1 << 16)]]) for at in range(0, len(i), 1 << 16)] or [np.zeros(0)])
        yield lo + i[exact >= threshold], j[exact >= threshold]


def spanning(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Joins in ``names`` (a label per row, changed in place) the rows linked by (i, j); returns the links that joined labels."""
    a, b = names[i], names[j]
    apart = a != b
    pairs, at = np.unique(np.stack((a[apart], b[apart]), 1), axis=0, return_index=True)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    i, j = i[apart][at].tolist(), j[apart][at].tolist()
    for (u, v), p, r in zip(pairs.tolist(), i, j):
        u, v = root(u), root(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((p, r))
    if parent:
        table = np.arange(len(names))
        for x in list(parent):
            table[x] = root(x)
        names[:] = table[names]
    return out


def _boxes(points: np.ndarray) -> list[float]:
    return [*points.min(0).tolist(), *points.max(0).tolist()]


def _apart(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Least squared distance between points of a box and of each other box (lows, then highs)."""
    k = len(box) // 2
    gap = np.maximum(0, np.maximum(box[:k] - others[:, k:], others[:, :k] - box[k:]))
    return (gap**2).sum(1)


BLOCK_ROW = "cell long, block long, box array<double>, id binary, n binary, v binary"


def cell_blocks(classes: DataFrame, cells: Cells, q: np.ndarray, kind: type) -> DataFrame:
    """The vectors of each cell as blocks of at most ``TILE``, each with its bounding box.

    A cell's rows are dealt over as many shares as its number asks for, so that one with most
    vectors is cut by many tasks; a task holds one share's last ``HELD_TILES`` tiles. Cuts go along the
    widest dimension, which keeps the boxes small.
    """

    def counts(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        total = np.zeros(1 << cells.depth, np.int64)
        for pdf in batches:
            if len(pdf):
                total += np.bincount(cells.tile(keys_of(unit(np.stack(pdf["v"])), q)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    sizes = np.zeros(1 << cells.depth, np.int64)
    for r in classes.select("v").mapInPandas(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # MOST_CELLS rows at most
        sizes[r["cell"]] = r["n"]
    shares = -(-sizes // (HELD_TILES * TILE))

    def fragments(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v, ids, ns = np.stack(pdf["v"]).astype(kind, copy=False), pdf["id"].to_numpy(), pdf["n"].to_numpy()
            cell = cells.tile(keys_of(unit(v), q))
            share = cell * (1 << 32) + (ids * 0x9E3779B1 >> 7) % shares[cell]
            order = np.argsort(share, kind="stable")
            bounds = runs(share[order])
            rows = [(int(share[own[0]]), *(np.ascontiguousarray(x[own]).tobytes() for x in (ids, ns, v))) for own in (order[a:b] for a, b in zip(bounds[:-1], bounds[1:]))]
            yield pd.DataFrame(rows, columns=["share", "id", "n", "v"])

    def cut(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40

        def blocks(share: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterable[tuple]:
            nonlocal number
            ids, ns, v = (np.concatenate(x) for x in zip(*parts))
            points = keys_of(unit(v), q)
            waiting = [np.arange(len(ids))]
            while waiting:
                own = waiting.pop()
                if len(own) > TILE:
                    d = int(np.ptp(points[own], axis=0).argmax())
                    own = own[np.argsort(points[own, d], kind="stable")]
                    waiting += [own[: len(own) // 2], own[len(own) // 2 :]]
                    continue
                yield (share >> 32, number, _boxes(points[own]), ids[own].tobytes(), ns[own].tobytes(), np.ascontiguousarray(v[own]).tobytes())
                number += 1

        names = [c.split(" ")[0] for c in BLOCK_ROW.split(", ")]
        last, held, size = None, [], 0
        for pdf in batches:
            for share, *blobs in pdf[["share", "id", "n", "v"]].itertuples(index=False, name=None):
                if held and (share != last or size >= HELD_TILES * TILE):
                    yield pd.DataFrame(list(blocks(last, held)), columns=names)
                    held, size = [], 0
                last = share
                ids, ns = (np.frombuffer(b, np.int64) for b in blobs[:2])
                held.append((ids, ns, np.frombuffer(blobs[2], kind).reshape(len(ids), -1)))
                size += len(ids)
        if held:
            yield pd.DataFrame(list(blocks(last, held)), columns=names)

    dealt = classes.select("id", "n", "v").mapInPandas(fragments, "share long, id binary, n binary, v binary")
    return stage(dealt.repartition("share").sortWithinPartitions("share").mapInPandas(cut, BLOCK_ROW), "vector-blocks")


def block_pairs(blocks: DataFrame, threshold: float, k: int = LEADING + 1) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks whose boxes are near enough to hold a link, found in Spark.

    ``k``: numbers that place a vector. The boxes of the cells, of which there are at most ``MOST_CELLS``, are compared by the tasks of a
    small table of cells; blocks then meet along the pairs of cells, as boxes without vectors.
    """
    most = 2 - 2 * threshold + SLACK  # squared distance of unit vectors at the threshold
    ends = [(F.min if e < k else F.max)(F.get("box", F.lit(e))).alias(f"e{e}") for e in range(2 * k)]
    table = blocks.groupBy("cell").agg(*ends).orderBy("cell").toArrow()  # MOST_CELLS rows at most
    cell = table["cell"].to_numpy()
    boxes = np.stack([table[f"e{e}"].to_numpy() for e in range(2 * k)], 1) if len(cell) else np.zeros((0, 2 * k))

    def near(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for at in pdf["id"]:
                other = at + np.flatnonzero(_apart(boxes[at], boxes[at:]) <= most)
                yield pd.DataFrame({"s": cell[at], "t": cell[other]})

    cells = blocks.sparkSession.range(len(cell)).mapInPandas(near, "s long, t long")
    light = blocks.select("cell", "block", "box")
    met = cells.join(light.select(F.col("cell").alias("s"), F.col("block").alias("a"), F.col("box").alias("x")), "s").join(
        light.select(F.col("cell").alias("t"), F.col("block").alias("b"), F.col("box").alias("y")), "t"
    ).where((F.col("s") < F.col("t")) | (F.col("a") <= F.col("b")))
    gaps = [F.greatest(F.lit(0.0), F.get("x", F.lit(i)) - F.get("y", F.lit(i + k)), F.get("y", F.lit(i)) - F.get("x", F.lit(i + k))) for i in range(k)]
    return met.where(sum((g * g for g in gaps), F.lit(0.0)) <= most).select("a", "b")


def tile_links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Compare all pairs of blocks that may hold a link; each pair is one row and two blocks of at most ``TILE`` vectors.

    Returns (kind, a, b): kind 0: class a is linked to b vectors of other classes; kind 1: a and b are linked, enough for components."""
    n = classes.count()
    q = rotation(classes, dim)
    share = min(1.0, SAMPLE / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)).select("v").collect()
    points = keys_of(unit(np.array([r["v"] for r in drawn])), q) if drawn else np.zeros((0, LEADING + 1))
    cells = Cells(points, int(np.ceil(np.log2(min(MOST_CELLS, max(1, n // TILE))))))
    kind = np.float32 if dict(classes.dtypes)["v"] == "array<float>" else np.float64
    blocks = cell_blocks(classes, cells, q, kind)

    def compare(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            for a, b, *blobs in pdf[["a", "b", "id", "n", "v", "id2", "n2", "v2"]].itertuples(index=False, name=None):
                same = a == b
                sides = [blobs[:3]] if same else [blobs[:3], blobs[3:]]
                ids, ns = (np.concatenate([np.frombuffer(s[c], np.int64) for s in sides]) for c in (0, 1))
                x = unit(np.concatenate([np.frombuffer(s[2], kind).reshape(-1, dim) for s in sides]))
                cut = len(sides[0][0]) // 8
                left, right = x[:cut], x if same else x[cut:]
                shift = 0 if same else cut
                linked, names, found = np.zeros(len(x), np.int64), np.arange(len(x)), []
                for i, j in close_pairs(left, right, q, threshold):
                    keep = i < j if same else slice(None)
                    i, j = i[keep], j[keep] + shift
                    linked += np.bincount(i, ns[j], len(x)).astype(np.int64) + np.bincount(j, ns[i], len(x)).astype(np.int64)
                    found += spanning(names, i, j)
                at = np.flatnonzero(linked)
                if len(at):
                    ends = np.array(found, np.int64).reshape(-1, 2)
                    yield pd.DataFrame({
                        "kind": np.repeat(np.array([0, 1], np.int32), [len(at), len(ends)]),
                        "a": np.concatenate((ids[at], ids[ends[:, 0]])), "b": np.concatenate((linked[at], ids[ends[:, 1]])),
                    })

    whole = blocks.select(F.col("block").alias("a"), "id", "n", "v")
    other = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("id", "n", "v")])
    pairs = stage(block_pairs(blocks, threshold, points.shape[1] if len(points) else min(dim, LEADING) + 1), "block-pairs")
    return pairs.join(whole, "a").join(other, "b").mapInPandas(compare, "kind int, a long, b long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, vector_col: str = "embedding", key_col: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector; links have cosine >= ``threshold`` (above 0) in double precision.

    Vectors that are NULL, empty, zero or hold a NULL or non-finite component link with nothing,
    nor do vectors of different lengths link. Equal vectors are compared once, by their smallest
    id, and counted with their number; links between classes become counts and a spanning forest
    in each pair of blocks, so a group of near copies never turns into a list of its pairs. Two
    blocks are compared at a time. A vector with a NULL id is compared with none. Repeated rows count
    as vectors of their own. A cosine equal to the threshold links. An empty table gives no rows,
    and columns of other names are not read.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    rows = embeddings.select(F.col(key_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    valid = rows.where(usable("v") & F.col("vec_id").isNotNull())
    classes = stage(valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    links = None
    for dim in sorted(dims):
        part = tile_links(classes.where(F.size("v") == dim), dim, threshold)
        links = part if links is None else links.union(part)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = stage(links, "vector-links")
    degree = links.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("linked"))
    found = components(links.where("kind = 1"))
    named = stage(
        classes.join(degree, "id", "left").join(found, "id", "left")
        .select("v", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"), F.coalesce("component", "id").alias("component")),
        "vector-components",
    )
    member = usable("v") & F.col("vec_id").isNotNull()
    alone = rows.where(~member).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where(member).join(named, "v").select("vec_id", F.col("linked").alias("n_links"), F.col("component").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
