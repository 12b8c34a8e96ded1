import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landwatch.llm import packing as P


def padding(counts, widths):
    return sum(c * (min(w for w in widths if w >= n) - n) for n, c in enumerate(counts) if c)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    counts = np.array([rng.choice([0, 0, 1, 2, 9]) for _ in range(12)])
    lengths = [n for n in range(1, 12) if counts[n] or n == 1 and counts[0]]
    for k in (1, 2, 3, 20):
        widths = P.best_boundaries(counts, k)
        assert len(widths) <= k
        if lengths:
            best = min(padding(counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
            assert padding(counts, widths) == best


def test_every_segment_has_one_slot(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 30, 31, 200]))) for i in range(400)] + [(400, None), (401, ""), (402, "a b"), (402, "a b"), (None, "x")]
    out = P.pack(P.stored_segments(docs_of(rows), P.word_count(), 64), 64, n_buckets=3, budget=256).collect()
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["n_tokens"] <= r["width"] <= 64 and r["slot"] < 256 // r["width"]
    assert total == {**{i: len((t or "").split()) for i, t in rows}, 402: 4}
    assert len(out) == sum(max(1, -(-len((t or "").split()) // 64)) for _, t in rows)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in out}) == len(out)
    for bucket in {r["bucket"] for r in out}:
        own = [r for r in out if r["bucket"] == bucket]
        each = 256 // own[0]["width"]
        assert sorted(r["batch"] * each + r["slot"] for r in own) == list(range(len(own)))


def test_empty_table_and_small_budget(spark, docs_of):
    pieces = P.stored_segments(docs_of([]), P.word_count(), 64)
    assert P.pack(pieces, 64).collect() == []
    with pytest.raises(ValueError):
        P.pack(pieces, 64, budget=63)


def test_rows_of_one_id_spread_over_the_shards(spark, docs_of):
    """Rows without an id, or all with one, are numbered by many tasks, and each has its own slot."""
    for key in (None, 7):
        pieces = P.stored_segments(docs_of([(key, "a b c")] * 6000).repartition(6), P.word_count(), 64)
        order = F.xxhash64("doc_id", "segment", "row")
        shards = pieces.groupBy(F.pmod(order, F.lit(512)).alias("s")).count().agg(F.count("*"), F.max("count")).first()
        assert shards[0] > 400 and shards[1] < 60
        out = P.pack(pieces, 64, budget=256).collect()
        assert len(out) == 6000 and len({(r["batch"], r["slot"]) for r in out}) == 6000


def test_a_very_long_text_and_columns_of_the_same_names(spark, docs_of):
    docs = docs_of([(1, "w " * 300_000), (2, "w")]).withColumn("segment", F.lit("x")).withColumn("bucket", F.lit("y")).withColumn("row", F.lit(0))
    out = P.pack(P.stored_segments(docs, P.word_count(), 2048), 2048).collect()
    assert sum(r["n_tokens"] for r in out if r["doc_id"] == 1) == 300_000 and len(out) == 147 + 1
