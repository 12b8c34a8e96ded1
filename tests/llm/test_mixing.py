import random

import numpy as np
import pytest

from landwatch.llm import mixing as M


def tables(spark, docs_of, n=600):
    rng = random.Random(6)
    kinds = {"a": ["red", "blue", "sky"], "b": ["cat", "dog", "cow"], "c": ["up", "down", "left"]}
    rows = [(i, " ".join(rng.choices(kinds["aaaaabbbcc"[i % 10]], k=rng.randint(5, 40)))) for i in range(n)]
    labels = spark.createDataFrame([(i, "aaaaabbbcc"[i % 10]) for i in range(0, n, 2)] + [(i, "aaaaabbbcc"[i % 10]) for i in range(1, n, 6)], "doc_id long, domain string")
    return docs_of(rows), labels


def test_targets_are_met(spark, docs_of):
    docs, labels = tables(spark, docs_of)
    got = M.rates(docs, labels, "domain", {"a": 0.2, "b": 0.3, "c": 0.5}).collect()
    tokens = np.array([r["n_tokens"] for r in got], float)
    p = np.array([[r["p_a"], r["p_b"], r["p_c"]] for r in got])
    rate = np.array([r["rate"] for r in got])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.allclose((tokens * rate) @ p / tokens.sum(), [0.2, 0.3, 0.5], atol=0.01)
    copies = np.array([r["n_copies"] for r in got])
    assert (np.abs(copies - rate) < 1).all() and abs((copies * tokens).sum() / tokens.sum() - 1) < 0.15


def test_rates_are_the_least_squares_solution(spark):
    """Soft memberships and a target that cannot be met, against a long plain descent in numpy."""
    rng = np.random.default_rng(0)
    q = rng.integers(1, 40, (30, 3))
    tokens = rng.integers(1, 500, 30)
    cells = spark.createDataFrame([([int(x) for x in r], int(r.sum()), int(t)) for r, t in zip(q, tokens)], "q array<int>, q_sum int, tokens long")
    want, penalty = np.array([0.9, 0.05, 0.05]), 1e-2
    rate = M.solve(cells, list(want), penalty, max_steps=30)
    got = np.array([r["r"] for r in cells.select(rate.alias("r")).collect()])
    p, w = q / q.sum(1, keepdims=True), tokens / tokens.sum()
    share = w @ p
    r = np.ones(30)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (p @ ((w * r) @ p / share - want / share) + penalty * (r - 1)))
    cost = lambda x: 0.5 * (((w * x) @ p - want) ** 2 / share).sum() + 0.5 * penalty * (w * (x - 1) ** 2).sum()
    assert cost(got) <= cost(r) * 1.1 + 1e-3 and (got >= 0).all()


@pytest.mark.parametrize(("seed", "penalty", "max_rate"), [(1, 1e-3, None), (2, 1e-4, None), (3, 1e-3, 1.7)])
def test_optimum_at_other_cells(spark, seed, penalty, max_rate):
    """Exact masses beside rounded posteriors, and a cap, against accelerated descent in numpy."""
    rng = np.random.default_rng(seed)
    q, tokens = rng.integers(1, 40, (40, 3)), rng.integers(1, 500, 40)
    p = (q / q.sum(1, keepdims=True) + 0.01) / 1.03
    rows = [([int(x) for x in a], int(t), [float(y) for y in b * t]) for a, t, b in zip(q, tokens, p)]
    cells = spark.createDataFrame(rows, "q array<int>, tokens long, mass array<double>")
    want = np.array([0.7, 0.2, 0.1])
    found = M.least_squares(cells, list(want), penalty, max_rate=max_rate)
    got = np.array([r["r"] for r in cells.select(found.rate(M.membership(cells, 3)).alias("r")).collect()])
    w = tokens / tokens.sum()
    share = w @ p
    r = y = np.ones(40)
    for k in range(30_000):
        new = np.clip(y - 0.5 * (p @ ((w * y) @ p / share - want / share) + penalty * (y - 1)), 0, max_rate)
        y, r = new + k / (k + 3) * (new - r), new
    cost = lambda x: 0.5 * (((w * x) @ p - want) ** 2 / share).sum() + 0.5 * penalty * (w * (x - 1) ** 2).sum()
    assert cost(got) <= cost(r) + 1e-9 and found.distance <= 1e-9 and (got >= 0).all()
    reached = (w * got) @ p
    assert np.allclose(found.reached, reached) and np.isclose(found.missed, np.abs(reached - want).max())
    assert np.isclose(found.largest_rate, got.max()) and (max_rate is None or got.max() <= max_rate)


def test_small_memberships_count(spark, docs_of):
    """The totals met are those of the posteriors themselves, not of their roundings."""
    docs, labels = tables(spark, docs_of)
    got = M.rates(docs, labels, "domain", {"a": 0.98, "b": 0.015, "c": 0.005}).collect()
    tokens = np.array([r["n_tokens"] for r in got], float)
    p, rate = np.array([[r["p_a"], r["p_b"], r["p_c"]] for r in got]), np.array([r["rate"] for r in got])
    missed = np.abs((tokens * rate) @ p / tokens.sum() - [0.98, 0.015, 0.005]).max()
    assert np.isclose(missed, got[0]["target_distance"], atol=1e-6) and missed < 0.002
    assert np.isclose(got[0]["largest_rate"], rate.max())


def test_long_text_and_repeated_rows(spark, docs_of):
    docs, labels = tables(spark, docs_of, 120)
    odd = docs_of([(900, "cat dog " * 60_000), (901, "cat"), (901, "cat")])
    got = {}
    for r in M.rates(docs.union(odd), labels, "domain", {"a": 0.5, "b": 0.3, "c": 0.2}).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    assert got[900][0][1] == 120_000 and len(got[901]) == 2 and got[901][0] == got[901][1]


def test_mix_keeps_columns_and_odd_rows(spark, docs_of):
    docs, labels = tables(spark, docs_of, 60)
    odd = docs_of([(900, None), (901, ""), (None, "cat dog"), (902, "cat"), (902, "cat")])
    out = M.mix(docs.union(odd), labels, "domain", {"a": 0.5, "b": 0.3, "c": 0.2})
    assert out.columns == docs.columns and out.count() > 0
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert M.mix(docs, none, "domain", {}).count() == 60
    assert M.mix(docs_of([]), labels, "domain", {"a": 1.0}).collect() == []
    assert M.rates(docs_of([]), none, "domain", {}).collect() == []
