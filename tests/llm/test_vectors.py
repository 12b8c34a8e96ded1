import numpy as np
import pytest

import landwatch.llm.vectors as V


def brute(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    name = {i: i for i, _ in rows}
    pairs = []
    for p, (i, x) in enumerate(good):
        for j, y in good[p + 1 :]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    for _ in rows:
        for i, j in pairs:
            name[i] = name[j] = min(name[i], name[j])
    return {i: (links[i], name[i], name[i] == i) for i, _ in rows}


@pytest.mark.parametrize("tile", [2048, 8])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(40, 40))
    vecs = [base[rng.integers(40)] + rng.normal(scale=rng.choice([0.0, 0.1, 0.22, 0.4]), size=40) for _ in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    rows += [(200, None), (201, []), (202, [0.0] * 40), (203, [1.0] * 39 + [float("nan")]), (204, [1.0] * 39 + [None]), (205, [float("inf")] * 40)]
    rows += [(206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [1e30, 2e30]), (209, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS kept", "2 AS n")
    got = {r[0]: tuple(r[1:]) for r in V.near_duplicates(df, 0.95).collect()}
    assert got == brute(rows, 0.95)


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert V.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = V.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [2.0, 0.0])], schema)).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False)]
    assert [tuple(r) for r in got if r[0] is None] == [(None, 0, None, False)]


def test_blocks_are_bounded_and_hold_every_vector_once(spark, monkeypatch):
    """Most vectors fall in one cell; its blocks stay small and their boxes hold their points."""
    monkeypatch.setattr(V, "TILE", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate((np.ones((500, 12)) + rng.normal(scale=0.01, size=(500, 12)), rng.normal(size=(100, 12))))
    rows = [(i, 1 + i % 3, [float(a) for a in v]) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "id long, n long, v array<double>").repartition(5)
    q = V.rotation(classes, 12)
    cells = V.Cells(V.keys_of(V.unit(x[500:]), q), 3)
    blocks = V.cell_blocks(classes, cells, q, np.float64).collect()
    ids = [np.frombuffer(b["id"], np.int64) for b in blocks]
    assert sorted(np.concatenate(ids).tolist()) == list(range(600)) and max(map(len, ids)) <= 16
    assert len({b["block"] for b in blocks}) == len(blocks)
    for b, own in zip(blocks, ids):
        points = V.keys_of(V.unit(x[own]), q)
        assert np.allclose(b["box"], V._boxes(points)) and (np.frombuffer(b["n"], np.int64) == 1 + own % 3).all()
        assert np.allclose(np.frombuffer(b["v"]).reshape(len(own), -1), x[own]) and (cells.tile(points) == b["cell"]).all()
    pairs = {(r["a"], r["b"]) for r in V.block_pairs(spark.createDataFrame(blocks, V.BLOCK_ROW), 0.9).collect()}
    of = {i: b["block"] for b, own in zip(blocks, ids) for i in own.tolist()}
    u = V.unit(x)
    for i, j in zip(*np.nonzero(u @ u.T >= 0.9)):
        assert (of[i], of[j]) in pairs or (of[j], of[i]) in pairs
    assert len(pairs) < len(blocks) * (len(blocks) + 1) // 2
