"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann_tree, lattice

SCHEMA = "vec_id long, embedding array<float>, label int, node long, tile int, leaf int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, 3) for i, v, label in rows], SCHEMA)


def table(n=600, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:140] = x[100] + 0.05 * rng.standard_normal((40, d))
    x[200:230] = x[200]
    rows = [(i, x[i].tolist(), i % 3 if not 100 <= i < 230 else 1) for i in range(n)]
    odd = [(9000, None, 1), (9001, [0.0] * d, 1), (9002, [float("nan")] * d, 1), (9003, [None] * d, 1), (9004, [1.0], 1), (9005, x[0].tolist(), None), (None, x[1].tolist(), 1), (9007, [float("inf")] * d, 1), (200, x[200].tolist(), 1)]
    return rows, odd


def test_tree_search(spark):
    rows, odd = table()
    df = frame(spark, rows + odd)
    got = {}
    for r in ann_tree.search(df, F.col("vec_id") % 20 == 0, leaf_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v, np.float64) for i, v, _ in rows} | {9005: np.array(odd[5][1], np.float32).astype(np.float64)}
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        dist = sorted((float(np.sqrt(((good[i].astype(np.float32) - good[q].astype(np.float32)).astype(np.float64) ** 2).sum())), i) for i in good if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hit += len({i for _, i in dist} & {v for _, v, _ in mine})
        total += 10
    assert hit / total >= 0.9 and not {9000, 9001, 9002, 9003, 9004, 9007} & set(got)


def test_tree_search_tiles(spark, monkeypatch):
    """Leaves cut into many tiles, all visited: exact, ties to the smaller id."""
    monkeypatch.setattr(ann_tree, "TILE", 7)
    rows, _ = table(300, 4)
    x = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann_tree.search(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, leaf_rows=1000).collect())
    want = []
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        want += [(q, k + 1, int(i)) for k, i in enumerate(order)]
    assert got == want


@pytest.mark.parametrize("tile_rows,blocks", [(1024, 1), (8, 1), (1024, 2), (8, 2), (64, 3)])
def test_lattice(spark, monkeypatch, tile_rows, blocks):
    monkeypatch.setattr(lattice.links, "__defaults__", (blocks, tile_rows))
    monkeypatch.setattr(lattice, "blocks_for", lambda most, d: blocks)
    rows, odd = table(d=24 if blocks == 3 else 16)
    got = lattice.near_duplicates(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    able = rows + [odd[8]]
    x = np.array([v for _, v, _ in able], np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([k for *_, k in able])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in able]
    reach = np.array(ids)
    while True:
        new = np.array([min([reach[i], *reach[near[i]]]) for i in range(len(ids))])
        if np.array_equal(new, reach):
            break
        reach = new
    want = sorted(zip(ids, near.sum(1).tolist(), reach.tolist()))
    mine = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 9000)
    assert mine == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id is None or r.vec_id >= 9000)


def test_e8_points():
    rng = np.random.default_rng(3)
    y = rng.standard_normal((200, 8)) * 2
    near = lattice.decode(y)
    assert len(lattice.neighbours()) == 240
    away = ((y[:, None] - near[:, None] - lattice.neighbours()[None]) ** 2).sum(2).min(1)
    assert (((y - near) ** 2).sum(1) <= away + 1e-12).all()


def test_empty(spark):
    assert ann_tree.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert lattice.near_duplicates(frame(spark, [])).count() == 0
    bad = frame(spark, [(1, None, 1), (2, [0.0, 0.0], 1)])
    assert ann_tree.search(bad, F.lit(True)).count() == 0 and lattice.near_duplicates(bad).count() == 2
