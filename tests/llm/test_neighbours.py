import math

import numpy as np
import pytest

from ossicle.llm import neighbours
from ossicle.llm.work import Workspace

SCHEMA = "vec_id long, embedding array<float>, ids string, rank int"


def brute(rows, every=100, k=10):
    x = {(i, tuple(map(float, np.float32(v)))) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    lengths = [len(v) for _, v in x]
    size = min(set(lengths), key=lambda n: (-lengths.count(n), n), default=0)
    x = [(i, np.array(v)) for i, v in x if len(v) == size]
    out = set()
    for q, v in x:
        if q % every == 0:
            near = sorted({(math.sqrt(((v - w) ** 2).sum()), i) for i, w in x if i != q})[:k]
            out |= {(q, r, i) for r, (_, i) in enumerate(near, 1)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return neighbours.search(df, **more).collect()


def test_small_tables_are_exact_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)] + [(2000, None), (2100, []), (2200, [0.0] * 5), (2300, [1.0, None, 1.0, 1.0, 1.0]), (2400, [math.nan] * 5)]
    rows += [(2500, [math.inf] * 5), (2600, [1.0, 2.0]), (None, [1.0] * 5), (200, rows[200][1]), (-100, [1.0] * 5)]
    assert {(r.query_id, r.rank, r.vec_id) for r in run(spark, rows, exact_below=1000)} == brute(rows)
    assert {(r.query_id, r.rank, r.vec_id) for r in run(spark, rows[:4], every=1)} == brute(rows[:4], 1)
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [1500, 9000])  # one block of rows a curve, and several
def test_recall_of_windows(spark, n):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows)
    want = brute(rows)
    assert len(got) == len(want) == n // 10
    hits = {(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i in want}
    assert len(hits) >= 0.9 * len(want)
    y = {i: np.float32(v).astype(float) for i, v in rows}
    assert all(abs(r.score - np.linalg.norm(y[r.query_id] - y[r.vec_id])) < 1e-12 for r in got)


def test_hilbert_neighbours_are_adjacent():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = neighbours.hilbert(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_ranks_follow_the_keys(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 40, (500, 3))
    frame = spark.createDataFrame([(i, k.tolist()) for i, k in enumerate(keys)], "row long, keys array<long>")
    got = {(r.curve, r.row): r.rank for r in neighbours.ranks(frame, 500, Workspace(spark, "ranks")).collect()}
    for c in range(3):
        assert [got[c, i] for i in sorted(range(500), key=lambda i: (keys[i, c], i))] == list(range(500))
