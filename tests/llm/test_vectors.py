"""Clustering and whitening against plain numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from textloom.llm import clusters as cl
from textloom.llm import whitening as wh

#: Columns whose names the operators use inside.
ODD = "vec_id long, embedding array<float>, id long, x int, path string, n int, `clusters` int, component int, z int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "p", 3, 4, 5, 6) for i, v in rows], ODD).repartition(3)


def vectors(n, dim, seed=0, scale=0.2):
    draw = np.random.default_rng(seed)
    return [(7 * i + 3, [float(v) for v in row]) for i, row in enumerate(draw.normal(0, scale, (n, dim)).astype(np.float32))]


def odd_vectors(dim):
    bad = [None, [], [0.1] * (dim - 1), [0.1] * (dim + 1), [None] + [0.1] * (dim - 1), [math.nan] + [0.1] * (dim - 1), [math.inf] + [0.1] * (dim - 1)]
    return [(10_000 + i, v) for i, v in enumerate(bad)]


def plain_clusters(rows, dim, k, rounds):
    x = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    order = sorted(x, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [x[i] for i in order[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for v in x.values():
            groups[nearest(v)].append(v)
        centres = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    placed = {i: nearest(v) for i, v in x.items()}
    cost = {i: apart(v, centres[placed[i]]) for i, v in x.items()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    per = [sum(cost[i] for i in x if placed[i] == c) for c in range(len(centres))]
    return {i: (placed[i], cost[i], per[placed[i]], sum(per), names[placed[i]]) for i in x}


def shown(frame):
    return {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in frame.collect()}


@pytest.mark.parametrize(("n", "block", "bits"), [(300, 64, 6), (300, 7, 2), (5, 64, 6)])
def test_clusters_equal_plain_python(spark, monkeypatch, n, block, bits):
    monkeypatch.setattr(cl, "BLOCK", block)
    rows = vectors(n, 6) + [(9_001, [0.25] * 6), (9_002, [0.25] * 6), (9_003, [-0.25] * 6)]
    got = shown(cl.cluster(table(spark, rows + odd_vectors(6)), dim=6, rounds=6, bits=bits))
    assert got == plain_clusters(rows, 6, 8, 6)


def test_equal_vectors_leave_empty_clusters(spark):
    rows = [(i, [0.5, -0.5]) for i in range(12)]
    assert shown(cl.cluster(table(spark, rows), dim=2)) == plain_clusters(rows, 2, 8, 10)


def test_clusters_of_repeated_nameless_and_no_rows(spark):
    rows = vectors(40, 4)
    twice = cl.cluster(table(spark, rows + rows[:5] + [(None, [0.1] * 4)]), dim=4).collect()
    assert len(twice) == 46 and sum(r["vec_id"] is None for r in twice) == 1
    assert len({(r["cluster"], r["distance"]) for r in twice if r["vec_id"] == rows[0][0]}) == 1
    empty = cl.cluster(table(spark, odd_vectors(4)), dim=4)
    assert empty.count() == 0 and empty.columns == cl.cluster(table(spark, rows), dim=4).columns
    with pytest.raises(ValueError, match="long"):
        cl.cluster(table(spark, [(1, [1e9] * 4)]), dim=4)


def test_cells_pack_and_bound_the_distances():
    draw = np.random.default_rng(1)
    x, centres = draw.integers(-500, 500, (200, 9)), draw.integers(-300, 300, (5, 9))
    exact = cl.distances(x, centres)
    for bits in (1, 3, 6):
        grid = cl.Grid(x.min(axis=0), x.max(axis=0), bits)
        cells = grid.cells(x)
        assert cells.max() < 2**bits and (cl.unpack(cl.pack(cells, bits), 9, bits) == cells).all()
        low, high = grid.intervals(cells, centres)
        shared = exact - (x * x).sum(axis=1)[:, None] + 2 * (x @ (centres.sum(axis=0) // 5))[:, None]
        assert (low <= shared).all() and (shared <= high).all()


def test_few_vectors_are_fetched_where_clusters_are_apart(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 1, (8, 64))
    x = np.floor(1024 * (centres[np.arange(4000) % 8] + draw.normal(0, 0.05, (4000, 64)))).astype(np.int64)
    grid = cl.Grid(x.min(axis=0), x.max(axis=0), cl.CELL_BITS)
    means = np.stack([x[i::8].sum(axis=0) // 500 for i in range(8)])

    class Held:
        n, asked = len(x), 0

        def __init__(self):
            self.grid = grid

        def cells(self):
            return grid.cells(x)

        def vectors(self, rows=None):
            return x if rows is None else x[rows]

    after, _, _, fetched = cl.assign(Held(), np.arange(4000) % 8, means)
    assert (after == cl.distances(x, means).argmin(axis=1)).all() and fetched < 40


def plain_whitening(rows, components):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], float)
    n, mean = len(x), x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / n
    values, base = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return (x - mean) @ base[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


@pytest.mark.parametrize(("n", "dim"), [(400, 16), (60, 3), (200, 64)])
def test_whitening_equals_numpy_but_for_signs(spark, n, dim):
    draw = np.random.default_rng(dim)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate((draw.normal(0, 0.3, (n, dim)) * np.linspace(0.2, 1, dim)).astype(np.float32))]
    bad = [(10_000, None), (10_001, [None] * dim), (10_002, [math.nan] * dim), (10_003, [math.inf] * dim), (10_004, [])]
    got = wh.whiten(table(spark, rows + bad)).collect()
    k = min(8, dim)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    want, share = plain_whitening(rows, k)
    z = np.zeros((n, k))
    for r in got:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert math.isclose(r["explained"], share[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    z *= np.sign((z * want).sum(axis=0))
    assert np.abs(z - want).max() < 1e-7
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(col) for col in zip(*x, strict=True)]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got)


def test_whitening_of_flat_few_repeated_and_no_vectors(spark):
    one = wh.whiten(table(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    line = wh.whiten(table(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.75, 0.25])])).collect()
    assert len(line) == 6 and {r["explained"] for r in line if r["component"] == 1} == {1.0}
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and max(r["identity_error"] for r in line) < 1e-9
    assert wh.whiten(table(spark, [(1, None)])).count() == 0
    mixed = wh.whiten(table(spark, vectors(20, 3) + [(i + 1000, v) for i, v in vectors(30, 5, 1)])).collect()
    assert {(r["n"], r["vec_id"] >= 1000) for r in mixed} == {(20, False), (30, True)} and len(mixed) == 60 + 150


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0], [3, 3, 3, 3], [2, 2, 1, 1, 0, 0, 0], [1e6, 1, 1e-6], [0, 0], [-1, 4, 2]])
def test_eigenpairs_by_polar_decompositions(values):
    draw = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(draw.normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    pairs = list(wh.eigenpairs(a))
    scale = max(1e-300, np.abs(a).max())
    assert np.allclose([e for e, _ in pairs], sorted(values, reverse=True), atol=1e-13 * scale, rtol=0)
    base = np.stack([v for _, v in pairs], axis=1)
    assert np.abs(base.T @ base - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ base - base * [e for e, _ in pairs]).max() < 1e-13 * scale
    if len(values) > 2:
        assert np.abs(wh.polar(a + np.eye(len(a)) * 0.5) @ wh.polar(a + np.eye(len(a)) * 0.5) - np.eye(len(a))).max() < 1e-12
