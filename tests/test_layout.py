import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference import dist

from oosgauge.operators import affinity as P
from oosgauge.operators import layout as L
from oosgauge.operators.knn import knn
from oosgauge.plans import methods as R


def dense(y):
    gap = y[:, None] - y[None]
    w = 1.0 / (1.0 + (gap**2).sum(axis=2))
    np.fill_diagonal(w, 0.0)
    return ((w * w)[:, :, None] * gap).sum(axis=1), w.sum(), w


@pytest.mark.parametrize("scale", [1e-4, 1.0, 12.0])
def test_grid_repulsion_is_the_dense_one(rng, scale):
    y = rng.normal(size=(400, 2)) * scale + 5.0
    y[7] = y[8]
    push, total = L.Grid()(y)
    want, all_w, _ = dense(y)
    assert np.linalg.norm(push - want) < 0.01 * np.linalg.norm(want)
    assert total == pytest.approx(all_w, rel=1e-3)


def test_grid_of_one_place_and_too_wide_a_layout():
    push, total = L.Grid()(np.full((3, 2), 2.5))
    assert np.abs(push).max() < 1e-9 and total == pytest.approx(6.0)
    with pytest.raises(ValueError, match="cells a side"):
        L.Grid()(np.array([[0.0, 0.0], [1e6, 0.0]]))


def blobs(rng, each=40):
    return np.concatenate([rng.normal(size=(each, 6)) + 8 * k for k in range(3)])


def test_curve_is_the_least_squares_one():
    a, b = L.curve(0.1)
    x = np.linspace(0, 3, 300)
    want = np.where(x < 0.1, 1.0, np.exp(-(x - 0.1)))
    miss = lambda a, b: ((1 / (1 + a * x ** (2 * b)) - want) ** 2).sum()
    assert all(miss(a, b) <= miss(a + s, b + t) for s in (-0.01, 0, 0.01) for t in (-0.01, 0, 0.01))


def test_a_step_of_tsne_is_the_dense_one(make, rng):
    x = blobs(rng)
    e, n = make(x), len(x)
    near = knn(e, 30)
    p = P.joint_p(P.conditional_p(P.calibrate(near, math.log2(10), "sigma"), "sigma"), n)
    full = np.zeros((n, n))
    for r in p.collect():
        full[r.i, r.j] = r.p
    assert full.sum() == pytest.approx(1.0) and np.allclose(full, full.T)
    start = x[:, :2] * 0.3
    nodes = make(x, start).select("id", "proj")
    got, losses = L.lay_out(nodes, p.withColumn("gap", F.lit(0.0)), 1, L.StudentStep(50.0))
    _, total, w = dense(start)
    grad = 4 * (((12 * full - w / total) * w)[:, :, None] * (start[:, None] - start[None])).sum(axis=1)
    new = start - 50.0 * 0.8 * grad
    placed = np.array([r.proj for r in got.orderBy("id").collect()])
    assert np.linalg.norm(placed - (new - new.mean(axis=0))) < 0.01 * np.linalg.norm(new - start)
    on = full > 0
    assert losses[0] == pytest.approx((full[on] * np.log(full[on] * total / w[on])).sum(), rel=1e-2)


def apart(y, each=40):
    """Share of rows nearest to a row of their own group."""
    d = dist(y)
    np.fill_diagonal(d, np.inf)
    group = np.arange(len(y)) // each
    return float((group[d.argmin(axis=1)] == group).mean())


def test_layouts_do_not_depend_on_tasks(make, rng, monkeypatch):
    e = make(blobs(rng))
    for fit in (lambda: L.tsne(e, 10, steps=4), lambda: L.umap(e, 10, epochs=1)):
        seen = []
        for edges in (1 << 22, 700):
            monkeypatch.setattr(L, "TASK_EDGES", edges)
            seen.append(np.array([r.proj for r in fit()[0].orderBy("id").collect()]))
        assert np.array_equal(seen[0], seen[1])


def test_layouts_lower_their_loss(make, rng):
    e = make(blobs(rng))
    placed, losses = L.tsne(e, 10, steps=600)
    assert losses[-1] < losses[0] and losses[-1] < 1.0
    assert apart(np.array([r.proj for r in placed.orderBy("id").collect()])) == 1.0
    placed, losses = L.umap(e, 10, epochs=300)
    assert losses[-1] < losses[0]
    assert apart(np.array([r.proj for r in placed.orderBy("id").collect()])) > 0.95


def test_few_rows_copies_and_none(make, rng):
    for rows in (0, 1, 3):
        e = make(rng.normal(size=(rows, 3))) if rows else make(np.zeros((0, 3)))
        for fit in (lambda: L.tsne(e, steps=20), lambda: L.umap(e, epochs=5)):
            got = fit()[0].collect()
            assert len(got) == rows and all(math.isfinite(c) for r in got for c in r.proj)
    same = make(np.ones((12, 3)))
    for fit in (lambda: L.tsne(same, steps=20), lambda: L.umap(same, epochs=5)):
        assert all(math.isfinite(c) for r in fit()[0].collect() for c in r.proj)


def test_too_many_rows_raise(make, rng, monkeypatch):
    monkeypatch.setattr(L, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="places"):
        L.umap(make(rng.normal(size=(11, 3))), epochs=2)


@pytest.mark.parametrize("name", ["ktsne", "dlmp-tsne", "dlmp-umap"])
def test_methods_fit_alone(make, rng, name):
    x = blobs(rng, 30)
    kw = {"ktsne": {"perplexity": 8, "steps": 300}, "dlmp-tsne": {"perplexity": 8, "steps": 300, "epochs": 40}, "dlmp-umap": {"steps": 100, "epochs": 40}}[name]
    m = R.get(name, **kw).fit(make(x))
    assert apart(np.array([r.proj for r in m.transform().orderBy("id").collect()]), 30) > 0.95
    assert m.transform_oos(make(x[:9] + 0.01, first=1000)).count() == 9
