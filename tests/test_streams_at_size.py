"""Streams row by row in plain numbers, and keys with more rows than are held."""

import numpy as np
import pandas as pd
import pytest

from tesserae import streaming
from tesserae.frames import from_numpy
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.ml import artifacts

rng = np.random.default_rng(6)


def spd(n):
    a = rng.normal(size=(n, 2, 2))
    return a @ np.swapaxes(a, 1, 2) + 0.05 * np.eye(2)


@pytest.mark.parametrize("alpha", [0.0, 0.01, 0.5, 1.0])
def test_plain_steps(alpha):
    a, b = spd(40), spd(40)
    b[0], b[1] = a[0], a[1] * 2
    for x, y in zip(a, b):
        d, m = G.step2(x.ravel().tolist(), y.ravel().tolist(), alpha)
        assert d == pytest.approx(float(D.distance(x, y)), abs=1e-9) and np.allclose(np.reshape(m, (2, 2)), G.geodesic(x, y, alpha), atol=1e-9)


@pytest.mark.parametrize("most", [7, 50, 10_000])
def test_rows_in_order_from_files(tmp_path, most):
    o = rng.permutation(900)
    parts = [(o[k : k + 10], pd.Series([[float(v)] * 4 if v % 9 else None for v in o[k : k + 10]])) for k in range(0, 900, 10)]
    sizes, got = [], []
    for block in streaming.in_order(iter(parts), str(tmp_path), most):
        sizes.append(len(block))
        got += [r[0] for r in block]
    assert got == [v for v in range(900) if v % 9] and max(sizes) <= max(2 * most, 90)
    assert bool(list(tmp_path.iterdir())) == (most < 800)


@pytest.mark.parametrize("field", [False, True])
def test_online_potatoes_in_plain_numbers(spark, monkeypatch, field):
    x, y = spd(80), spd(80)
    df = from_numpy(spark, x).withColumnRenamed("cov", "a").join(from_numpy(spark, y).withColumnRenamed("cov", "b"), "id").coalesce(1).persist()
    cols = ["a", "b"] if field else "a"
    fit = lambda: artifacts.PotatoField(2).fit(df, cols) if field else artifacts.Potato(threshold=2).fit(df, col="a")
    want = streaming.OnlinePotato(fit(), "id", cols)
    slow = []
    model = want.model
    for r in df.orderBy("id").collect():
        xs = [np.reshape(r[c], (2, 2)) for c in (cols if field else [cols])]
        potatoes = model.potatoes_ if field else [model]
        z = [(float(np.log(D.distance(v, p.mean_))) - p.mu_) / p.sigma_ for v, p in zip(xs, potatoes)]
        if (model.p_value(z) > model.p_threshold) if field else z[0] < model.threshold:
            for v, p in zip(xs, potatoes):
                p.update(v, 0.01)
        slow.append(z)
    fast = streaming.OnlinePotato(fit(), "id", cols)
    monkeypatch.setattr(streaming.D, "distance", lambda *a, **k: pytest.fail("an eigenproblem a row"))
    out = fast.apply(df)
    assert np.allclose([r.z for r in out.orderBy("at").collect()], slow, atol=1e-8)
