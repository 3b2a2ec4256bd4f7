"""Kernel machines beyond DENSE rows against the ones with all pairs at hand."""

import numpy as np
import pytest

from tesserae.frames import from_numpy
from tesserae.ml import classification

rng = np.random.default_rng(9)


@pytest.fixture(scope="module")
def some(spark):
    a = rng.normal(size=(120, 2, 2)) * (1 + np.arange(120) % 3)[:, None, None]
    x = a @ np.swapaxes(a, 1, 2) + 0.3 * np.eye(2)
    return from_numpy(spark, x, y=np.arange(120) % 3, target=np.log(np.linalg.det(x)) + 0.3 * rng.normal(size=120), w=rng.uniform(0.5, 2, 120)).repartition(3).persist()


@pytest.mark.parametrize("metric", ["logeuclid", "riemann", "euclid"])
def test_explicit_features_give_the_same_machines(some, monkeypatch, metric):
    make = lambda: (classification.SVC(metric, tol=1e-7, max_iter=1_000_000).fit(some, weight="w"), classification.SVR(metric, tol=1e-7, max_iter=1_000_000).fit(some, "target"))
    want = make()
    monkeypatch.setattr(classification._KernelMachine, "DENSE", 10)
    got = make()
    assert got[0].explicit_ and got[0].x_ is None
    same = [[r.prediction for r in m[0].predict(some).orderBy("id").collect()] for m in (want, got)]
    assert np.mean(np.array(same[0]) == np.array(same[1])) >= 0.99
    value = [[r.prediction for r in m[1].predict(some).orderBy("id").collect()] for m in (want, got)]
    assert np.allclose(*value, atol=1e-3)
    for a, b in zip(want[0].machines_, got[0].machines_):
        assert a[4] == pytest.approx(b[4], abs=1e-3)


def test_interior_point_ends_where_rounding_takes_over():
    f = np.tile(rng.normal(size=(300, 36)) * np.geomspace(1, 1e-4, 36), (6, 1))
    s = np.tile(rng.choice([-1.0, 1.0], 300), 6)
    u = classification._interior(f * s[:, None], s, -np.ones(1800), np.ones(1800))
    assert u.min() > -1e-9 and u.max() < 1 + 1e-9 and abs(s @ u) < 1e-5
