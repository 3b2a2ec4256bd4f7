"""Mean shift in flat coordinates against the passes of log maps, and its bandwidth against a percentile."""

import numpy as np
import pytest

from tesserae.frames import from_numpy
from tesserae.kernels import distance as D
from tesserae.ml import clustering, embedding

rng = np.random.default_rng(8)


@pytest.mark.parametrize("metric", ["logeuclid", "euclid"])
def test_flat_passes_are_the_same(spark, monkeypatch, metric):
    a = rng.normal(size=(70, 2, 2)) * np.repeat([0.3, 3], 35)[:, None, None]
    x = a @ np.swapaxes(a, 1, 2) + 0.3 * np.eye(2)
    df = from_numpy(spark, x).repartition(3).persist()
    got = clustering.MeanShift(metric=metric, tol=1e-6, max_iter=2)
    with monkeypatch.context() as m:
        for module in (clustering, embedding):
            m.setattr(module, "BLOCK", 32)
            m.setattr(module, "CHUNK_PAIRS", 512)
        m.setattr(clustering, "checkpoint", lambda d: pytest.fail("a pass of log maps"))
        got.fit(df)
    full = D.pairwise(x, None, metric)
    assert got.bandwidth_ == pytest.approx(np.sort(full.ravel())[int(0.3 * (70 * 70 - 1))], rel=0.02)
    old = clustering.MeanShift(metric=metric, tol=1e-6, max_iter=2)
    monkeypatch.setattr(clustering, "BROADCAST_MB", 0)
    old.fit(df)
    assert got.bandwidth_ == pytest.approx(old.bandwidth_, rel=1e-9)
    assert got.modes_.shape == old.modes_.shape and np.allclose(got.modes_, old.modes_, atol=1e-5)
