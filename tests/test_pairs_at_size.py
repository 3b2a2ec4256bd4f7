"""Pairs and neighbours at sizes beyond a block: bounded shuffles, tasks by pairs, exact results."""

import numpy as np
import pytest

from tesserae.frames import from_numpy
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.ml import composite
from tesserae.operators import pairs

rng = np.random.default_rng(11)


def spd(n, p):
    a = rng.normal(size=(n, p, p))
    return a @ np.swapaxes(a, 1, 2) + 0.1 * np.eye(p)


@pytest.mark.parametrize("metric", ["riemann", "thompson", "wasserstein", "logdet", "kullback", "kullback_right", "kullback_sym"])
def test_pairs_of_2x2_need_no_eigenproblem(monkeypatch, metric):
    x, y = spd(30, 2), spd(50, 2)
    want = np.stack([D.distance(m[None], y, metric) for m in x])

    def none(*a, **k):
        raise AssertionError("an eigenproblem for each pair")

    monkeypatch.setattr(D, "CHUNK", 64)
    for f in ("eigvalsh", "eigh", "solve"):
        monkeypatch.setattr(np.linalg, f, none)
    assert np.allclose(D.pairwise(x, y, metric), want, atol=1e-9)


def test_tasks_follow_the_number_of_pairs(spark):
    df = from_numpy(spark, spd(3000, 2)).coalesce(1)
    for d in (pairs.pairwise_distance(df), pairs.kernel(df, metric="euclid"), pairs.group_sums(df, lambda ids: None)):
        assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    assert pairs.pairwise_distance(df).rdd.getNumPartitions() >= 8
    assert pairs.pairwise_distance(df, metric="kullback").rdd.getNumPartitions() >= 8


def test_nothing_is_copied_for_each_block(spark, monkeypatch):
    x = spd(60, 2)
    df = from_numpy(spark, x).repartition(3)
    monkeypatch.setattr(pairs, "BROADCAST_MB", 0)
    monkeypatch.setattr(pairs, "BLOCK", 16)
    d = pairs.pairwise_distance(df, metric="kullback")
    assert "Generate" not in d._jdf.queryExecution().executedPlan().toString()
    got = pairs.dense(d, list(range(60)), mirror=False)
    assert np.allclose(got, D.pairwise(x, None, "kullback") * (1 - np.eye(60)))
    for limit in (0, 256):
        monkeypatch.setattr(pairs, "BROADCAST_MB", limit)
        k = pairs.kernel(df, metric="logeuclid")
        assert k.count() == 3600 and np.allclose(pairs.dense(k, list(range(60)), "k", False), G.kernel(x, metric="logeuclid"))


def test_a_pair_and_its_mirror_image_are_near_each_other(spark):
    k = pairs.kernel(from_numpy(spark, spd(600, 2)), metric="euclid").toArrow()
    v = k["k"].to_numpy()
    i, j = k["i"].to_numpy(), k["j"].to_numpy()
    at = np.empty((600, 600), int)
    at[i, j] = np.arange(len(v))
    assert np.median(np.abs(at - at.T)[~np.eye(600, dtype=bool)]) <= 2048


@pytest.mark.parametrize("metric", ["riemann", "logeuclid", "euclid", "wasserstein"])
@pytest.mark.parametrize("limit", [0, 256])
def test_nearest_is_exact_and_copies_go_by_id(spark, monkeypatch, metric, limit):
    x = np.tile(spd(60, 3), (6, 1, 1))
    monkeypatch.setattr(pairs, "BLOCK", 64)
    monkeypatch.setattr(pairs, "BROADCAST_MB", limit)
    df = from_numpy(spark, x).repartition(4)
    got = pairs.nearest(df.where("id < 60"), df, 8, metric).orderBy("i", "rank").collect()
    d = np.stack([D.distance(m[None], x, metric) for m in x[:60]])
    if metric == "wasserstein":  # no bound: every pair
        assert np.allclose([r.d for r in got], np.sort(d, 1)[:, :8].ravel(), atol=1e-6)
        return
    d[:, :] = d[:, np.arange(360) % 60]
    d[np.arange(60)[:, None], np.arange(60)[:, None] + 60 * np.arange(6)] = 0
    want = np.lexsort((np.broadcast_to(np.arange(360), d.shape), d), axis=1)[:, :8]
    assert [r.j for r in got] == list(want.ravel())


def test_patches_take_copies_by_id(spark):
    v = np.tile(rng.normal(size=(40, 16)), (5, 1))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "id long, v array<double>")
    for r in composite.neighbour_patches(df, 4).collect():
        copies = [r.id % 40 + 40 * c for c in range(5)]
        assert r.neighbours == [r.id, *[c for c in copies if c != r.id][:3]]


def test_few_distances_are_computed():
    x = spd(4000, 2)
    f = D.embed(x, "logeuclid")
    asked = []

    def exact(i, j):
        asked.append(len(i))
        return D.distance(x[:100][i], x[j], "riemann")

    i, j, d = pairs._best(np.arange(100), f[:100], np.arange(4000), f, 5, 512, exact)
    want = np.sort(D.pairwise(x[:100], x), 1)[:, :5]
    assert np.allclose(d.reshape(100, 5), want, atol=1e-7) and sum(asked) < 0.1 * 100 * 4000
