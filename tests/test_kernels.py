"""Metamorphic properties of the numpy kernels."""

import numpy as np
import pytest

from tesserae.kernels import covariance as C
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels import mean as M
from tesserae.kernels import spectral as S
from tesserae.kernels.ajd import ajd
from tesserae.sources.synthetic import KINDS, one_matrix

rng = np.random.default_rng(1234)


def spd(n, p, cplx=False):
    return np.stack([one_matrix(rng, p, "hpd" if cplx else "spd") for _ in range(n)])


@pytest.mark.parametrize("cplx", [False, True])
def test_spectral(cplx):
    x = spd(5, 3, cplx)
    assert np.allclose(S.expm(S.logm(x)), x)
    assert np.allclose(S.sqrtm(x) @ S.sqrtm(x), x)
    assert np.allclose(S.invsqrtm(x) @ x @ S.invsqrtm(x), np.eye(3))
    assert np.allclose(S.powm(x, 2), x @ x)
    assert S.is_hpd(x).all()


def test_spectral_errors():
    with pytest.raises(ValueError):
        S.logm(np.ones(3))
    with pytest.raises(ValueError):
        S.logm(np.full((2, 2), np.nan))


def test_derivatives_are_limits():
    ref, x, h = spd(1, 3)[0], S.sym(rng.normal(size=(3, 3))), 1e-6
    assert np.allclose(S.ddexpm(x, ref), (S.expm(ref + h * x) - S.expm(ref - h * x)) / (2 * h), atol=1e-6)
    assert np.allclose(S.ddlogm(x, ref), (S.logm(ref + h * x) - S.logm(ref - h * x)) / (2 * h), atol=1e-6)
    assert np.allclose(S.ddlogm(x, np.eye(3)), x)


def test_nearest_spd():
    x = rng.normal(size=(4, 3, 3))
    assert S.is_spd(S.nearest_spd(x)).all()
    y = spd(3, 3)
    assert np.allclose(S.nearest_spd(y), y)


@pytest.mark.parametrize("kind", KINDS)
def test_kinds(kind):
    m = one_matrix(rng, 3, kind)[None]
    test = {"sym": S.is_sym, "herm": S.is_hermitian, "spd": S.is_spd, "hpd": S.is_hpd, "spsd": S.is_sym, "hpsd": S.is_hermitian}.get(kind)
    assert test is None or test(m).all()
    if kind in ("orth", "unit"):
        assert np.allclose(m @ S.ct(m), np.eye(3))


@pytest.mark.parametrize("metric", D.METRICS)
def test_distances(metric):
    a, b = spd(6, 3), spd(6, 3)
    d = D.distance(a, b, metric)
    assert (d > 0).all() and np.allclose(D.distance(a, a, metric), 0, atol=2e-6)
    if metric not in ("kullback", "kullback_right"):
        assert np.allclose(d, D.distance(b, a, metric))
    assert np.allclose(D.distance(a, b, metric, squared=True), d**2)
    full = D.pairwise(a, b, metric)
    assert np.allclose(full, [[D.distance(x, y, metric) for y in b] for x in a])
    if metric in ("riemann", "thompson", "kullback", "logdet", "kullback_sym"):
        w = one_matrix(rng, 3, "inv")
        assert np.allclose(D.distance(w @ a @ w.T, w @ b @ w.T, metric), d)
    if metric in ("riemann", "logeuclid", "thompson", "kullback_sym"):
        assert np.allclose(D.distance(np.linalg.inv(a), np.linalg.inv(b), metric), d)


def test_distance_powers_and_errors():
    a, b = spd(2, 3)
    for p, name in ((1, "euclid"), (0, "logeuclid"), (-1, "harmonic")):
        assert np.isclose(D.distance(a, b, "poweuclid", p=p), D.distance(a, b, name))
    assert np.isclose(D.distance(a, b, "poweuclid", True, p=0.5), D.distance(a, b, "poweuclid", p=0.5) ** 2)
    with pytest.raises(ValueError):
        D.distance(a, b, "nope")
    x = rng.normal(size=(3, 5))
    assert np.allclose(D.mahalanobis(x, np.eye(3)), np.linalg.norm(x, axis=0))


@pytest.mark.parametrize("metric", ["euclid", "chol", "logchol", "logeuclid", "riemann", "thompson", "wasserstein"])
def test_geodesics(metric):
    a, b = spd(4, 3), spd(4, 3)
    assert np.allclose(G.geodesic(a, b, 0, metric), a) and np.allclose(G.geodesic(a, b, 1, metric), b)
    mid = G.geodesic(a, b, 0.5, metric)
    assert np.allclose(mid, G.geodesic(b, a, 0.5, metric))
    if metric != "thompson":
        assert np.allclose(D.distance(a, mid, metric), D.distance(a, b, metric) / 2)
    assert np.allclose(G.geodesic(a, b, np.full(4, 0.3), metric), G.geodesic(a, b, 0.3, metric))


@pytest.mark.parametrize("metric", ["euclid", "logchol", "logeuclid", "riemann", "wasserstein"])
def test_maps(metric):
    x, ref = spd(4, 3), spd(1, 3)[0]
    t = G.log_map(x, ref, metric)
    assert np.allclose(G.exp_map(t, ref, metric), x)
    assert np.allclose(G.unupper(G.upper(t)), t)
    assert np.allclose(G.untangent_space(G.tangent_space(x, ref, metric), ref, metric), x)
    if metric == "euclid" or metric == "logeuclid" or metric == "logchol":
        assert np.allclose(G.norm(t, ref, metric), D.distance(x, ref[None], metric))
    if metric == "riemann":
        r = S.sqrtm(ref)
        assert np.allclose(G.norm(r @ t @ r, ref, metric), D.distance(x, ref[None], metric))


@pytest.mark.parametrize("metric", ["euclid", "logchol", "logeuclid", "riemann"])
def test_transport_keeps_inner_products(metric):
    a, b = spd(2, 3)
    x, y = S.sym(rng.normal(size=(2, 3, 3)))
    xt, yt = G.transport(x, a, b, metric), G.transport(y, a, b, metric)
    assert np.isclose(G.inner(xt, yt, b, metric), G.inner(x, y, a, metric))
    assert np.allclose(G.transport(x, a, a, metric), x)


def test_kernel_is_gram():
    x = spd(5, 3)
    for metric in ("euclid", "logeuclid", "riemann"):
        k = G.kernel(x, metric=metric)
        assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-8
        assert np.allclose(G.kernel(x, x, M.mean(x)[0] if metric == "riemann" else None, metric), k - 1e-10 * np.eye(5))


@pytest.mark.parametrize("metric", M.MEANS)
def test_means(metric):
    x, p = spd(4, 3), 0.4 if metric.startswith("pow") else None
    m, _, _ = M.mean(x, metric, p=p)
    assert S.is_spd(m[None]).all()
    same = np.repeat(x[:1], 3, 0)
    assert np.allclose(M.mean(same, metric, p=p)[0], x[0], atol=1e-6)
    w = np.array([1.0, 2, 3, 4])
    if metric not in ("thompson", "ale"):
        order = [2, 0, 3, 1]
        assert np.allclose(M.mean(x, metric, w, p)[0], M.mean(x[order], metric, w[order], p)[0], atol=1e-4)
    if metric in ("riemann", "alm", "bmp", "ale"):
        assert np.isclose(np.linalg.det(m), np.exp(np.mean(np.log(np.linalg.det(x)))), rtol=1e-3)


def test_riemann_mean_is_stationary():
    x = spd(20, 4)
    m, _, ok = M.mean(x)
    assert ok and np.allclose(G.log_map(x, m).mean(0), 0, atol=1e-7)
    assert D.distance(M.mean(x, "cheap")[0], m) < 1e-2
    u, v = spd(2, 3)
    for kind in ("alm", "bmp", "cheap"):
        assert np.allclose(M.mean(np.stack([u, v]), kind, [3, 1])[0], G.geodesic(u, v, 0.25))
    for kind in ("power",):
        assert np.allclose(M.mean(x, kind, p=1)[0], x.mean(0))
        assert np.allclose(M.mean(x, kind, p=-1)[0], np.linalg.inv(np.linalg.inv(x).mean(0)))
        assert D.distance(M.mean(x, kind, p=0.01)[0], m) < 1e-2


def test_wasserstein_mean_fixed_point():
    x = spd(10, 3)
    m = M.mean(x, "wasserstein")[0]
    assert np.allclose(G.log_map(x, m, "wasserstein").mean(0), 0, atol=1e-6)


def test_masked_and_nan_means():
    x = spd(8, 3)
    full = M.nanmean_riemann(x)[0]
    assert np.allclose(full, M.mean(x)[0], atol=1e-5)
    y = x.copy()
    y[0, 1], y[0, :, 1] = np.nan, np.nan
    assert S.is_spd(M.nanmean_riemann(y)[0][None]).all()
    y[1, 0, 1] = np.nan
    with pytest.raises(ValueError):
        M.nanmean_riemann(y)


@pytest.mark.parametrize("metric", ["euclid", "riemann"])
def test_median_is_robust(metric):
    x = spd(21, 3)
    far = np.concatenate([x, 100 * x[:3]])
    m = M.median(far, metric)[0]
    assert D.distance(m, M.median(x, metric)[0]) < D.distance(M.mean(far, "euclid")[0], M.mean(x, "euclid")[0])


def test_covariances():
    x = rng.normal(size=(3, 4, 500))
    assert np.allclose(C.covariances(x, "cov")[0], np.cov(x[0])) and np.allclose(C.covariances(x, "corr")[0], np.corrcoef(x[0]))
    assert np.allclose(C.scm(x)[1], np.cov(x[1], bias=True))
    for e in C.ESTIMATORS:
        c = C.covariances(x, e)
        assert c.shape == (3, 4, 4) and S.is_spd(c).all()
    for e in ("lwf", "oas", "sch", "hub", "stu", "mcd"):
        c = C.covariances(x, e)
        assert np.abs(c / np.trace(c, axis1=1, axis2=2)[:, None, None] * 4 - np.eye(4)).max() < 0.35
    assert np.isclose(np.trace(C.covariances(x, "tyl")[0]), 4)
    assert np.allclose(C.block_covariances(x, [2, 2])[:, :2, 2:], 0)
    z = x + 1j * rng.normal(size=x.shape)
    assert S.is_hermitian(C.covariances(z, "lwf")).all()
    assert np.isclose(C.chi2_cdf(C.chi2_ppf(0.9, 4), 4), 0.9)
    with pytest.raises(ValueError):
        C.covariances(x, "nope")


def test_spectra_and_normalisation():
    x = rng.normal(size=(3, 1000))
    s, f = C.cross_spectrum(x, 128, 0.5, fs=128, fmin=1, fmax=30)
    assert s.shape[-1] == len(f) == 30 and np.allclose(s, np.conj(np.swapaxes(s, 0, 1)))
    for kind in ("ordinary", "instantaneous", "lagged", "imaginary"):
        c, _ = C.coherence(x, 128, 0.5, kind=kind)
        assert (c[..., 1:-1] >= -1e-12).all() and (c[..., 1:-1] <= 1 + 1e-9).all()
    m = spd(3, 3)
    assert np.allclose(np.einsum("nii->ni", C.normalize(m, "corr")), 1)
    assert np.allclose(np.trace(C.normalize(m, "trace"), axis1=1, axis2=2), 1)
    assert np.allclose(np.linalg.det(C.normalize(m, "determinant")), 1)
    assert np.allclose(C.nondiag_weight(np.eye(3)[None]), 0)
    assert C.sliding(np.zeros((256, 2)), 128, 0.5, False).shape[0] == 2 and C.sliding(np.zeros((256, 2)), 128, 0.5, False, True).shape[0] == 3


@pytest.mark.parametrize("method", ["ajd_pham", "rjd", "uwedge"])
def test_ajd_diagonalises(method):
    a = one_matrix(rng, 4, "orth" if method == "rjd" else "inv")
    x = np.stack([a @ np.diag(rng.uniform(1, 3, 4)) @ a.T for _ in range(12)])
    b, y = ajd(x, method)
    off = y - np.einsum("nij,ij->nij", y, np.eye(4))
    assert np.linalg.norm(off) < 1e-2 * np.linalg.norm(y)
