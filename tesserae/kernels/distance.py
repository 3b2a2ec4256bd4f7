"""Distances and divergences between positive definite matrices."""

from __future__ import annotations

import numpy as np

from tesserae.kernels.spectral import ct, eigvals_pencil, invsqrtm, logdet, logm, powm, sqrtm


def _norm2(x):
    return (np.abs(x) ** 2).sum((-1, -2))


def _trace(x):
    return np.trace(x, axis1=-2, axis2=-1).real


def euclid2(a, b):
    return _norm2(a - b)


def chol2(a, b):
    return _norm2(np.linalg.cholesky(a) - np.linalg.cholesky(b))


def harmonic2(a, b):
    return _norm2(np.linalg.inv(a) - np.linalg.inv(b))


def logeuclid2(a, b):
    return _norm2(logm(a) - logm(b))


def logchol2(a, b):
    la, lb = np.linalg.cholesky(a), np.linalg.cholesky(b)
    d = np.log(np.diagonal(la, axis1=-2, axis2=-1).real) - np.log(np.diagonal(lb, axis1=-2, axis2=-1).real)
    return _norm2(np.tril(la, -1) - np.tril(lb, -1)) + (d**2).sum(-1)


def riemann2(a, b):
    return (np.log(eigvals_pencil(a, b)) ** 2).sum(-1)


def thompson2(a, b):
    return np.abs(np.log(eigvals_pencil(a, b))).max(-1) ** 2


def logdet2(a, b):
    return np.maximum(logdet((a + b) / 2) - (logdet(a) + logdet(b)) / 2, 0)


def wasserstein2(a, b):
    r = sqrtm(b)
    return np.maximum(_trace(a) + _trace(b) - 2 * _trace(sqrtm(r @ a @ r)), 0)


def kullback(a, b):
    return (_trace(np.linalg.solve(b, a)) - a.shape[-1] + logdet(b) - logdet(a)) / 2


def poweuclid2(a, b, p):
    if p == 0:
        return logeuclid2(a, b)
    return _norm2(powm(a, p) - powm(b, p)) / p**2


_squared = {
    "euclid": euclid2, "chol": chol2, "harmonic": harmonic2, "logeuclid": logeuclid2, "logchol": logchol2, "riemann": riemann2, "thompson": thompson2,
    "logdet": logdet2, "wasserstein": wasserstein2,
}
_plain = {"kullback": kullback, "kullback_right": lambda a, b: kullback(b, a), "kullback_sym": lambda a, b: kullback(a, b) + kullback(b, a)}
METRICS = (*_squared, *_plain)


def distance(a, b, metric="riemann", squared=False, p=None):
    """Distance of a and b; stacks broadcast.  A divergence counts as a distance, so squared=True squares it."""
    if callable(metric):
        d = metric(a, b)
        return d**2 if squared else d
    if metric == "poweuclid":
        d2 = poweuclid2(a, b, p)
    elif metric in _plain:
        d = _plain[metric](a, b)
        return d**2 if squared else d
    elif metric in _squared:
        d2 = _squared[metric](a, b)
    else:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return d2 if squared else np.sqrt(d2)


def embed(x, metric):
    """Vectors whose Euclidean distances are the metric's, or None if it has none such."""
    f = {"euclid": lambda m: m, "harmonic": np.linalg.inv, "logeuclid": logm, "chol": np.linalg.cholesky}.get(metric)
    if metric == "logchol":
        low = np.linalg.cholesky(x)
        out = np.tril(low, -1)
        i = np.arange(x.shape[-1])
        out[..., i, i] = np.log(low[..., i, i].real)
    elif f is None:
        return None
    else:
        out = f(x)
    out = out.reshape(*out.shape[:-2], -1)
    return np.concatenate([out.real, out.imag], -1) if np.iscomplexobj(out) else out


def eigenvalue_logs(x, y):
    """Logarithms of both eigenvalues of x^-1 y for real 2x2 matrices; x and y broadcast.  The larger one is a sum of positive terms, the other follows from the determinants."""
    a = 1 / np.sqrt(x[..., 0, 0])
    b = -x[..., 1, 0] / x[..., 0, 0]
    det = x[..., 1, 1] + b * x[..., 1, 0]
    c = 1 / np.sqrt(det)
    low = (np.log(x[..., 0, 0]) + np.log(det), np.log(y[..., 0, 0]) + np.log(y[..., 1, 1] - y[..., 1, 0] * (y[..., 1, 0] / y[..., 0, 0])))
    p = a * a * y[..., 0, 0]
    q = a * c * (b * y[..., 0, 0] + y[..., 1, 0])
    r = c * c * (b * (b * y[..., 0, 0] + 2 * y[..., 1, 0]) + y[..., 1, 1])
    q *= q
    half = (p - r) / 2
    half *= half
    half += q
    big = np.log((p + r) / 2 + np.sqrt(half))
    return big, (low[1] - low[0]) - big


def _trace_products(x, y):
    return (x.reshape(len(x), -1) @ np.swapaxes(y, -1, -2).reshape(len(y), -1).T).real


#: Pairs that a closed form takes at a time, so that its temporaries stay in the cache.
CHUNK = 1 << 15


def _closed(x, y, metric):
    """Squared distances (divergences as they are) of all pairs where no loop over matrices is needed, or None."""
    if metric in _plain:
        lx, ly, p = logdet(x)[:, None], logdet(y)[None], x.shape[-1]
        to = lambda: (_trace_products(x, np.linalg.inv(y)) - p + ly - lx) / 2
        back = lambda: (_trace_products(np.linalg.inv(x), y) - p + lx - ly) / 2
        return to() if metric == "kullback" else back() if metric == "kullback_right" else to() + back()
    if x.shape[-1] != 2 or np.iscomplexobj(x) or np.iscomplexobj(y) or metric not in ("riemann", "thompson", "wasserstein", "logdet"):
        return None
    for m in (x, y):
        if not ((m[:, 0, 0] > 0) & (m[:, 0, 0] * m[:, 1, 1] > m[:, 1, 0] ** 2)).all():
            return None
    out, step = np.empty((len(x), len(y))), max(1, CHUNK // max(len(y), 1))
    det = [m[:, 0, 0] * m[:, 1, 1] - m[:, 1, 0] ** 2 for m in (x, y)]
    for at in range(0, len(x), step):
        m, of, d = x[at : at + step], out[at : at + step], det[0][at : at + step, None]
        if metric == "wasserstein":
            t = _trace_products(m, y) + 2 * np.sqrt(d * det[1])
            np.maximum((m[:, 0, 0] + m[:, 1, 1])[:, None] + (y[:, 0, 0] + y[:, 1, 1]) - 2 * np.sqrt(t), 0, out=of)
        elif metric == "logdet":
            a, b, c = ((m[:, i, j, None] + y[:, i, j]) / 2 for i, j in ((0, 0), (1, 0), (1, 1)))
            np.maximum(np.log(a * c - b * b) - (np.log(d) + np.log(det[1])) / 2, 0, out=of)
        else:
            u, v = eigenvalue_logs(m[:, None], y[None])
            of[:] = u * u + v * v if metric == "riemann" else np.maximum(np.abs(u), np.abs(v)) ** 2
    return out


def pairwise(x, y=None, metric="riemann", squared=False):
    """All distances (nx, ny)."""
    own = y is None
    y = x if own else y
    if len(x) and len(y) and (d2 := _closed(x, y, metric)) is not None:
        if metric in _plain:
            return d2**2 if squared else d2
        if own:
            np.fill_diagonal(d2, 0)
        return d2 if squared else np.sqrt(d2, out=d2)
    ex, ey = embed(x, metric), embed(y, metric)
    if ex is not None:
        d2 = np.maximum((ex**2).sum(1)[:, None] + (ey**2).sum(1)[None] - 2 * ex @ ey.T, 0)
        if own:
            np.fill_diagonal(d2, 0)
        return d2 if squared else np.sqrt(d2)
    if metric == "riemann":
        w = invsqrtm(x)
        d2 = np.stack([(np.log(np.linalg.eigvalsh(m @ y @ m)) ** 2).sum(-1) for m in w]) if len(x) else np.zeros((0, len(y)))
        if own:
            d2 = (d2 + d2.T) / 2
            np.fill_diagonal(d2, 0)
        return d2 if squared else np.sqrt(d2)
    return np.stack([distance(m[None], y, metric, squared) for m in x]) if len(x) else np.zeros((0, len(y)))


def mahalanobis(x, cov, mean=None, squared=False):
    """Distance of each column of x to the mean."""
    x = x if mean is None else x - np.asarray(mean).reshape(-1, 1)
    z = invsqrtm(cov) @ x
    d2 = (np.abs(z) ** 2).sum(-2)
    return d2 if squared else np.sqrt(d2)


__all__ = ["METRICS", "ct", "distance", "embed", "mahalanobis", "pairwise"]
