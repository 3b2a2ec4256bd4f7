"""Geodesics, exponential and logarithmic maps, tangent vectors, inner products, transport and kernels."""

from __future__ import annotations

import math

import numpy as np

from tesserae.kernels.spectral import ct, ddexpm, ddlogm, eig_apply, eigvals_pencil, expm, invsqrtm, logm, powm, roots, sqrtm, sym

SQ2 = np.sqrt(2)


def _diag(x):
    return np.diagonal(x, axis1=-2, axis2=-1)


def _with_diag(low, d):
    out = np.tril(low, -1)
    i = np.arange(low.shape[-1])
    out = np.broadcast_to(out, np.broadcast_shapes(out.shape, (*d.shape, d.shape[-1]))).copy()
    out[..., i, i] = d
    return out


def _half(x):
    """Lower triangle with half the diagonal."""
    return _with_diag(x, _diag(x) / 2)


def _alpha(alpha):
    alpha = np.asarray(alpha, float)
    return alpha[..., None, None] if alpha.ndim else alpha


def geodesic(a, b, alpha=0.5, metric="riemann"):
    """The point at alpha on the geodesic from a (0) to b (1); alpha may be an array over the stack."""
    t = _alpha(alpha)
    if callable(metric):
        return metric(a, b, alpha)
    if metric == "euclid":
        return (1 - t) * a + t * b
    if metric == "chol":
        low = (1 - t) * np.linalg.cholesky(a) + t * np.linalg.cholesky(b)
        return low @ ct(low)
    if metric == "logchol":
        la, lb = np.linalg.cholesky(a), np.linalg.cholesky(b)
        td = t[..., 0] if np.ndim(t) else t
        low = _with_diag((1 - t) * la + t * lb, _diag(la).real ** (1 - td) * _diag(lb).real ** td)
        return low @ ct(low)
    if metric == "logeuclid":
        return expm((1 - t) * logm(a) + t * logm(b))
    if metric == "riemann":
        r, s = roots(a)
        w, v = np.linalg.eigh(sym(s @ b @ s))
        return sym(r @ ((v * w[..., None, :] ** t) @ ct(v)) @ r)
    if metric == "thompson":
        w = eigvals_pencil(b, a)
        low, high = w[..., :1, None], w[..., -1:, None]
        near = np.isclose(low, high)
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (high**t - low**t) / (high - low) * b + (high * low**t - low * high**t) / (high - low) * a
        return np.where(near, low**t * a, mixed)
    if metric == "wasserstein":
        r, s = roots(a)
        m = r @ sqrtm(sym(r @ b @ r)) @ s
        return sym((1 - t) ** 2 * a + t**2 * b + t * (1 - t) * (m + ct(m)))
    raise ValueError(f"no geodesic for metric {metric!r}")


def step2(a, b, alpha):
    """(distance, geodesic from a at alpha) under the riemann metric for one pair of real symmetric 2x2 matrices, as sequences of four, in plain numbers: what a stream does row by row."""
    a0, a1, a2, b0, b1, b2 = a[0], a[1], a[3], b[0], b[1], b[3]
    u, v = 1 / math.sqrt(a0), -a1 / a0
    d = a2 + v * a1
    w = 1 / math.sqrt(d)
    p, q, r = u * u * b0, u * w * (v * b0 + b1), w * w * (v * (v * b0 + 2 * b1) + b2)
    half, off = (p + r) / 2, math.hypot((p - r) / 2, q)
    big = half + off
    small = b0 * (b2 - b1 * (b1 / b0)) / (a0 * d) / big
    x, y = math.log(big), math.log(small)
    # with m = a^-1 b, a m^alpha = c0 a + c1 b
    gap = x - y
    top, ratio = big**alpha, math.expm1(-alpha * gap) / math.expm1(-gap) if gap > 1e-8 else alpha
    c1 = top / big * ratio
    c0 = top - c1 * big
    m1 = c0 * a1 + c1 * b1
    return math.hypot(x, y), (c0 * a0 + c1 * b0, m1, m1, c0 * a2 + c1 * b2)


def log_map(x, ref, metric="riemann"):
    """Tangent vector at ref towards x.  The riemann one is in whitened coordinates: log(ref^-1/2 x ref^-1/2)."""
    if callable(metric):
        return metric(x, ref)
    if metric == "euclid":
        return x - ref
    if metric == "logeuclid":
        base = logm(ref)
        return ddexpm(logm(x) - base, base)
    if metric == "riemann":
        s = invsqrtm(ref)
        return logm(sym(s @ x @ s))
    if metric == "logchol":
        p, q = np.linalg.cholesky(ref), np.linalg.cholesky(x)
        d = _diag(p).real
        step = _with_diag(q - p, d * (np.log(_diag(q).real) - np.log(d)))
        return p @ ct(step) + step @ ct(p)
    if metric == "wasserstein":
        r, s = roots(ref)
        m = r @ sqrtm(sym(r @ x @ r)) @ s
        return m + ct(m) - 2 * ref
    raise ValueError(f"no log map for metric {metric!r}")


def exp_map(t, ref, metric="riemann"):
    """Inverse of log_map."""
    if callable(metric):
        return metric(t, ref)
    if metric == "euclid":
        return t + ref
    if metric == "logeuclid":
        return expm(logm(ref) + ddlogm(t, ref))
    if metric == "riemann":
        r = sqrtm(ref)
        return sym(r @ expm(t) @ r)
    if metric == "logchol":
        p = np.linalg.cholesky(ref)
        inner = np.linalg.solve(p, t)
        inner = _half(ct(np.linalg.solve(p, ct(inner))))
        step = p @ inner
        d = _diag(p).real
        low = _with_diag(p + step, d * np.exp(_diag(step).real / d))
        return low @ ct(low)
    if metric == "wasserstein":
        w, v = np.linalg.eigh(ref)
        c = ct(v) @ t @ v / (w[..., :, None] + w[..., None, :])
        inner = v @ c @ ct(v)
        return ref + t + inner @ ref @ inner
    raise ValueError(f"no exponential map for metric {metric!r}")


def upper(x):
    """Upper triangles row by row, off-diagonal entries times sqrt(2): length p(p+1)/2."""
    p = x.shape[-1]
    i, j = np.triu_indices(p)
    return x[..., i, j] * np.where(i == j, 1, SQ2)


def unupper(v):
    """Hermitian matrices of upper()'s vectors."""
    p = int((np.sqrt(8 * v.shape[-1] + 1) - 1) / 2)
    if p * (p + 1) // 2 != v.shape[-1]:
        raise ValueError(f"{v.shape[-1]} isn't p(p+1)/2")
    i, j = np.triu_indices(p)
    out = np.zeros((*v.shape[:-1], p, p), v.dtype)
    x = v / np.where(i == j, 1, SQ2)
    out[..., j, i] = np.conj(x)
    out[..., i, j] = x
    return out


def tangent_space(x, ref, metric="riemann"):
    return upper(log_map(x, ref, metric))


def untangent_space(v, ref, metric="riemann"):
    return exp_map(unupper(v), ref, metric)


def inner(x, y, ref, metric="riemann"):
    """Inner product of tangent vectors at ref."""
    if metric == "logchol":
        p = np.linalg.cholesky(ref)

        def split(t):
            half = _half(ct(np.linalg.solve(p, ct(np.linalg.solve(p, t)))))
            step = p @ half
            return np.tril(step, -1), _diag(step).real / _diag(p).real

        (lx, dx), (ly, dy) = split(x), split(y)
        return (np.conj(lx) * ly).real.sum((-1, -2)) + (dx * dy).sum(-1)
    if metric == "riemann":
        s = invsqrtm(ref)
        x, y = s @ x @ s, s @ y @ s
    elif metric == "logeuclid":
        x, y = ddlogm(x, ref), ddlogm(y, ref)
    elif metric != "euclid":
        raise ValueError(f"no inner product for metric {metric!r}")
    return (np.conj(x) * y).real.sum((-1, -2))


def norm(x, ref, metric="riemann"):
    return np.sqrt(inner(x, x, ref, metric))


def transport(x, a, b, metric="riemann"):
    """Parallel transport of tangent vectors from a to b."""
    if metric == "euclid":
        return x
    if metric == "logeuclid":
        return ddexpm(ddlogm(x, a), logm(b))
    if metric == "riemann":
        r, s = roots(a)
        e = r @ sqrtm(sym(s @ b @ s)) @ s
        return e @ x @ ct(e)
    if metric == "logchol":
        p, q = np.linalg.cholesky(a), np.linalg.cholesky(b)
        step = p @ _half(ct(np.linalg.solve(p, ct(np.linalg.solve(p, x)))))
        moved = _with_diag(step, _diag(q).real / _diag(p).real * _diag(step).real)
        return q @ ct(moved) + moved @ ct(q)
    raise ValueError(f"no transport for metric {metric!r}")


def features(x, ref=None, metric="riemann"):
    """Matrices whose trace products are the kernel."""
    if metric == "euclid":
        return x if ref is None else x - ref
    if metric == "logeuclid":
        return logm(x) if ref is None else logm(x) - logm(ref)
    if metric == "riemann":
        s = invsqrtm(ref)
        return logm(sym(s @ x @ s))
    raise ValueError(f"no kernel for metric {metric!r}")


def kernel(x, y=None, ref=None, metric="riemann", reg=1e-10):
    """Gram matrix tr(f(x_i) f(y_j)); reg is added to the diagonal if y isn't given.  riemann without ref uses the mean of x."""
    if metric == "riemann" and ref is None:
        from tesserae.kernels.mean import mean

        ref = mean(x, "riemann")[0]
    fx = features(x, ref, metric)
    fy = fx if y is None else features(y, ref, metric)
    k = (fx.reshape(len(fx), -1) @ np.conj(fy.reshape(len(fy), -1)).T).real
    if y is None:
        k[np.arange(len(k)), np.arange(len(k))] += reg
    return k


__all__ = ["eig_apply", "exp_map", "features", "geodesic", "inner", "kernel", "log_map", "norm", "powm", "tangent_space", "transport", "untangent_space", "unupper", "upper"]
