"""Approximate joint diagonalisation of a set of matrices."""

from __future__ import annotations

import numpy as np

from tesserae.kernels.mean import weights
from tesserae.kernels.spectral import ct


def rjd(x, init=None, eps=1e-8, maxiter=100):
    """Orthogonal V such that V^T x V are nearly diagonal, by Givens rotations (Cardoso and Souloumiac)."""
    n, p, _ = x.shape
    v = np.eye(p) if init is None else init
    y = v.T @ x @ v
    for k in range(maxiter):
        turned = False
        for i in range(p - 1):
            for j in range(i + 1, p):
                dif, cross = y[:, i, i] - y[:, j, j], y[:, i, j] + y[:, j, i]
                along, across = dif @ dif - cross @ cross, 2 * (dif @ cross)
                angle = np.arctan2(across, along + np.hypot(along, across)) / 2
                c, s = np.cos(angle), np.sin(angle)
                if abs(s) > eps:
                    turned = True
                    rot = np.array([[c, -s], [s, c]])
                    y[:, :, [i, j]] = y[:, :, [i, j]] @ rot
                    y[:, [i, j], :] = rot.T @ y[:, [i, j], :]
                    v[:, [i, j]] = v[:, [i, j]] @ rot
        if not turned:
            break
    return v, y


def ajd_pham(x, init=None, eps=1e-6, maxiter=20, w=None):
    """B such that B x B^H are nearly diagonal (Pham 2001): pairwise non-orthogonal updates under Kullback-Leibler loss."""
    n, p, _ = x.shape
    w = weights(w, n, positive=True)
    b = np.eye(p, dtype=x.dtype) if init is None else init.copy()
    y = b @ x @ ct(b)
    for _ in range(maxiter):
        crit = 0.0
        for i in range(1, p):
            for j in range(i):
                a, c, d = y[:, i, i].real, y[:, j, j].real, y[:, i, j]
                g_ij, g_ji = (w * d / a).sum(), (w * d / c).sum()
                o_ij, o_ji = (w * c / a).sum(), (w * a / c).sum()
                o = np.sqrt(o_ij * o_ji)
                t1 = (np.sqrt(o_ji / o_ij) * g_ij + g_ji) / (o + 1)
                t2 = (np.sqrt(o_ji / o_ij) * g_ij - g_ji) / max(o - 1, 1e-9)
                h_ij, h_ji = t1 + t2, np.conj((t1 - t2) * np.sqrt(o_ij / o_ji))
                crit += float((w.sum() * (g_ij * np.conj(h_ij) + np.conj(g_ji) * h_ji) / 2).real)
                q = 1 + 0.5j * np.imag(h_ij * h_ji)
                q = q.real if not np.iscomplexobj(x) else q
                q = q + np.sqrt(q * q - h_ij * h_ji + 0j)
                q = q.real if not np.iscomplexobj(x) else q
                t = np.array([[1, -h_ij / q], [-h_ji / q, 1]])
                y[:, [i, j], :] = t @ y[:, [i, j], :]
                y[:, :, [i, j]] = y[:, :, [i, j]] @ ct(t)
                b[[i, j], :] = t @ b[[i, j], :]
        if abs(crit) < eps:
            break
    return b, y


def uwedge(x, init=None, eps=1e-7, maxiter=100):
    """Uniformly weighted exhaustive diagonalisation with Gauss iterations (Tichavsky and Yeredor 2009)."""
    n, p, _ = x.shape
    if init is None:
        w, v = np.linalg.eigh(x[0])
        b = (v / np.sqrt(np.abs(w))).T
    else:
        b = init
    last = np.inf
    for _ in range(maxiter):
        y = b @ x @ b.T
        d = np.einsum("nii->ni", y)
        off = (y**2).sum() - (d**2).sum()
        if abs(last - off) <= eps * max(off, 1e-300) and last != np.inf:
            break
        last = off
        dd = d.T @ d
        c1 = np.einsum("nij,nj->ij", y, d)
        det = np.outer(np.diag(dd), np.diag(dd)) - dd**2 + np.eye(p)
        a = (np.diag(dd)[:, None] * c1 - dd * c1.T) / det
        a = a / np.diag(dd)[:, None] * np.diag(dd)[:, None]
        np.fill_diagonal(a, 1)
        b = np.linalg.solve(a, b)
        y0 = b @ x[0] @ b.T
        b = b / np.sqrt(np.abs(np.diag(y0)))[:, None]
    return b, b @ x @ b.T


def ajd(x, method="ajd_pham", init=None, eps=1e-6, maxiter=100, w=None):
    if callable(method):
        return method(x)
    if method == "ajd_pham":
        return ajd_pham(x, init, eps, maxiter, w)
    if method == "rjd":
        return rjd(x, init, eps, maxiter)
    if method == "uwedge":
        return uwedge(x, init, eps, maxiter)
    raise ValueError(f"unknown method {method!r}")
