"""Functions of matrices through one eigendecomposition, and predicates."""

from __future__ import annotations

import numpy as np


def ct(x):
    """Conjugate transpose of the last two axes."""
    return np.conj(np.swapaxes(x, -1, -2))


def sym(x):
    return (x + ct(x)) / 2


def eig_apply(x, *functions):
    """f(x) for each function of the eigenvalues, all from one decomposition."""
    x = np.asarray(x)
    if x.ndim < 2 or x.shape[-1] != x.shape[-2]:
        raise ValueError("square matrices are needed")
    if not np.isfinite(x).all():
        raise ValueError("matrices have values that aren't finite; are they positive definite?")
    w, v = np.linalg.eigh(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = [(v * f(w)[..., None, :]) @ ct(v) for f in functions]
    return out[0] if len(out) == 1 else out


def expm(x):
    return eig_apply(x, np.exp)


def logm(x):
    return eig_apply(x, np.log)


def sqrtm(x):
    return eig_apply(x, np.sqrt)


def invsqrtm(x):
    return eig_apply(x, lambda w: 1 / np.sqrt(w))


def powm(x, alpha):
    return eig_apply(x, lambda w: w**alpha)


def roots(x):
    """Square root and inverse square root."""
    return eig_apply(x, np.sqrt, lambda w: 1 / np.sqrt(w))


def eigvals_pencil(a, b):
    """Eigenvalues of b^-1 a, ascending."""
    low = np.linalg.cholesky(b)
    y = np.linalg.solve(low, np.broadcast_to(a, np.broadcast_shapes(a.shape, low.shape)))
    return np.linalg.eigvalsh(sym(np.linalg.solve(low, ct(y))))


def logdet(x):
    return np.linalg.slogdet(x)[1]


def nearest_spd(x, reg=1e-6):
    """Positive definite matrix near x: symmetric part averaged with its polar factor, then lifted until it is well conditioned."""
    b = sym(np.asarray(x, dtype=complex if np.iscomplexobj(x) else float))
    w, v = np.linalg.eigh(b)
    near = sym((b + (v * np.abs(w)[..., None, :]) @ ct(v)) / 2)
    w, v = np.linalg.eigh(near)
    w = np.where(w < np.spacing(np.abs(w).max(-1, keepdims=True)), 0, w)
    low = w[..., :1] <= reg * w[..., -1:]
    return (v * np.where(low, w + reg, w)[..., None, :]) @ ct(v)


def divided_difference(w, f, df, tol=1e-12):
    """(f(wi) - f(wj)) / (wi - wj), and f'(wi) where both are equal."""
    a, b = w[..., :, None], w[..., None, :]
    close = np.isclose(a, b, rtol=tol, atol=tol)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(close, df(np.broadcast_to(a, close.shape)), (f(a) - f(b)) / np.where(close, 1, a - b))


def _directional(x, ref, f, df):
    w, v = np.linalg.eigh(ref)
    return v @ (divided_difference(w, f, df) * (ct(v) @ x @ v)) @ ct(v)


def ddexpm(x, ref):
    """Derivative of the matrix exponential at ref in direction x."""
    return _directional(x, ref, np.exp, np.exp)


def ddlogm(x, ref):
    """Derivative of the matrix logarithm at ref in direction x."""
    return _directional(x, ref, np.log, lambda w: 1 / w)


def is_square(x):
    return x.ndim >= 2 and x.shape[-1] == x.shape[-2]


def _close(a, b):
    return np.isclose(a, b).all((-1, -2))


def is_sym(x):
    return _close(x, np.swapaxes(x, -1, -2)) if is_square(x) else np.zeros(x.shape[:-2], bool)


def is_skew_sym(x):
    return _close(x, -np.swapaxes(x, -1, -2)) if is_square(x) else np.zeros(x.shape[:-2], bool)


def is_hankel(x):
    """Constant along anti-diagonals."""
    if not is_square(x):
        return np.zeros(x.shape[:-2], bool)
    return np.isclose(x[..., 1:, :-1], x[..., :-1, 1:]).all((-1, -2))


def is_real_type(x):
    return not np.iscomplexobj(x)


def is_real(x):
    return np.isclose(np.imag(x), 0).all((-1, -2))


def is_hermitian(x):
    return is_sym(np.real(x)) & is_skew_sym(np.imag(x))


def is_pos_def(x, tol=0.0):
    return (np.linalg.eigvals(x).real > tol).all(-1) if is_square(x) else np.zeros(x.shape[:-2], bool)


def is_pos_semi_def(x):
    return (np.linalg.eigvals(x).real >= 0).all(-1) if is_square(x) else np.zeros(x.shape[:-2], bool)


def is_spd(x, tol=0.0):
    return is_sym(x) & is_pos_def(x, tol)


def is_spsd(x):
    return is_sym(x) & is_pos_semi_def(x)


def is_hpd(x, tol=0.0):
    return is_hermitian(x) & is_pos_def(x, tol)


def is_hpsd(x):
    return is_hermitian(x) & is_pos_semi_def(x)


PREDICATES = {
    "sym": is_sym, "skew_sym": is_skew_sym, "hankel": is_hankel, "real": is_real, "hermitian": is_hermitian, "pos_def": is_pos_def,
    "pos_semi_def": is_pos_semi_def, "spd": is_spd, "spsd": is_spsd, "hpd": is_hpd, "hpsd": is_hpsd,
}
