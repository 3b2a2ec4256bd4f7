"""Covariance and spectral estimators from epochs of shape (channels, times)."""

from __future__ import annotations

import math

import numpy as np

from tesserae.kernels.spectral import ct


def scm(x, centered=False, w=None):
    """Population covariance, optionally with weights over time."""
    t = x.shape[-1]
    w = np.full(t, 1 / t) if w is None else np.asarray(w, float) / np.sum(w)
    if not centered:
        x = x - (x * w).sum(-1, keepdims=True)
    return (x * w) @ ct(x)


def cov(x, ddof=1):
    x = x - x.mean(-1, keepdims=True)
    return x @ ct(x) / (x.shape[-1] - ddof)


def corr(x):
    return normalize(cov(x), "corr")


def _empirical(x, centered):
    x = x if centered else x - x.mean(-1, keepdims=True)
    return x, x @ ct(x) / x.shape[-1]


def _shrunk(c, s):
    p = c.shape[-1]
    mu = np.trace(c, axis1=-2, axis2=-1).real / p
    return (1 - s)[..., None, None] * c + (s * mu)[..., None, None] * np.eye(p)


def lwf(x, centered=False):
    """Ledoit-Wolf shrinkage to a scaled identity."""
    p, n = x.shape[-2:]
    x, c = _empirical(x, centered)
    x2 = np.abs(x) ** 2
    mu = np.trace(c, axis1=-2, axis2=-1).real / p
    delta = ((np.abs(c) ** 2).sum((-1, -2)) - p * mu**2) / p
    beta = ((x2.sum(-2) ** 2).sum(-1) / n - (np.abs(c) ** 2).sum((-1, -2))) / (p * n)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where(delta > 0, np.minimum(beta, delta) / delta, 0.0)
    return _shrunk(c, s)


def oas(x, centered=False):
    """Oracle approximating shrinkage (Chen et al. 2010)."""
    p, n = x.shape[-2:]
    _, c = _empirical(x, centered)
    alpha, mu = (np.abs(c) ** 2).mean((-1, -2)), np.trace(c, axis1=-2, axis2=-1).real / p
    num, den = alpha + mu**2, (n + 1) * (alpha - mu**2 / p)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where(den == 0, 1.0, np.minimum(num / den, 1.0))
    return _shrunk(c, s)


def sch(x):
    """Schaefer-Strimmer shrinkage to the diagonal."""
    n = x.shape[-1]
    y = x - x.mean(-1, keepdims=True)
    c = y @ ct(y) / (n - 1)
    s = n * np.sqrt(np.einsum("...ii,...jj->...ij", c, c).real) / n
    r = c / s
    z2 = np.abs(y) ** 2
    v = (z2 @ np.swapaxes(z2, -1, -2) - n * np.abs((n - 1) / n * c) ** 2) * n / (n - 1) ** 3
    off = ~np.eye(x.shape[-2], dtype=bool)
    gamma = (v / s**2 * off).sum((-1, -2)) / ((np.abs(r) ** 2) * off).sum((-1, -2))
    gamma = np.clip(gamma, 0, 1)[..., None, None]
    return np.where(off, (1 - gamma) * c, c)


def _gamma_p(a, x):
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_cdf(x, df):
    return _gamma_p(df / 2, x / 2)


def chi2_ppf(q, df):
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, df) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def m_estimator(x, kind, init=None, tol=1e-2, maxiter=50, centered=False, q=0.9, nu=5, norm="trace"):
    """Fixed point of a robust M-estimator of one epoch: hub, stu or tyl."""
    p, n = x.shape
    x = x if centered else x - x.mean(-1, keepdims=True)
    if kind == "hub":
        c2 = chi2_ppf(q, p) / 2
        b = chi2_cdf(2 * c2, p + 1) + c2 * (1 - q) / p

        def u(d):
            return np.minimum(1.0, c2 / np.maximum(d, 1e-300)) / b
    elif kind == "stu":

        def u(d):
            return (2 * p + nu) / (nu + 2 * d)
    elif kind == "tyl":

        def u(d):
            return p / np.maximum(d, 1e-300)
    else:
        raise ValueError(f"unknown M-estimator {kind!r}")
    c = x @ ct(x) / n if init is None else init
    for _ in range(maxiter):
        d = (np.conj(x) * np.linalg.solve(c, x)).sum(0).real
        new = (x * u(d)) @ ct(x) / n
        crit = np.linalg.norm(new - c) / np.linalg.norm(c)
        c = new
        if crit <= tol:
            break
    if kind == "tyl":
        c = normalize(c, norm)
        c = p * c if norm == "trace" else c
    return c


def mcd(x, support=None, seed=0, trials=30):
    """Fast minimum covariance determinant of one epoch (Rousseeuw and Van Driessen 1999) with consistency and reweighting."""
    p, n = x.shape
    h = int(np.ceil(0.5 * (n + p + 1))) if support is None else int(support * n)
    rng = np.random.default_rng(seed)
    best = (np.inf, None, None)
    for _ in range(trials):
        at = rng.choice(n, min(n, p + 1), replace=False)
        for step in range(30):
            m = x[:, at].mean(1, keepdims=True)
            c = (x[:, at] - m) @ (x[:, at] - m).T / len(at) + 1e-12 * np.eye(p)
            d = ((x - m) * np.linalg.solve(c, x - m)).sum(0)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if len(new) == len(at) and (new == at).all():
                break
            at = new
        m = x[:, at].mean(1, keepdims=True)
        c = (x[:, at] - m) @ (x[:, at] - m).T / len(at)
        det = np.linalg.slogdet(c)[1]
        if det < best[0]:
            best = (det, m, c)
    _, m, c = best
    d = ((x - m) * np.linalg.solve(c, x - m)).sum(0)
    c = c * (np.median(d) / chi2_ppf(0.5, p))
    d = d / (np.median(d) / chi2_ppf(0.5, p))
    use = d < chi2_ppf(0.975, p)
    return np.cov(x[:, use], bias=True).reshape(p, p)


def _each(f):
    return lambda x, **k: np.stack([f(m, **k) for m in x.reshape(-1, *x.shape[-2:])]).reshape(*x.shape[:-1], x.shape[-2])


ESTIMATORS = {
    "scm": scm, "cov": cov, "corr": corr, "lwf": lwf, "oas": oas, "sch": sch, "mcd": _each(mcd),
    **{k: _each(lambda x, k=k, **kw: m_estimator(x, k, **kw)) for k in ("hub", "stu", "tyl")},
}
_REAL = ("lwf", "oas", "mcd")


def covariances(x, estimator="cov", **kw):
    """Covariance of every epoch.  Estimators for real signals take complex ones as [Re; Im] and put the blocks together."""
    f = estimator if callable(estimator) else ESTIMATORS.get(estimator)
    if f is None:
        raise ValueError(f"unknown estimator {estimator!r}; known: {', '.join(ESTIMATORS)}")
    if np.iscomplexobj(x) and estimator in _REAL:
        p = x.shape[-2]
        c = f(np.concatenate([x.real, x.imag], -2), **kw)
        return c[..., :p, :p] + c[..., p:, p:] + 1j * (c[..., p:, :p] - c[..., :p, p:])
    return f(x, **kw)


def covariances_ep(x, prototype, estimator="cov", **kw):
    """Covariance of every epoch with a prototype's rows on top."""
    top = np.broadcast_to(prototype, (*x.shape[:-2], *prototype.shape[-2:]))
    return covariances(np.concatenate([top, x], -2), estimator, **kw)


def covariances_x(x, estimator="cov", alpha=0.2, **kw):
    """Covariance of the double-centred super matrix of epoch, mean row and regulariser."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    p, t = x.shape[-2:]
    hp, ht = np.eye(p) - 1 / p, np.eye(t) - 1 / t
    both = np.concatenate([np.broadcast_to(alpha * np.eye(t), (*x.shape[:-2], t, t))[..., : max(0, 0), :], hp @ x @ ht], -2)
    left = np.broadcast_to(alpha * np.eye(p), (*x.shape[:-2], p, p))
    return covariances(np.concatenate([both, left], -1), estimator, **kw)


def block_covariances(x, blocks, estimator="cov", **kw):
    """Covariance with zeros between blocks of channels."""
    if sum(blocks) != x.shape[-2]:
        raise ValueError("the blocks must add up to the channels")
    out = np.zeros((*x.shape[:-1], x.shape[-2]), x.dtype)
    at = 0
    for n in blocks:
        out[..., at : at + n, at : at + n] = covariances(x[..., at : at + n, :], estimator, **kw)
        at += n
    return out


def sliding(signal, window=128, overlap=0.5, padding=True, inclusive=False):
    """Windows (n, channels, window) of a time-major signal; the last full one only if inclusive."""
    if padding:
        z = np.zeros((window // 2, signal.shape[1]))
        signal = np.concatenate([z, signal, z])
    step = int(window * overlap)
    last = len(signal) - window + (1 if inclusive else 0)
    starts = range(0, max(last, 0), step)
    return np.stack([signal[s : s + window].T for s in starts]) if len(starts) else np.zeros((0, signal.shape[1], window))


def cross_spectrum(x, window=128, overlap=0.75, fmin=None, fmax=None, fs=None):
    """Welch cross-spectra (channels, channels, frequencies) of an epoch, and the frequencies (None without fs)."""
    if not 0 < overlap < 1:
        raise ValueError("overlap must be in (0, 1)")
    window = int(window)
    step = int((1 - overlap) * window)
    n = (x.shape[-1] - window) // step + 1
    if n < 1:
        raise ValueError("the signal is shorter than a window")
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / (window - 1)) if window > 1 else np.ones(1)
    at = np.arange(n)[:, None] * step + np.arange(window)
    f = np.fft.rfft(x[:, at] * taper, axis=-1)
    keep = slice(None)
    freqs = None
    if fs is not None:
        freqs = np.arange(f.shape[-1]) * fs / window
        keep = (freqs >= (0 if fmin is None else fmin)) & (freqs <= (fs / 2 if fmax is None else fmax))
        freqs = freqs[keep]
    elif fmin is not None or fmax is not None:
        raise ValueError("fmin and fmax need fs")
    s = np.einsum("anf,bnf->abf", f, np.conj(f)) / n / (taper**2).sum()
    s[..., 1 : (-1 if window % 2 == 0 else None)] *= 2
    return s[..., keep], freqs


def coherence(x, window=128, overlap=0.75, fmin=None, fmax=None, fs=None, kind="ordinary"):
    """Squared coherence of all channels: ordinary, instantaneous, lagged or imaginary."""
    s, freqs = cross_spectrum(x, window, overlap, fmin, fmax, fs)
    power = np.einsum("aaf->af", s).real
    both = power[:, None] * power[None]
    if kind == "ordinary":
        c = np.abs(s) ** 2 / both
    elif kind == "instantaneous":
        c = s.real**2 / both
    elif kind == "imaginary":
        c = s.imag**2 / both
    elif kind == "lagged":
        with np.errstate(invalid="ignore", divide="ignore"):
            c = s.imag**2 / (both - s.real**2)
        i = np.arange(len(c))
        c[i, i] = 0
        c = np.nan_to_num(c)
    else:
        raise ValueError(f"unknown coherence {kind!r}")
    return c, freqs


def normalize(x, norm):
    """Matrices with unit diagonal (corr), trace or determinant."""
    if norm == "corr":
        d = np.sqrt(np.abs(np.einsum("...ii->...i", x)))
        return x / (d[..., :, None] * d[..., None, :])
    if norm == "trace":
        return x / np.trace(x, axis1=-2, axis2=-1)[..., None, None]
    if norm == "determinant":
        return x / (np.abs(np.linalg.det(x)) ** (1 / x.shape[-1]))[..., None, None]
    raise ValueError(f"unknown norm {norm!r}")


def nondiag_weight(x):
    """Mean squared weight of the off-diagonal against the diagonal."""
    d = (np.abs(np.einsum("...ii->...i", x)) ** 2).sum(-1)
    return ((np.abs(x) ** 2).sum((-1, -2)) - d) / (x.shape[-1] - 1) / d


def shrink(x, s=0.1):
    p = x.shape[-1]
    return (1 - s) * x + s * np.trace(x, axis1=-2, axis2=-1)[..., None, None] / p * np.eye(p)


def channel_kernel(x, kind="linear", gamma=None, degree=3, coef0=1.0):
    """Kernel matrix between the channels of every epoch."""
    gamma = 1 / x.shape[-1] if gamma is None else gamma
    dot = x @ np.swapaxes(x, -1, -2)
    sq = np.einsum("...ii->...i", dot)
    if kind == "linear":
        return dot
    if kind in ("poly", "polynomial"):
        return (gamma * dot + coef0) ** degree
    if kind == "rbf":
        return np.exp(-gamma * np.maximum(sq[..., :, None] + sq[..., None, :] - 2 * dot, 0))
    if kind == "laplacian":
        return np.exp(-gamma * np.abs(x[..., :, None, :] - x[..., None, :, :]).sum(-1))
    if kind == "cosine":
        return dot / np.sqrt(sq[..., :, None] * sq[..., None, :])
    raise ValueError(f"unknown kernel {kind!r}")


def time_delay(x, delays=4):
    """Channels stacked with circularly shifted copies; a number n means shifts 1 .. n-1."""
    shifts = range(1, delays) if isinstance(delays, int) else delays
    return np.concatenate([x, *(np.roll(x, d, axis=-1) for d in shifts)], -2)
