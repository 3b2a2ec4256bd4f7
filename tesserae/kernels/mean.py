"""Means and medians of positive definite matrices.

Every mean is one of three kinds, which the distributed layer uses too:

- direct: average f(x), then apply g (MAPPED);
- iterative: repeat "average a row-local term given the state, then update" (STEPS);
- whole-set: recursive or ordered ones that need all matrices at once.
"""

from __future__ import annotations

import numpy as np

from tesserae.kernels.distance import distance
from tesserae.kernels.geometry import exp_map, geodesic, log_map
from tesserae.kernels.spectral import ct, expm, invsqrtm, logm, powm, roots, sqrtm, sym


def weights(w, n, positive=False):
    """Weights with sum 1; None: equal ones."""
    if w is None:
        return np.full(n, 1 / max(n, 1))
    w = np.asarray(w, float)
    if w.shape != (n,):
        raise ValueError(f"{n} weights are needed, not {w.shape}")
    if positive and (w <= 0).any():
        raise ValueError("weights must be positive")
    return w / w.sum()


def average(x, w):
    return np.tensordot(w, x, 1)


def _logchol_to(x):
    low = np.linalg.cholesky(x)
    i = np.arange(x.shape[-1])
    out = low.copy()
    out[..., i, i] = np.log(low[..., i, i].real)
    return out


def _logchol_from(m):
    low = m.copy()
    i = np.arange(m.shape[-1])
    low[..., i, i] = np.exp(m[..., i, i].real)
    return low @ ct(low)


def _square(low):
    return low @ ct(low)


#: name: (row-local function, function of the average).
MAPPED = {
    "euclid": (lambda x: x, lambda m: m),
    "harmonic": (np.linalg.inv, np.linalg.inv),
    "logeuclid": (logm, expm),
    "chol": (np.linalg.cholesky, _square),
    "logchol": (_logchol_to, _logchol_from),
}


def mapped(metric, p=None):
    """The pair of functions of a direct mean; poweuclid and power take an exponent."""
    if metric == "poweuclid":
        if p in (1, 0, -1):
            return MAPPED[{1: "euclid", 0: "logeuclid", -1: "harmonic"}[p]]
        return (lambda x: powm(x, p), lambda m: powm(m, 1 / p))
    if metric == "power" and p in (1, -1):
        return MAPPED["euclid" if p == 1 else "harmonic"]
    return MAPPED.get(metric)


class Step:
    """An iterative mean: term(x) is averaged for the state, update(average) moves it and says whether that was the last step."""

    tol, maxiter, start = 1e-8, 50, "euclid"

    def __init__(self, state, tol=None, maxiter=None):
        self.m = state
        self.tol = self.tol if tol is None else tol
        self.maxiter = self.maxiter if maxiter is None else maxiter
        self.n_iter, self.converged = 0, False
        self.prepare()

    def prepare(self):
        pass

    def done(self, small) -> bool:
        self.n_iter += 1
        self.converged = bool(small)
        return self.converged or self.n_iter >= self.maxiter


class RiemannStep(Step):
    """Gradient descent with a step that shrinks when the gradient doesn't."""

    def prepare(self):
        self.nu, self.last = 1.0, np.finfo(float).max
        self.r, self.s = roots(self.m)

    def term(self, x):
        return logm(sym(self.s @ x @ self.s))

    def update(self, avg):
        self.m = sym(self.r @ expm(self.nu * avg) @ self.r)
        self.r, self.s = roots(self.m)
        crit = np.linalg.norm(avg)
        if self.nu * crit < self.last:
            self.nu, self.last = 0.95 * self.nu, self.nu * crit
        else:
            self.nu *= 0.5
        return self.done(crit <= self.tol or self.nu <= self.tol)


class LogdetStep(Step):
    tol = 1e-4

    def term(self, x):
        return np.linalg.inv((x + self.m) / 2)

    def update(self, avg):
        new = np.linalg.inv(avg)
        crit = np.linalg.norm(new - self.m)
        self.m = new
        return self.done(crit <= self.tol)


class WassersteinStep(Step):
    def prepare(self):
        self.r, self.s = roots(self.m)

    def term(self, x):
        m = self.r @ sqrtm(sym(self.r @ x @ self.r)) @ self.s
        return m + ct(m) - 2 * self.m

    def update(self, avg):
        self.m = sym(exp_map(avg, self.m, "wasserstein"))
        self.prepare()
        return self.done(np.linalg.norm(avg) <= self.tol)


class PowerStep(Step):
    """Fixed point of the power mean of order p in (-1, 1) without 0."""

    tol, maxiter = 1e-9, 100

    def __init__(self, state, p, tol=None, maxiter=None):
        self.p = p
        super().__init__(state, tol, maxiter)

    def prepare(self):
        self.phi = 0.375 / abs(self.p)
        self.k = invsqrtm(self.m) if self.p > 0 else sqrtm(self.m)

    def term(self, x):
        y = x if self.p > 0 else np.linalg.inv(x)
        return powm(sym(self.k @ y @ ct(self.k)), abs(self.p))

    def update(self, avg):
        n = avg.shape[-1]
        self.k = powm(avg, -self.phi) @ self.k
        inv = np.linalg.inv(self.k)
        self.m = sym(inv @ ct(inv)) if self.p > 0 else sym(ct(self.k) @ self.k)
        return self.done(np.linalg.norm(avg - np.eye(n)) / np.sqrt(n) <= self.tol)


def step(metric, state, p=None, tol=None, maxiter=None):
    """The iterative mean of this name, or None."""
    if metric == "power":
        if not -1 <= p <= 1:
            raise ValueError("the exponent must be in [-1, 1]")
        return RiemannStep(state, tol, maxiter) if p == 0 else PowerStep(state, p, tol, maxiter)
    kind = {"riemann": RiemannStep, "logdet": LogdetStep, "wasserstein": WassersteinStep}.get(metric)
    return kind and kind(state, tol, maxiter)


def _iterate(x, w, s):
    while not s.update(average(s.term(x), w)):
        pass
    return s.m, s.n_iter, s.converged


def mean_thompson(x, tol=1e-6, maxiter=50, init=None):
    """Walk over the matrices in order with steps 1/(i+2); order matters, weights don't exist."""
    m = x[0] if init is None else init
    for i in range(maxiter):
        new = geodesic(m, x[(i + (init is None)) % len(x)], 1 / (i + 2), "thompson")
        crit = distance(m, new, "thompson")
        m = new
        if crit <= tol:
            return m, i + 1, True
    return m, maxiter, False


def mean_ale(x, w, tol=1e-6, maxiter=50, init=None):
    """Log-Euclidean mean in the coordinates of an approximate joint diagonaliser, refined until it stops moving."""
    from tesserae.kernels.ajd import ajd_pham

    b = ajd_pham(x)[0] if init is None else init
    for k in range(maxiter):
        d = np.real(np.diag(expm(average(logm(sym(b @ x @ ct(b))), w))))
        b = d[:, None] ** -0.5 * b
        crit = np.linalg.norm(np.log(d))
        if crit <= tol:
            break
    a = np.linalg.inv(b)
    j = expm(average(logm(sym(b @ x @ ct(b))), w))
    return sym(a @ j @ ct(a)), k + 1, crit <= tol


def _recursive(x, w, tol, maxiter, move, small=8):
    """Means that replace every matrix by a point between it and the mean of the others, until they meet."""
    n = len(x)
    if n == 1:
        return x[0], 0, True
    if n == 2:
        return geodesic(x[0], x[1], w[1] / (w[0] + w[1])), 1, True
    if n > small:
        raise ValueError(f"the cost grows with the factorial of the number of matrices; {n} is more than {small}")
    y = x
    for k in range(maxiter):
        others = [np.delete(np.arange(n), i) for i in range(n)]
        means = [_recursive(y[o], w[o] / w[o].sum(), tol, maxiter, move, small)[0] for o in others]
        new = np.stack([move(y[i], means[i], n) for i in range(n)])
        crit = np.linalg.norm(new - y) / np.linalg.norm(y)
        y = new
        if crit <= tol:
            return average(y, w), k + 1, True
    return average(y, w), maxiter, False


def mean_alm(x, w, tol=1e-10, maxiter=100):
    return _recursive(x, w, tol, maxiter, lambda a, m, n: m)


def mean_bmp(x, w, tol=1e-7, maxiter=50):
    return _recursive(x, w, tol, maxiter, lambda a, m, n: geodesic(a, m, (n - 1) / n))


def mean_cheap(x, w, tol=1e-7, maxiter=50):
    """Every matrix moves to its own log-map average, until all meet."""
    if len(x) == 2:
        return geodesic(x[0], x[1], w[1] / (w[0] + w[1])), 1, True
    y = x
    for k in range(maxiter):
        new = []
        for m in y:
            r, s = roots(m)
            new.append(sym(r @ expm(average(logm(sym(s @ y @ s)), w)) @ r))
        new = np.stack(new)
        crit = np.linalg.norm(new - y) / np.linalg.norm(y)
        y = new
        if crit <= tol:
            return average(y, w), k + 1, True
    return average(y, w), maxiter, False


MEANS = ("ale", "alm", "bmp", "cheap", "chol", "euclid", "harmonic", "kullback_sym", "logchol", "logdet", "logeuclid", "power", "poweuclid", "riemann", "thompson", "wasserstein")


def mean(x, metric="riemann", w=None, p=None, init=None, tol=None, maxiter=None):
    """(mean, number of iterations, converged) of the stack x."""
    x = np.asarray(x)
    if callable(metric):
        return metric(x, w), 0, True
    w = weights(w, len(x))
    if f := mapped(metric, p):
        return f[1](average(f[0](x), w)), 1, True
    if metric == "kullback_sym":
        return geodesic(mean(x, "euclid", w)[0], mean(x, "harmonic", w)[0], 0.5), 1, True
    given = {k: v for k, v in (("tol", tol), ("maxiter", maxiter)) if v is not None}
    if metric == "thompson":
        return mean_thompson(x, init=init, **given)
    if metric == "ale":
        return mean_ale(x, w, init=init, **given)
    if metric in ("alm", "bmp", "cheap"):
        return {"alm": mean_alm, "bmp": mean_bmp, "cheap": mean_cheap}[metric](x, w, **given)
    s = step(metric, average(x, w) if init is None else init, p, tol, maxiter)
    if s is None:
        raise ValueError(f"unknown mean {metric!r}; known: {', '.join(MEANS)}")
    return _iterate(x, w, s)


def masks_from_nan(x):
    """For every matrix, the rows that are there; a row must be missing together with its column."""
    gone = np.isnan(x)
    if (gone != np.swapaxes(gone, -1, -2)).any():
        raise ValueError("missing values must be symmetric")
    keep = ~np.einsum("...ii->...i", gone)
    if (gone != ~(keep[..., :, None] & keep[..., None, :])).any():
        raise ValueError("a row with missing values must be missing as a whole")
    return keep


def masked_term(m, x, mask):
    """Log map of one masked matrix at the mean, in the full space."""
    sub = mask.T @ m @ mask
    r, s = roots(sub)
    return mask @ r @ logm(sym(s @ x @ s)) @ r @ mask.T


def maskedmean_riemann(x, masks, w=None, tol=1e-8, maxiter=100, init=None):
    """Riemannian mean of matrices seen through semi-orthogonal masks (p x m_i)."""
    p = masks[0].shape[0]
    xs = [m.T @ a @ m for a, m in zip(x, masks)]
    w = weights(w, len(xs))
    m = np.eye(p) if init is None else init
    nu, last, k = 1.0, np.inf, 0
    while True:
        grad = sum(wi * masked_term(m, a, q) for wi, a, q in zip(w, xs, masks))
        r, s = roots(m)
        m = sym(r @ expm(nu * sym(s @ grad @ s)) @ r)
        crit, k = np.linalg.norm(grad), k + 1
        if nu * crit < last:
            nu, last = 0.95 * nu, nu * crit
        else:
            nu *= 0.5
        if crit <= tol or nu <= tol or k >= maxiter:
            return m, k, crit <= tol or nu <= tol


def nanmean_riemann(x, w=None, tol=1e-8, maxiter=100):
    keep = masks_from_nan(x)
    p = x.shape[-1]
    masks = [np.eye(p)[:, k] for k in keep]
    with np.errstate(invalid="ignore"):
        init = np.where(np.isnan(x).all(0), 0, np.nansum(x, 0) / np.maximum((~np.isnan(x)).sum(0), 1)) + 1e-6 * np.eye(p)
    return maskedmean_riemann(np.nan_to_num(x), masks, w, tol, maxiter, init)


def median(x, metric="riemann", w=None, tol=1e-5, maxiter=50, step_size=1.0, init=None):
    """Geometric median by Weiszfeld steps; coincident points are handled as Vardi and Zhang do (euclid) or left out (riemann)."""
    if metric not in ("euclid", "riemann"):
        raise ValueError("medians are euclid or riemann")
    if not 0 < step_size <= 2:
        raise ValueError("step_size must be in (0, 2]")
    w = weights(w, len(x), positive=True)
    m = average(x, w) if init is None else init
    for k in range(maxiter):
        new = median_update(m, *median_sums(m, x, w, metric), metric, step_size)
        crit = np.linalg.norm(new - m) / np.linalg.norm(m)
        m = new
        if crit <= tol:
            return m, k + 1, True
    return m, maxiter, False


def median_sums(m, x, w, metric):
    """Sum of w/d * point (or log map), sum of w/d, and weight at distance 0; additive over rows."""
    d = distance(x, m, metric)
    off = d > 1e-10
    u = np.where(off, w / np.where(off, d, 1), 0)
    y = x if metric == "euclid" else log_map(x, m)
    return np.tensordot(u, y, 1), u.sum(), w[~off].sum()


def median_update(m, total, inverse, at_zero, metric, step_size):
    if inverse == 0:
        return m
    t = total / inverse
    if metric == "riemann":
        return exp_map(step_size * t, m)
    if at_zero == 0:
        return t
    r = np.linalg.norm(total - inverse * m)
    share = 1.0 if r == 0 else min(1.0, at_zero / r)
    return (1 - share) * t + share * m
