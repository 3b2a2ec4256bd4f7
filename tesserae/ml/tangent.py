"""Tangent space projection, discriminant filtering and whitening."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.frames import apply
from tesserae.kernels import geometry as G
from tesserae.kernels.spectral import sym
from tesserae.ml.base import Estimator, metric_of
from tesserae.operators.means import mean, sums


class TangentSpace(Estimator):
    """Vectors of length p(p+1)/2 at the set's mean.  tsupdate: at the mean of the set that is transformed.  Before fit: at the identity."""

    def __init__(self, metric="riemann", tsupdate=False):
        self.metric, self.tsupdate = metric, tsupdate

    def fit(self, df: DataFrame, weight: str | None = None, col: str = "cov") -> TangentSpace:
        self.reference_ = mean(df, metric_of(self.metric, "mean"), col, weight)
        return self

    def _reference(self, df, col):
        return mean(df, metric_of(self.metric, "mean"), col) if self.tsupdate else getattr(self, "reference_", None)

    def transform(self, df, col="cov", out="tangent"):
        ref, m = self._reference(df, col), metric_of(self.metric, "map")
        return apply(df, [col], {out: "vector"}, lambda x: G.tangent_space(x, np.eye(x.shape[-1]) if ref is None else ref, m))

    def inverse_transform(self, df, col="tangent", out="cov"):
        ref, m = self.reference_, metric_of(self.metric, "map")
        n = len(ref) * (len(ref) + 1) // 2
        keep = [c for c in df.columns if c != out]
        return apply(df, [col], {out: "matrix"}, lambda v: G.untangent_space(v, ref, m), keep, shapes={col: (n,)})


class FGDA(Estimator):
    """Projection onto the discriminant directions in the tangent space, and back to matrices."""

    def __init__(self, metric="riemann", tsupdate=False):
        self.metric, self.tsupdate = metric, tsupdate

    def fit(self, df, y="y", weight=None, col="cov"):
        df = df.where(F.col(y).isNotNull())
        self.ts_ = TangentSpace(self.metric, self.tsupdate).fit(df, weight, col)
        t = self.ts_.transform(df, col)
        rows = t.select(F.col(y).cast("string").alias("key"), F.lit(1.0).alias("w"), F.col("tangent").alias("m")).persist()

        def moments(v, k):
            return np.concatenate([v, (v[:, :, None] * v[:, None]).reshape(len(v), -1), (v[:, :, None] ** 2 * v[:, None] ** 2).reshape(len(v), -1)], 1)

        got = sums(rows, moments, vectors=True)
        rows.unpersist()
        m = len(next(iter(got.values()))[1])
        d = int((-1 + np.sqrt(1 + 8 * m)) / 4)
        n = sum(w for w, _ in got.values())
        centres = {k: s[:d] / w for k, (w, s) in got.items()}
        within = sum(s[d : d + d * d].reshape(d, d) - w * np.outer(centres[k], centres[k]) for k, (w, s) in got.items()) / n
        within = within + 1e-12 * np.trace(within) / d * np.eye(d)
        mu = np.trace(within) / d
        delta = ((within - mu * np.eye(d)) ** 2).sum()
        fourth = sum(np.trace(s[d + d * d :].reshape(d, d)) for _, s in got.values()) / n
        beta = min(max(fourth - (within**2).sum(), 0) / n, delta)
        s = beta / delta if delta else 0.0
        shrunk = (1 - s) * within + s * mu * np.eye(d)
        w = np.linalg.solve(shrunk, np.stack([centres[k] for k in sorted(centres)]).T).T
        w = w - w.mean(0) if len(w) > 1 else w
        if len(w) == 2:
            w = w[1:] - w[:1]
        self.coef_ = w
        self.proj_ = w.T @ np.linalg.pinv(w.T)
        return self

    def transform(self, df, col="cov"):
        ref, m, proj = self.ts_._reference(df, col), metric_of(self.metric, "map"), self.proj_
        return apply(df, [col], {"__f": "matrix"}, lambda x: sym(G.untangent_space(G.tangent_space(x, ref, m) @ proj.T, ref, m))).drop(col).withColumnRenamed("__f", col).select(*df.columns)


class Whitening(Estimator):
    """Inverse square root of the mean, with optional reduction: dim_red is {"n_components": n}, {"expl_var": share} or {"max_cond": number}."""

    def __init__(self, metric="euclid", dim_red=None):
        self.metric, self.dim_red = metric, dim_red

    def fit(self, df, weight=None, col="cov"):
        self.n_seen_ = df.where(F.col(col).isNotNull()).count()
        return self._from_mean(mean(df, self.metric, col, weight))

    def _from_mean(self, m):
        self.mean_ = m
        w, v = np.linalg.eigh(m)
        w, v = w[::-1], v[:, ::-1]
        n = len(w)
        if self.dim_red:
            if not isinstance(self.dim_red, dict) or len(self.dim_red) != 1:
                raise ValueError("dim_red is a dict with one key")
            (kind, value), = self.dim_red.items()
            if kind == "n_components":
                if value < 1:
                    raise ValueError("n_components must be at least 1")
                n = min(n, int(value))
            elif kind == "expl_var":
                if not 0 < value <= 1:
                    raise ValueError("expl_var must be in (0, 1]")
                n = int(np.searchsorted(np.cumsum(w) / w.sum(), value - 1e-12)) + 1
            elif kind == "max_cond":
                if value <= 1:
                    raise ValueError("max_cond must be above 1")
                n = int((w[0] / w <= value).sum())
            else:
                raise ValueError(f"unknown dim_red {kind!r}")
        self.n_components_ = n
        self.filters_ = v[:, :n] / np.sqrt(w[:n])
        self.inv_filters_ = (v[:, :n] * np.sqrt(w[:n])).T
        return self

    def partial_fit(self, df, weight=None, col="cov", alpha=None):
        """Moves the mean towards the batch's along the geodesic, by alpha or by the batch's share of all rows so far."""
        n = df.where(F.col(col).isNotNull()).count()
        if not n:
            return self
        if not hasattr(self, "mean_"):
            return self.fit(df, weight, col)
        self.n_seen_ += n
        a = n / self.n_seen_ if alpha is None else alpha
        if not 0 <= a <= 1:
            raise ValueError("alpha must be in [0, 1]")
        return self._from_mean(G.geodesic(self.mean_, mean(df, self.metric, col, weight), a, self.metric))

    def _with(self, df, col, f):
        return apply(df, [col], {"__f": "matrix"}, f).drop(col).withColumnRenamed("__f", col).select(*df.columns)

    def transform(self, df, col="cov"):
        w = self.filters_
        return self._with(df, col, lambda x: w.T @ x @ w)

    def inverse_transform(self, df, col="cov"):
        w = self.inv_filters_
        return self._with(df, col, lambda x: w.T @ x @ w)
