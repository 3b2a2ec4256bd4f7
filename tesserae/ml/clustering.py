"""Clustering of matrix sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.frames import apply, decode, encode
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels.mean import mean as local_mean
from tesserae.kernels.spectral import ddexpm, expm, logm
from tesserae.ml.base import Estimator, metric_of
from tesserae.ml.embedding import Rows
from tesserae.operators.means import group_means, sums
from tesserae.operators.pairs import BLOCK, BROADCAST_MB, CHUNK_PAIRS, _blocked, _sets, pairwise_distance
from tesserae.shared import checkpoint


def _sample(df: DataFrame, col: str, n: int, seed: int, id_: str) -> np.ndarray:
    """n rows that depend on seed and id only."""
    t = df.where(F.col(col).isNotNull()).orderBy(F.xxhash64(F.col(id_), F.lit(seed)), id_).limit(n).select(col).toArrow()
    return decode(t[col])


class Kmeans(Estimator):
    """Lloyd's iterations under a matrix metric; of n_init random starts the one with the smallest sum of distances."""

    def __init__(self, n_clusters=2, max_iter=100, metric="riemann", random_state=0, init="random", n_init=10, tol=1e-4):
        self.n_clusters, self.max_iter, self.metric, self.random_state, self.init, self.n_init, self.tol = n_clusters, max_iter, metric, random_state, init, n_init, tol

    def _start(self, df, col, id_, seed):
        if isinstance(self.init, np.ndarray):
            return self.init
        if self.init == "random":
            return _sample(df, col, self.n_clusters, seed, id_)
        if self.init != "k-means++":
            raise ValueError(f"unknown init {self.init!r}")
        d = metric_of(self.metric, "distance")
        centres = _sample(df, col, 1, seed, id_)
        while len(centres) < self.n_clusters:
            near = apply(df, [col], {"__d": "double"}, lambda x, c=centres: np.min([D.distance(x, m[None], d) for m in c], 0) ** 2, [id_, col])
            u = (F.xxhash64(F.col(id_), F.lit(seed), F.lit(len(centres))).cast("double") / 2.0**64) + 0.5
            pick = near.where("__d > 0").orderBy(-F.log(u) / F.col("__d"), id_).limit(1).select(col).toArrow()  # one draw with odds d^2
            if not pick.num_rows:
                break
            centres = np.concatenate([centres, decode(pick[col])])
        return centres

    def fit(self, df, weight=None, col="cov", id_="id"):
        m, d = metric_of(self.metric, "mean"), metric_of(self.metric, "distance")
        df = df.where(F.col(col).isNotNull()).persist()
        n = df.count()
        best = (np.inf, None, 0)
        restarts = self.n_init if not isinstance(self.init, np.ndarray) and self.init == "random" else 1
        for run in range(restarts):
            c = self._start(df, col, id_, self.random_state + run)
            labels = None
            for k in range(self.max_iter + 1):
                new = self._assign(df, c, d, col).select(id_, col, *([weight] if weight else []), "__k", "__d").persist()
                if labels is not None:
                    same = new.join(labels, id_).where(F.col("__k") == F.col("__old")).count()
                got = group_means(new, m, col, "__k", weight)
                c2 = np.stack([got[g].matrix for g in sorted(got, key=int)])  # empty clusters vanish
                inertia = new.agg(F.sum("__d")).first()[0]
                if labels is not None:
                    labels.unpersist()
                stop = labels is not None and same / n > 1 - self.tol
                labels = new.select(id_, F.col("__k").alias("__old")).persist()
                labels.count()
                new.unpersist()
                c = c2
                if stop:
                    break
            labels.unpersist()
            if inertia < best[0]:
                best = (inertia, c, k + 1)
        df.unpersist()
        self.inertia_, self.cluster_centers_, self.n_iter_ = best
        return self

    @staticmethod
    def _assign(df, centres, d, col):
        def f(x):
            y = np.stack([D.distance(x, c[None], d) for c in centres], 1)
            return y.argmin(1), y.min(1)

        return apply(df, [col], {"__k": "int", "__d": "double"}, f)

    def predict(self, df, col="cov"):
        return self._assign(df, self.cluster_centers_, metric_of(self.metric, "distance"), col).withColumnRenamed("__k", "prediction").drop("__d")

    def transform(self, df, col="cov", out="distances"):
        c, d = self.cluster_centers_, metric_of(self.metric, "distance")
        return apply(df, [col], {out: "vector"}, lambda x: np.stack([D.distance(x, m[None], d) for m in c], 1))


class KmeansPerClassTransform(Estimator):
    """k-means in each class; transform gives the distances to all centroids."""

    def __init__(self, n_clusters=2, **params):
        self.params = {"n_clusters": n_clusters, **params}

    def fit(self, df, y="y", weight=None, col="cov", id_="id"):
        df = df.where(F.col(y).isNotNull()).persist()  # what makes the matrices runs once, not once a class
        try:
            labels = [r[0] for r in df.select(y).distinct().orderBy(y).collect()]
            self.metric_ = metric_of(self.params.get("metric", "riemann"), "distance")
            self.covmeans_ = np.concatenate([Kmeans(**self.params).fit(df.where(F.col(y) == v), weight, col, id_).cluster_centers_ for v in labels])
        finally:
            df.unpersist()
        return self

    def transform(self, df, col="cov", out="distances"):
        c, d = self.covmeans_, self.metric_
        return apply(df, [col], {out: "vector"}, lambda x: np.stack([D.distance(x, m[None], d) for m in c], 1))


KERNELS = {"normal": lambda x: np.exp(-(x**2)), "uniform": lambda x: (np.abs(x) <= 1).astype(float)}


class MeanShift(Estimator):
    """Every matrix climbs to a mode by weighted log-map steps; modes closer than the bandwidth are one.

    All rows climb, or `seekers` of them taken by hash of their id.  They move in one pass at a time: blocks of seekers meet blocks of rows, kernel-weighted
    log maps are summed for each pair of blocks, and the sums, a row for each seeker and block, are added up.  Each pass is cut by a checkpoint.
    Where the metric is Euclidean in some coordinates (FLAT) and the matrices are within a broadcast, a pass is products of weights and coordinates, and a row for each seeker comes back.
    """

    FLAT = {"euclid": (lambda x: x, lambda v, z: v), "logeuclid": (logm, ddexpm)}

    def __init__(self, kernel="uniform", bandwidth=None, metric="riemann", tol=1e-3, max_iter=100, seekers=None):
        self.kernel, self.bandwidth, self.metric, self.tol, self.max_iter, self.seekers = kernel, bandwidth, metric, tol, max_iter, seekers

    def fit(self, df, col="cov", id_="id"):
        d, mp = metric_of(self.metric, "distance"), metric_of(self.metric, "map")
        k = KERNELS[self.kernel] if isinstance(self.kernel, str) else self.kernel
        if self.seekers is None and d == mp and d in self.FLAT and df.schema[col].dataType.typeName() == "array":
            n, width = df.where(F.col(col).isNotNull()).agg(F.count("*"), F.max(F.size(col))).first()
            if n and 8 * n * width <= BROADCAST_MB * 1e6:
                return self._fit_flat(Rows(df, d, id_, col), d, k)
        df = df.where(F.col(col).isNotNull()).persist()
        if self.bandwidth is None:
            p = pairwise_distance(df, None, d, id_, col)
            n = df.count()
            q = 0.3 * (n * n - 1)  # over the full grid: every pair twice, and n zeros
            at = max(0.0, (q - n) / 2)
            self.bandwidth_ = p.agg(F.expr(f"percentile(d, {min(1.0, at / max(n * (n - 1) / 2 - 1, 1))})")).first()[0] or 1.0
        else:
            self.bandwidth_ = self.bandwidth
        h = self.bandwidth_
        rows = _sets(df, id_, col)
        live = rows if self.seekers is None else rows.orderBy(F.xxhash64("id", F.lit(0)), "id").limit(self.seekers)
        live, done, tol = checkpoint(live), None, self.tol

        def f(li, lm, ri, rm):
            sums, ws = [], []
            for m in lm:
                w = k(D.distance(rm, m[None], d) / h)
                sums.append(np.tensordot(w, G.log_map(rm, m, mp), 1))
                ws.append(w.sum())
            yield pa.RecordBatch.from_arrays([pa.array(li), encode(np.stack(sums), "matrix"), pa.array(np.array(ws, float))], names=["i", "s", "w"])

        def step(m, s, w):
            s = s / np.maximum(w, 1e-300)[:, None, None]
            return np.stack([G.exp_map(v, x, mp) for v, x in zip(s, m)]), np.linalg.norm(s.reshape(len(s), -1), axis=1)

        size = live.agg(F.max(F.size("m"))).first()[0] or 0
        for _ in range(self.max_iter):
            parts = _blocked(live, rows, f, "i long, s array<double>, w double")
            total = parts.groupBy("i").agg(F.array(*(F.sum(F.col("s")[j]) for j in range(size))).alias("s"), F.sum("w").alias("w"))
            moved = apply(live.join(total, live.id == total.i), ["m", "s", "w"], {"to": "matrix", "by": "double"}, step, ["id"])
            moved = checkpoint(moved.select("id", F.col("to").alias("m"), "by"))
            still = moved.where(F.col("by") <= tol).select("id", "m")
            done = still if done is None else done.unionByName(still)
            live = moved.where(F.col("by") > tol).select("id", "m")
            if not live.limit(1).count():
                break
        modes = checkpoint(live if done is None else done.unionByName(live))
        df.unpersist()
        fused: list[np.ndarray] = []
        while len(first := modes.orderBy("id").limit(1).select("m").toArrow()["m"]):  # a job for each mode that is left
            m = decode(first)[0]
            fused.append(m)
            modes = apply(modes, ["m"], {"__d": "double"}, lambda x, m=m: D.distance(x, m[None], d), ["id", "m"]).where(F.col("__d") >= h).drop("__d")
        self.modes_ = np.stack(fused)
        return self

    def _fit_flat(self, rows, metric, k):
        n, spark = rows.n, rows.spark
        if self.bandwidth is None:
            at = max(0.0, (0.3 * (n * n - 1) - n) / 2)  # over the full grid: every pair twice, and n zeros
            at = min(at, max(0, n * (n - 1) // 2 - 1))
            a, b = rows.ranked(math.floor(at), math.ceil(at)) if n > 1 else (0.0, 0.0)
            self.bandwidth_ = (a + (b - a) * (at - math.floor(at))) or 1.0
        else:
            self.bandwidth_ = self.bandwidth
        h, (to, tangent) = self.bandwidth_, self.FLAT[metric]
        x = to(rows.x.value).reshape(n, -1)
        p = rows.x.value.shape[-1]
        data, size, step = spark.sparkContext.broadcast(x), x.shape[1] + 1, max(1, CHUNK_PAIRS // BLOCK)
        z, live = x.copy(), np.arange(n)
        for _ in range(self.max_iter):
            at, back = np.unique(z[live], axis=0, return_inverse=True)  # copies climb together
            held = spark.sparkContext.broadcast(at)
            chunks = -(-len(at) // step)

            def run(batches, held=held):
                for b in batches:
                    for c in b.column(0).to_pylist():
                        y, v = held.value[c * step : (c + 1) * step], 0
                        for start in range(0, n, BLOCK):
                            u = data.value[start : start + BLOCK]
                            d = np.maximum((y**2).sum(1)[:, None] + (u**2).sum(1) - 2 * y @ u.T, 0)
                            w = k(np.sqrt(d) / h)
                            v = v + np.concatenate([w @ u, w.sum(1, keepdims=True)], 1)
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), encode(v.reshape(1, -1), "vector")], names=["k", "v"])

            parts = min(chunks, 4 * spark.sparkContext.defaultParallelism)
            got = spark.range(0, chunks, 1, parts).mapInArrow(run, "k long, v array<double>").toArrow().sort_by("k")
            held.destroy()
            v = got["v"].combine_chunks().flatten().to_numpy().reshape(-1, size)[np.ravel(back)]
            old = z[live]
            move = np.where(v[:, -1:] > 0, v[:, :-1] / np.maximum(v[:, -1:], 1e-300) - old, 0)
            by = np.linalg.norm(tangent(move.reshape(-1, p, p), old.reshape(-1, p, p)).reshape(len(move), -1), axis=1)
            z[live] = old + move
            live = live[by > self.tol]
            if not len(live):
                break
        modes, left = [], z
        while len(left):
            modes.append(left[0])
            left = left[np.linalg.norm(left - left[0], axis=1) >= h]
        out = np.stack(modes).reshape(-1, p, p)
        self.modes_ = out if metric == "euclid" else expm(out)
        return self

    def predict(self, df, col="cov"):
        return Kmeans._assign(df, self.modes_, metric_of(self.metric, "distance"), col).withColumnRenamed("__k", "prediction").drop("__d")


class Gaussian:
    """Wrapped Gaussian: normal in the tangent space at mu.  The normaliser is (2 pi)^p with p the matrix order; it cancels in responsibilities."""

    def __init__(self, mu, sigma=None, metric="riemann"):
        n = len(mu) * (len(mu) + 1) // 2
        self.mu, self.metric, self.sigma = mu, metric, np.eye(n) if sigma is None else sigma

    def log_pdf(self, x):
        v = G.tangent_space(x, self.mu, metric_of(self.metric, "map"))
        q = np.einsum("ni,ni->n", v, np.linalg.solve(self.sigma, v.T).T)
        return -0.5 * (len(self.mu) * math.log(2 * math.pi) + np.linalg.slogdet(self.sigma)[1] + q)

    def pdf(self, x):
        return np.exp(self.log_pdf(x))

    def update_mean(self, x, w):
        self.mu = local_mean(x, metric_of(self.metric, "mean"), w)[0]

    def update_covariance(self, x, w, reg=1e-6):
        v = G.tangent_space(x, self.mu, metric_of(self.metric, "map"))
        self.sigma = (w[:, None] * v).T @ v / w.sum() + reg * np.eye(v.shape[1])


class GaussianMixture(Estimator):
    """Mixture of wrapped Gaussians by expectation maximisation; each step is passes of weighted sums."""

    def __init__(self, n_components=1, metric="riemann", weights_init=None, means_init=None, tol=1e-5, maxiter=100, random_state=0):
        self.n_components, self.metric, self.weights_init, self.means_init, self.tol, self.maxiter, self.random_state = n_components, metric, weights_init, means_init, tol, maxiter, random_state

    def fit(self, df, col="cov", id_="id"):
        mp = metric_of(self.metric, "map")
        df = df.where(F.col(col).isNotNull()).persist()
        n = df.count()
        start = self.means_init if self.means_init is not None else _sample(df, col, self.n_components, self.random_state, id_)
        k, p = len(start), start.shape[-1]
        m = p * (p + 1) // 2
        if n < m:
            raise ValueError(f"at least {m} matrices are needed")
        self.weights_ = np.full(k, 1 / k) if self.weights_init is None else np.asarray(self.weights_init, float)
        self.components_ = [Gaussian(c, None, self.metric) for c in start]
        rows = df.select(F.lit("").alias("key"), F.lit(1.0).alias("w"), F.col(col).alias("m"))
        last = np.inf
        for it in range(self.maxiter):
            parts, w = self.components_, self.weights_

            def moments(x, _, parts=parts, w=w):
                r, ll = _responsibilities(x, parts, w)
                out = [ll[:, None]]
                for j, g in enumerate(parts):
                    v = G.tangent_space(x, g.mu, mp)
                    out += [r[:, j : j + 1], r[:, j : j + 1] * v]
                return np.concatenate(out, 1)

            s = np.ravel(sums(rows, moments)[""][1])
            nll = -s[0]
            s = s[1:].reshape(k, m + 1)
            mass, first = s[:, 0], s[:, 1:]
            self.weights_ = mass / n
            new = []
            for j, g in enumerate(parts):
                new.append(G.untangent_space(first[j] / max(mass[j], 1e-300), g.mu, mp))

            def spread(x, _, parts=parts, w=w, new=new):
                r, _ = _responsibilities(x, parts, w)
                out = []
                for j, c in enumerate(new):
                    v = G.tangent_space(x, c, mp)
                    out.append((r[:, j, None, None] * v[:, :, None] * v[:, None]).reshape(len(x), -1))
                return np.concatenate(out, 1)

            cov = np.ravel(sums(rows, spread)[""][1]).reshape(k, m, m)
            self.components_ = [Gaussian(c, cov[j] / max(mass[j], 1e-300) + 1e-6 * np.eye(m), self.metric) for j, c in enumerate(new)]
            self.n_iter_ = it + 1
            if abs(last - nll) < self.tol:
                break
            last = nll
        df.unpersist()
        return self

    @property
    def means_(self):
        return np.stack([g.mu for g in self.components_])

    @property
    def covariances_(self):
        return np.stack([g.sigma for g in self.components_])

    def predict_proba(self, df, col="cov", out="probabilities"):
        parts, w = self.components_, self.weights_
        return apply(df, [col], {out: "vector"}, lambda x: _responsibilities(x, parts, w)[0])

    def predict(self, df, col="cov"):
        parts, w = self.components_, self.weights_
        return apply(df, [col], {"prediction": "int"}, lambda x: _responsibilities(x, parts, w)[0].argmax(1))

    def score(self, df, col="cov"):
        """Mean log-likelihood."""
        parts, w = self.components_, self.weights_
        return apply(df, [col], {"__l": "double"}, lambda x: _responsibilities(x, parts, w)[1], []).agg(F.avg("__l")).first()[0]

    def sample(self, spark, n, seed=0):
        """n matrices with the component that each comes from."""
        from tesserae.sources.synthetic import wrapped_samples

        return wrapped_samples(spark, n, self.means_, self.covariances_, self.weights_, metric_of(self.metric, "map"), seed)


def _responsibilities(x, parts, w):
    lp = np.stack([g.log_pdf(x) for g in parts], 1) + np.log(np.maximum(w, 1e-300))
    top = lp.max(1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(lp - top).sum(1))
    return np.exp(lp - ll[:, None]), ll
