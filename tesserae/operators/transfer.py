"""Transfer learning between domains.  The domain is a column; encode and decode keep the "domain/label" form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.frames import apply
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels.spectral import invsqrtm, powm, sqrtm, sym
from tesserae.ml.base import Classifier, Estimator, Regressor, by_label, label_type, metric_of
from tesserae.ml.classification import MDM
from tesserae.operators.means import group_means, sums


def encode_domains(df: DataFrame, y: str = "y", domain: str = "domain", out: str = "y_enc") -> DataFrame:
    return df.withColumn(out, F.concat_ws("/", F.col(domain).cast("string"), F.col(y).cast("string")))


def decode_domains(df: DataFrame, y_enc: str = "y_enc", y: str = "y", domain: str = "domain") -> DataFrame:
    """The last part is the label, the one before it the domain."""
    parts = F.split(y_enc, "/")
    return df.withColumn(y, F.element_at(parts, -1)).withColumn(domain, F.element_at(parts, -2))


class TLSplitter:
    """Cross-validation on the target domain; all source rows are in every training set."""

    def __init__(self, target_domain, cv=5, seed=0):
        self.target_domain, self.cv, self.seed = target_domain, cv, seed

    def get_n_splits(self):
        return self.cv

    def folds(self, df: DataFrame, domain="domain", id_="id") -> DataFrame:
        """df with column fold; null for source rows."""
        return df.withColumn("fold", F.when(F.col(domain) == self.target_domain, F.pmod(F.xxhash64(F.col(id_), F.lit(self.seed)), F.lit(self.cv)).cast("int")))

    def split(self, df, domain="domain", id_="id"):
        f = self.folds(df, domain, id_)
        for k in range(self.cv):
            yield f.where(F.col("fold").isNull() | (F.col("fold") != k)).drop("fold"), f.where(F.col("fold") == k).drop("fold")


class TLDummy(Estimator):
    def fit(self, df, **kw):
        return self

    def transform(self, df, **kw):
        return df


def _vector_means(df, col, domain):
    rows = df.where(F.col(col).isNotNull()).select(F.col(domain).cast("string").alias("key"), F.lit(1.0).alias("w"), F.col(col).alias("m"))
    return {k: s / w for k, (w, s) in sums(rows, lambda v, k: v, vectors=True).items()}


def _per_domain(df, col, domain, f, vectors=False):
    """The column replaced by f(stack, domain name) for each domain."""

    def run(x, names):
        out = np.empty_like(x)
        for name in set(names):
            at = names == name
            out[at] = f(x[at], name)
        return out

    shapes = {col: (-1,)} if vectors else None
    d = df.withColumn("__domain", F.col(domain).cast("string"))
    return apply(d, [col, "__domain"], {"__t": "vector" if vectors else "matrix"}, run, df.columns, shapes).drop(col).withColumnRenamed("__t", col).select(*df.columns)


class TLCenter(Estimator):
    """Recentres every domain to the identity (matrices), or to zero (vectors).

    fit_transform centres each domain by its own mean; transform uses the target's ("last" if the
    target is "", and the transformed set's own mean if it is "transductive").
    """

    def __init__(self, target_domain, metric="riemann", vectors=False):
        self.target_domain, self.metric, self.vectors = target_domain, metric, vectors

    def fit(self, df, domain="domain", weight=None, col="cov"):
        if self.vectors:
            self.centers_ = _vector_means(df, col, domain)
        else:
            self.centers_ = {k: v.matrix for k, v in group_means(df, self.metric, col, domain, weight).items()}
        return self

    def _move(self, df, col, domain, centres):
        if self.vectors:
            return _per_domain(df, col, domain, lambda x, k: x - centres(k), True)
        return _per_domain(df, col, domain, lambda x, k: _whiten(x, centres(k)))

    def fit_transform(self, df, domain="domain", weight=None, col="cov"):
        c = self.fit(df, domain, weight, col).centers_
        return self._move(df, col, domain, lambda k: c[k])

    def transform(self, df, col="cov"):
        if self.target_domain == "transductive":
            d = df.withColumn("__d", F.lit("all"))
            c = TLCenter("", self.metric, self.vectors).fit(d, "__d", None, col).centers_["all"]
        else:
            c = self.centers_[self.target_domain or list(self.centers_)[-1]]
        return self._move(df.withColumn("__d", F.lit("all")), col, "__d", lambda k: c).drop("__d")


def _whiten(x, c):
    s = invsqrtm(c)
    return sym(s @ x @ s)


class TLScale(Estimator):
    """Brings every domain to one dispersion: matrices are raised to sqrt(final / dispersion) around the domain's Riemannian mean, vectors divided by their mean norm."""

    def __init__(self, target_domain, final_dispersion=1.0, centered_data=False, metric="riemann", vectors=False):
        self.target_domain, self.final_dispersion, self.centered_data, self.metric, self.vectors = target_domain, final_dispersion, centered_data, metric, vectors

    def fit(self, df, domain="domain", weight=None, col="cov"):
        rows = df.where(F.col(col).isNotNull())
        key = F.col(domain).cast("string").alias("key")
        w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")
        if self.vectors:
            got = sums(rows.select(key, w, F.col(col).alias("m")), lambda v, k: np.linalg.norm(v, axis=1)[:, None], vectors=True)
            self.scales_ = {k: 1 / float(np.ravel(s)[0] / n) for k, (n, s) in got.items()}
            return self
        if self.centered_data:
            self.means_ = {r[0]: None for r in rows.select(key).distinct().collect()}
        else:
            self.means_ = {k: v.matrix for k, v in group_means(rows, "riemann", col, domain, weight).items()}
        means, metric = self.means_, self.metric

        def d2(x, k):
            c = np.eye(x.shape[-1]) if means[k] is None else means[k]
            return D.distance(x, c[None], metric, squared=True)[:, None]

        self.dispersions_ = {k: float(np.ravel(s)[0] / n) for k, (n, s) in sums(rows.select(key, w, F.col(col).alias("m")), d2).items()}
        self.scales_ = {k: float(np.sqrt(self.final_dispersion / v)) for k, v in self.dispersions_.items()}
        return self

    def _stretch(self, df, col, domain, of):
        scales, means = self.scales_, getattr(self, "means_", {})
        if self.vectors:
            return _per_domain(df, col, domain, lambda x, k: x * scales[of(k)], True)

        def f(x, k):
            c = means[of(k)]
            if c is None:
                return powm(x, scales[of(k)])
            r = sqrtm(c)
            return sym(r @ powm(_whiten(x, c), scales[of(k)]) @ r)

        return _per_domain(df, col, domain, f)

    def fit_transform(self, df, domain="domain", weight=None, col="cov"):
        return self.fit(df, domain, weight, col)._stretch(df, col, domain, lambda k: k)

    def transform(self, df, col="cov"):
        t = self.target_domain
        return self._stretch(df.withColumn("__d", F.lit("all")), col, "__d", lambda k: t).drop("__d")


def grassmann_rotation(source, target, weights=None, metric="euclid", tol_step=1e-9, maxiter=10_000, searches=32):
    """Orthogonal Q that minimises the weighted squared distances between target and Q source Q^T: steepest descent on the orthogonal group with QR retraction and Armijo steps, from a rotation and a reflection."""
    n, p, _ = source.shape
    w = np.full(n, 1 / n) if weights is None else np.asarray(weights) / np.sum(weights)

    def loss(q):
        return (w * D.distance(q @ source @ q.T, target, metric, squared=True)).sum()

    def grad(q):
        m = q @ source @ q.T
        if metric == "euclid":
            e = 4 * (m - target)
            return np.einsum("n,nij->ij", w, e @ q @ source)
        s = np.stack([G.log_map(b, a) for a, b in zip(m, target)])  # whitened log of target at m
        r, i = sqrtm(m), invsqrtm(m)
        return np.einsum("n,nij->ij", w, -4 * i @ s @ r @ q)

    def skew(q, g):
        a = g @ q.T
        return (a - a.T) / 2 @ q

    def retract(x):
        q, r = np.linalg.qr(x)
        return q * np.sign(np.where(np.diagonal(r) == 0, 1, np.diagonal(r)))

    def descend(q):
        step, f = 1.0, loss(q)
        for _ in range(maxiter):
            v = skew(q, grad(q))
            n2 = (v**2).sum()
            for _ in range(searches):
                new = retract(q - step * v)
                fn = loss(new)
                if f - fn > 1e-4 * step * n2:
                    break
                step /= 2
            else:
                break
            moved = np.linalg.norm(new - q)
            q, f = new, fn
            step *= 1.6
            if moved <= tol_step:
                break
        return f, q

    starts = []
    vs, vt = np.linalg.eigh(np.tensordot(w, source, 1))[1], np.linalg.eigh(np.tensordot(w, target, 1))[1]
    signs = [np.where((np.arange(p) == k), -1.0, 1.0) for k in range(p)] + [np.ones(p)]
    cand = sorted(((loss((vt * s) @ vs.T), tuple(s)) for s in signs), key=lambda t: t[0])
    for sign in (1, -1):
        for _, s in cand:
            q = (vt * np.array(s)) @ vs.T
            if np.sign(np.linalg.det(q)) == sign:
                starts.append(q)
                break
    return min((descend(q) for q in starts), key=lambda t: t[0])[1]


def tangent_rotation(source, target, expl_var=0.999):
    """SVD Procrustes between anchors, cut to the components that explain this share."""
    u, s, v = np.linalg.svd(target.T @ source, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), expl_var - 1e-12)) + 1
    return u[:, :k] @ v[:k]


class TLRotate(Estimator):
    """Rotates every source domain so that its class means meet the target's.  Only training data turn: transform is the identity."""

    def __init__(self, target_domain, weights=None, metric="euclid", vectors=False, expl_var=0.999, tol_step=1e-9, maxiter=10_000):
        self.target_domain, self.weights, self.metric, self.vectors, self.expl_var, self.tol_step, self.maxiter = target_domain, weights, metric, vectors, expl_var, tol_step, maxiter

    def fit(self, df, y="y", domain="domain", weight=None, col="cov"):
        keyed = encode_domains(df.where(F.col(y).isNotNull()), y, domain, "__k")
        if self.vectors:
            got = _vector_means(keyed, col, "__k")
        else:
            got = {k: v.matrix for k, v in group_means(keyed, metric_of("riemann", "mean") if self.metric != "euclid" else "euclid", col, "__k", weight).items()}
        of: dict[str, dict] = {}
        for k, m in got.items():
            d, _, lab = k.rpartition("/")
            of.setdefault(d, {})[lab] = m
        target = of[str(self.target_domain)]
        self.rotations_ = {}
        for d, means in of.items():
            if d == str(self.target_domain):
                continue
            labels = sorted(set(means) & set(target))
            a, b = np.stack([means[v] for v in labels]), np.stack([target[v] for v in labels])
            self.rotations_[d] = tangent_rotation(a, b, self.expl_var) if self.vectors else grassmann_rotation(a, b, self.weights, self.metric, self.tol_step, self.maxiter)
        return self

    def fit_transform(self, df, y="y", domain="domain", weight=None, col="cov"):
        q = self.fit(df, y, domain, weight, col).rotations_

        def f(x, k):
            if k not in q:
                return x
            return x @ q[k].T if self.vectors else q[k] @ x @ q[k].T

        return _per_domain(df, col, domain, f, self.vectors)

    def transform(self, df, col="cov"):
        return df


class TLEstimator(Estimator):
    """Any estimator, fitted on all domains with a weight for each."""

    def __init__(self, target_domain, estimator, domain_weight=None):
        self.target_domain, self.estimator, self.domain_weight = target_domain, estimator, domain_weight

    def fit(self, df, y="y", domain="domain", col="cov"):
        if self.domain_weight is None:
            self.estimator.fit(df, y=y, col=col)
            return self
        n = {r[0]: r[1] for r in df.groupBy(F.col(domain).cast("string")).count().collect()}
        share = F.create_map(*(F.lit(x) for k, c in n.items() for x in (k, float(self.domain_weight.get(k, 0)) / c)))
        weighed = df.withColumn("__w", share[F.col(domain).cast("string")]).where(F.col("__w") > 0)
        self.estimator.fit(weighed, y=y, weight="__w", col=col)
        return self

    def predict(self, df, col="cov"):
        return self.estimator.predict(df, col=col)


class TLClassifier(TLEstimator):
    score = Classifier.score

    def predict_proba(self, df, col="cov"):
        return self.estimator.predict_proba(df, col=col)


class TLRegressor(TLEstimator):
    score = Regressor.score

    def fit(self, df, y="y", domain="domain", col="cov"):
        return super().fit(df.withColumn(y, F.col(y).cast("double")), y, domain, col)


class MDWM(MDM):
    """Class means on the geodesic from the source domains' to the target's, at domain_tradeoff."""

    def __init__(self, domain_tradeoff, target_domain, metric="riemann"):
        super().__init__(metric)
        self.domain_tradeoff, self.target_domain = domain_tradeoff, target_domain

    def fit(self, df, y="y", domain="domain", weight=None, col="cov"):
        if not 0 <= self.domain_tradeoff <= 1:
            raise ValueError("domain_tradeoff must be in [0, 1]")
        m = metric_of(self.metric, "mean")
        df = df.where(F.col(y).isNotNull())
        is_target = F.col(domain) == self.target_domain
        a = group_means(df.where(~is_target), m, col, y, weight) if self.domain_tradeoff < 1 else None
        b = group_means(df.where(is_target), m, col, y, weight) if self.domain_tradeoff > 0 else None
        if a and b and set(a) != set(b):
            raise ValueError("source and target classes differ")
        self.kind_ = label_type(df, y)
        self.classes_ = by_label(list(a or b), self.kind_)
        t = self.domain_tradeoff
        means = [(a or b)[k].matrix if not (a and b) else G.geodesic(a[k].matrix, b[k].matrix, t, m) for k in self.classes_]
        self.covmeans_ = np.stack(means)
        return self

