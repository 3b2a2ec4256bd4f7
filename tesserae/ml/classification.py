"""Classifiers and regressors on matrix sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.columns import softmax
from tesserae.frames import apply, decode
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels.spectral import logm
from tesserae.ml.base import Classifier, Regressor, argmin_label, by_label, label_type, metric_of, probabilities
from tesserae.ml.tangent import FGDA, TangentSpace
from tesserae.operators.means import group_means, mean
from tesserae.operators.pairs import nearest


class MDM(Classifier):
    """Minimum distance to mean."""

    def __init__(self, metric="riemann"):
        self.metric = metric

    def fit(self, df: DataFrame, y: str = "y", weight: str | None = None, col: str = "cov") -> MDM:
        got = group_means(df.where(F.col(y).isNotNull()), metric_of(self.metric, "mean"), col, y, weight)
        self.kind_ = label_type(df, y)
        self.classes_ = by_label(list(got), self.kind_)
        self.covmeans_ = np.stack([got[c].matrix for c in self.classes_])
        return self

    def transform(self, df: DataFrame, col: str = "cov", out: str = "distances") -> DataFrame:
        means, m = self.covmeans_, metric_of(self.metric, "distance")
        return apply(df, [col], {out: "vector"}, lambda x: np.stack([D.distance(x, c[None], m) for c in means], 1))

    def predict(self, df: DataFrame, col: str = "cov") -> DataFrame:
        return argmin_label(self.transform(df, col), "distances", self.classes_, self.kind_)

    def predict_proba(self, df: DataFrame, col: str = "cov") -> DataFrame:
        return self.transform(df, col).withColumn("probabilities", probabilities("distances"))


class FgMDM(Classifier):
    """Geodesic filtering by FGDA, then MDM."""

    def __init__(self, metric="riemann", tsupdate=False):
        self.metric, self.tsupdate = metric, tsupdate

    def fit(self, df, y="y", weight=None, col="cov"):
        self.fgda_ = FGDA(metric_of(self.metric, "map"), self.tsupdate).fit(df, y, weight, col)
        self.mdm_ = MDM(self.metric).fit(self.fgda_.transform(df, col), y, weight, col)
        self.classes_ = self.mdm_.classes_
        return self

    def transform(self, df, col="cov"):
        return self.mdm_.transform(self.fgda_.transform(df, col), col)

    def predict(self, df, col="cov"):
        return self.mdm_.predict(self.fgda_.transform(df, col), col)

    def predict_proba(self, df, col="cov"):
        return self.mdm_.predict_proba(self.fgda_.transform(df, col), col)


class TSClassifier(Classifier):
    """Tangent space, then any classifier of pyspark.ml (logistic regression by default)."""

    def __init__(self, metric="riemann", tsupdate=False, clf=None):
        self.metric, self.tsupdate, self.clf = metric, tsupdate, clf

    def _vectors(self, df, col):
        from pyspark.ml.functions import array_to_vector

        return self.ts_.transform(df, col).withColumn("features", array_to_vector("tangent"))

    def fit(self, df, y="y", weight=None, col="cov"):
        from pyspark.ml.classification import LogisticRegression

        self.ts_ = TangentSpace(self.metric, self.tsupdate).fit(df, weight, col)
        self.kind_ = label_type(df, y)
        self.classes_ = by_label([r[0] for r in df.where(F.col(y).isNotNull()).select(F.col(y).cast("string")).distinct().collect()], self.kind_)
        at = F.array_position(F.array(*map(F.lit, self.classes_)), F.col(y).cast("string")) - 1
        data = self._vectors(df, col).where(F.col(y).isNotNull()).withColumn("label", at.cast("double")).persist()
        clf = self.clf or LogisticRegression(regParam=1 / max(data.count(), 1), standardization=False)
        if weight:
            clf = clf.copy({clf.weightCol: weight})
        self.model_ = clf.fit(data)
        data.unpersist()
        return self

    def predict(self, df, col="cov"):
        from pyspark.ml.functions import vector_to_array

        out = self.model_.transform(self._vectors(df, col)).withColumnRenamed("prediction", "__p")
        labels = F.array(*(F.lit(c).cast(self.kind_) for c in self.classes_))
        out = out.withColumn("prediction", F.element_at(labels, F.col("__p").cast("int") + 1))
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
        return out.drop("__p", "features", "rawPrediction", "probability", "tangent")

    predict_proba = predict


class KNearestNeighbor(Classifier):
    """Majority of the k nearest; ties go to the smallest label, weights don't count."""

    def __init__(self, n_neighbors=5, metric="riemann"):
        self.n_neighbors, self.metric = n_neighbors, metric

    def fit(self, df, y="y", weight=None, col="cov", id_="id"):
        self.train_, self.y_, self.col_, self.id_ = df.where(F.col(y).isNotNull()), y, col, id_
        return self

    def _neighbours(self, df, col, id_):
        pairs = nearest(df.select(id_, col), self.train_.select(F.col(self.id_).alias(id_), F.col(self.col_).alias(col)), self.n_neighbors, metric_of(self.metric, "distance"), id_, col)
        return pairs.join(self.train_.select(F.col(self.id_).cast("long").alias("j"), F.col(self.y_).alias("label")), "j")

    def predict(self, df, col="cov", id_="id"):
        from pyspark.sql.window import Window

        votes = self._neighbours(df, col, id_).groupBy("i", "label").agg(F.count("*").alias("n"))
        best = votes.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "label"))).where("r = 1")
        return df.join(best.select(F.col("i").alias(id_), F.col("label").alias("prediction")), id_, "left")

    def predict_proba(self, df, col="cov", id_="id"):
        """prediction, and probabilities as a map from label: softmax(-d^2) over the neighbours."""
        one = self._neighbours(df, col, id_).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "d", "label"))).alias("k"))
        p = softmax(F.transform("k.d", lambda d: -d * d))
        long = one.select("i", F.explode(F.arrays_zip(F.col("k.label").alias("label"), p.alias("p"))).alias("x")).groupBy("i", "x.label").agg(F.sum("x.p").alias("p"))
        maps = long.groupBy("i").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "p")))).alias("probabilities"))
        return self.predict(df, col, id_).join(maps.withColumnRenamed("i", id_), id_, "left")


class KNearestNeighborRegressor(Regressor):
    """Mean target of the k nearest, weighted by softmax(-d^2)."""

    def __init__(self, n_neighbors=5, metric="riemann"):
        self.n_neighbors, self.metric = n_neighbors, metric

    fit, _neighbours = KNearestNeighbor.fit, KNearestNeighbor._neighbours

    def predict(self, df, col="cov", id_="id"):
        near = self._neighbours(df, col, id_).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "d", F.col("label").cast("double").alias("label")))).alias("k"))
        p = softmax(F.transform("k.d", lambda d: -d * d))
        value = F.aggregate(F.zip_with(p, "k.label", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return df.join(near.select(F.col("i").alias(id_), value.alias("prediction")), id_, "left")


class MeanField(Classifier):
    """Power means of several orders for every class."""

    def __init__(self, power_list=(-1, 0, 1), method_combination="sum_means", metric="riemann"):
        self.power_list, self.method_combination, self.metric = tuple(power_list), method_combination, metric

    def fit(self, df, y="y", weight=None, col="cov"):
        self.kind_ = label_type(df, y)
        got = [group_means(df.where(F.col(y).isNotNull()), "power", col, y, weight, p=p) for p in self.power_list]
        self.classes_ = by_label(list(got[0]), self.kind_)
        self.covmeans_ = np.stack([[g[c].matrix for c in self.classes_] for g in got])
        return self

    def transform(self, df, col="cov", out="distances"):
        """Distances by class (summed or smallest over the orders), or of every order and class if method_combination is None."""
        means, m, how = self.covmeans_, metric_of(self.metric, "distance"), self.method_combination

        def f(x):
            d = np.stack([[D.distance(x, c[None], m) for c in row] for row in means])
            d = d.sum(0) if how == "sum_means" else d.min(0) if how == "inf_means" else d.reshape(-1, len(x))
            return d.T

        return apply(df, [col], {out: "vector"}, f)

    def predict(self, df, col="cov"):
        if self.method_combination is None:
            raise ValueError("method_combination None is for transform only")
        return argmin_label(self.transform(df, col), "distances", self.classes_, self.kind_)

    def predict_proba(self, df, col="cov"):
        return self.transform(df, col).withColumn("probabilities", probabilities("distances"))


def simplex_qp(gram: np.ndarray, lin: np.ndarray, maxiter: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Minima of w' gram w - 2 lin_i' w over the simplex for every row of lin, by accelerated projected gradient on all rows at once."""
    n = lin.shape[1]
    rank = np.arange(1, n + 1)

    def project(v):
        u = -np.sort(-v, axis=1)
        c = (np.cumsum(u, 1) - 1) / rank
        k = (u > c).sum(1) - 1
        return np.maximum(v - c[np.arange(len(v)), k][:, None], 0)

    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    out = np.full(lin.shape, 1 / n)
    live, w, z, t, q = np.arange(len(lin)), out.copy(), out.copy(), 1.0, lin
    for _ in range(maxiter):
        new = project(z - step * (z @ gram - q))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        moving = np.abs(new - w).max(1) >= tol
        w, t = new, t2
        if not moving.all():
            out[live] = w
            live, w, z, q = live[moving], w[moving], z[moving], q[moving]
            if not len(live):
                break
    out[live] = w
    return out


class NearestConvexHull(Classifier):
    """Distance to the convex hull of a class, Euclidean or log-Euclidean.  The training matrices are collected (LIMIT rows) and broadcast."""

    LIMIT = 50_000

    def __init__(self, metric="logeuclid"):
        if metric not in ("euclid", "logeuclid"):
            raise ValueError("metric is euclid or logeuclid")
        self.metric = metric

    def fit(self, df, y="y", weight=None, col="cov"):
        self.kind_ = label_type(df, y)
        t = df.where(F.col(y).isNotNull() & F.col(col).isNotNull()).select(F.col(y).cast("string").alias("y"), col).limit(self.LIMIT + 1).toArrow()
        if t.num_rows > self.LIMIT:
            raise ValueError(f"a hull holds all its training rows; more than {self.LIMIT}. Fit on a sample, or on means of groups")
        x, lab = decode(t[col]), np.array(t["y"].to_pylist(), object)
        self.classes_ = by_label(sorted(set(lab)), self.kind_)
        x = (logm(x) if self.metric == "logeuclid" else x).reshape(len(x), -1)
        self.points_ = [x[lab == c] for c in self.classes_]
        return self

    def transform(self, df, col="cov", out="distances"):
        points, metric = df.sparkSession.sparkContext.broadcast(self.points_), self.metric

        def f(x):
            v = (logm(x) if metric == "logeuclid" else x).reshape(len(x), -1)
            d = np.empty((len(v), len(points.value)))
            for k, q in enumerate(points.value):
                d[:, k] = np.linalg.norm(v - simplex_qp(q @ q.T, v @ q.T) @ q, axis=1)
            return d

        return apply(df, [col], {out: "vector"}, f)

    predict, predict_proba = MDM.predict, MDM.predict_proba


def _dual(k: np.ndarray, y: np.ndarray, c: np.ndarray, tol: float, maxiter: int) -> tuple[np.ndarray, float]:
    """Support vector machine by sequential minimal optimisation with maximal violating pairs: min a'Qa/2 - sum a, 0 <= a <= c, y'a = 0."""
    n = len(y)
    a, grad = np.zeros(n), -np.ones(n)
    q = k * y[:, None] * y[None]
    for _ in range(maxiter if maxiter > 0 else 100 * n + 10_000):
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        s = -y * grad
        i = np.where(up, s, -np.inf).argmax()
        j = np.where(low, s, np.inf).argmin()
        if s[i] - s[j] <= tol:
            break
        eta = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = (s[i] - s[j]) / eta
        step = min(step, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        grad += step * (q[:, i] * y[i] - q[:, j] * y[j])
    free = (a > 1e-12) & (a < c - 1e-12)
    s = -y * grad
    b = s[free].mean() if free.any() else (np.where(up, s, -np.inf).max() + np.where(low, s, np.inf).min()) / 2
    return a * y, b


def _interior(v: np.ndarray, s: np.ndarray, p: np.ndarray, c: np.ndarray, tol: float = 1e-9, maxiter: int = 200) -> np.ndarray:
    """min u'VV'u/2 + p'u with 0 <= u <= c and s'u = 0 by a primal-dual interior point method; V (rows, features) is low, so that a step is a pass of V'DV and no matrix of pairs is made."""
    n = len(p)
    u, t, z, w, b = c / 2, c / 2, np.ones(n), np.ones(n), 0.0  # t: c - u, kept by itself as it gets far below u
    eye, best, out = np.eye(v.shape[1]), np.inf, None
    for _ in range(maxiter):
        grad = v @ (v.T @ u)
        scale = 1 + np.abs(p).max() + np.abs(grad).max()
        r, q = grad + p + s * b - z + w, s @ u
        gap = (u @ z + t @ w) / (2 * n)
        off = max(np.abs(r).max() / scale, abs(q) / c.sum(), gap / scale)
        if not off < best and best < 1e-5:  # rounding has taken over
            break
        if off < best:
            best, out = off, u
        if off < tol:
            break
        d = z / u + w / t
        vd = v / d[:, None]
        small = np.linalg.inv(eye + v.T @ vd)

        def once(x):
            y = x / d
            return y - vd @ (small @ (v.T @ y))

        def solve(x):
            y = once(x)
            for _ in range(2):  # what rounding left over
                y = y + once(x - d * y - v @ (v.T @ y))
            return y

        hs = solve(s)

        def step(mz, mw):
            x = -r + mz / u - z - mw / t + w
            hx = solve(x)
            db = (s @ hx + q) / (s @ hs)
            du = hx - hs * db
            return du, db, (mz - z * du) / u - z, (mw + w * du) / t - w

        def far(du, dz, dw):
            at = [1.0]
            for x, dx in ((u, du), (t, -du), (z, dz), (w, dw)):
                back = dx < 0
                if back.any():
                    at.append((-x[back] / dx[back]).min())
            return min(at)

        du, db, dz, dw = step(0, 0)
        a = far(du, dz, dw)
        ahead = ((u + a * du) @ (z + a * dz) + (t - a * du) @ (w + a * dw)) / (2 * n)
        mu = gap * (ahead / gap) ** 3
        du, db, dz, dw = step(mu - du * dz, mu + du * dw)
        a = 0.995 * far(du, dz, dw)
        u, t, b, z, w = u + a * du, t - a * du, b + a * db, z + a * dz, w + a * dw
        if not np.isfinite(u).all():
            break
    if not best < 1e-5:
        raise ValueError(f"the dual problem didn't converge: {best:.1e}")
    return out


def _machine(f, s, p, c):
    """(weights, intercept) of the machine with features f whose dual has signs s, linear term p and bounds c."""
    v = f * s[:, None]
    u = _interior(v, s, p, c)
    weights = v.T @ u
    level = -s * (v @ weights + p)  # the intercept where u is free
    low, high = u < 1e-6 * c, u > (1 - 1e-6) * c
    free = ~low & ~high
    if free.any():
        return weights, float(np.average(level[free], weights=np.minimum(u, c - u)[free]))
    up, down = (high & (s < 0)) | (low & (s > 0)), (low & (s < 0)) | (high & (s > 0))
    return weights, float((level[up].max() + level[down].min()) / 2)


class _KernelMachine:
    """What SVC and SVR share: the kernel's reference and features.

    Up to DENSE rows, or with a kernel_fct, the dual is solved with all pairs at hand.  Beyond it the metric's features, p(p+1)/2 numbers a row, are on the driver
    (LIMIT rows) and the dual is solved by their products alone; then the machine is its weights, and prediction doesn't depend on the training rows.
    """

    LIMIT, DENSE = 20_000_000, 5_000

    def _load(self, df, col, columns):
        t = df.where(F.col(col).isNotNull()).select(col, *columns).limit(self.LIMIT + 1).toArrow()
        if t.num_rows > self.LIMIT:
            raise ValueError(f"the driver holds the features; the rows are more than {self.LIMIT}. TSClassifier with LinearSVC has no such bound")
        if self.kernel_fct is not None and t.num_rows > 4 * self.DENSE:
            raise ValueError(f"a kernel function makes a dense problem; the rows are more than {4 * self.DENSE}")
        x = decode(t[col])
        ref = self.Cref(x) if callable(self.Cref) else self.Cref
        if ref is None and self.kernel_fct is None:
            from tesserae.kernels.mean import mean as local

            ref = local(x, self.metric)[0]
        self.Cref_, self.x_ = ref, x
        self.explicit_ = self.kernel_fct is None and len(x) > self.DENSE
        return t

    def _features(self, x):
        f = G.upper(G.features(x, self.Cref_, self.metric))
        return np.concatenate([f.real, f.imag], 1) if np.iscomplexobj(f) else f

    def _gram(self, a, b):
        if self.kernel_fct is not None:
            return self.kernel_fct(a, b, self.Cref_) if self.kernel_fct.__code__.co_argcount > 2 else self.kernel_fct(a, b)
        return G.kernel(a, b, self.Cref_, self.metric)


class SVC(_KernelMachine, Classifier):
    """Support vector classifier with a Riemannian kernel, one against one."""

    def __init__(self, metric="riemann", kernel_fct=None, Cref=None, C=1.0, tol=1e-3, max_iter=-1):
        self.metric, self.kernel_fct, self.Cref, self.C, self.tol, self.max_iter = metric, kernel_fct, Cref, C, tol, max_iter

    def fit(self, df, y="y", weight=None, col="cov"):
        self.kind_ = label_type(df, y)
        df = df.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("string")).withColumn("__w", F.col(weight).cast("double") if weight else F.lit(1.0))
        t = self._load(df, col, ["__y", "__w"])
        lab, w = np.array(t["__y"].to_pylist(), object), t["__w"].to_numpy()
        self.classes_ = by_label(sorted(set(lab)), self.kind_)
        self.machines_ = []
        if self.explicit_:
            x, self.x_ = self._features(self.x_), None
            for i in range(len(self.classes_)):
                for j in range(i + 1, len(self.classes_)):
                    at = np.flatnonzero(((lab == self.classes_[i]) | (lab == self.classes_[j])) & (w > 0))
                    sign = np.where(lab[at] == self.classes_[i], 1.0, -1.0)
                    self.machines_.append((i, j, None, *_machine(x[at], sign, -np.ones(len(at)), self.C * w[at])))
            return self
        k = self._gram(self.x_, self.x_)
        for i in range(len(self.classes_)):
            for j in range(i + 1, len(self.classes_)):
                at = np.flatnonzero((lab == self.classes_[i]) | (lab == self.classes_[j]))
                sign = np.where(lab[at] == self.classes_[i], 1.0, -1.0)
                coef, b = _dual(k[np.ix_(at, at)], sign, self.C * w[at], self.tol, self.max_iter)
                sv = np.abs(coef) > 0
                self.machines_.append((i, j, at[sv], coef[sv], b))
        return self

    def transform(self, df, col="cov", out="votes"):
        """Votes of the pairwise machines, with ties broken by their confidence."""

        def f(x):
            k = self._features(x) if self.explicit_ else self._gram(x, self.x_)
            votes = np.zeros((len(x), len(self.classes_)))
            sure = np.zeros_like(votes)
            for i, j, at, coef, b in self.machines_:
                d = (k if at is None else k[:, at]) @ coef + b
                votes[:, i] += d > 0
                votes[:, j] += d <= 0
                sure[:, i] += d
                sure[:, j] -= d
            return votes + sure / (3 * (np.abs(sure) + 1))

        return apply(df, [col], {out: "vector"}, f)

    def predict(self, df, col="cov"):
        return argmin_label(self.transform(df, col).withColumn("votes", F.transform("votes", lambda v: -v)), "votes", self.classes_, self.kind_)


class SVR(_KernelMachine, Regressor):
    """Epsilon support vector regression with a Riemannian kernel."""

    def __init__(self, metric="riemann", kernel_fct=None, Cref=None, C=1.0, epsilon=0.1, tol=1e-3, max_iter=-1):
        self.metric, self.kernel_fct, self.Cref, self.C, self.epsilon, self.tol, self.max_iter = metric, kernel_fct, Cref, C, epsilon, tol, max_iter

    def fit(self, df, y="y", weight=None, col="cov"):
        t = self._load(df.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double")), col, ["__y"])
        target = t["__y"].to_numpy()
        if self.explicit_:
            x, self.x_ = self._features(self.x_), None
            sign = np.repeat([1.0, -1.0], len(x))
            self.coef_, self.b_ = _machine(np.concatenate([x, x]), sign, self.epsilon - sign * np.tile(target, 2), np.full(len(sign), float(self.C)))
            return self
        k = self._gram(self.x_, self.x_)
        n, c, eps = len(target), self.C, self.epsilon
        beta, f = np.zeros(n), np.zeros(n)  # f: the prediction without intercept
        for _ in range(self.max_iter if self.max_iter > 0 else 200 * n + 20_000):
            e = target - f
            rise = np.where(beta < c, e - eps * np.where(beta >= 0, 1, -1), -np.inf)
            fall = np.where(beta > -c, e - eps * np.where(beta > 0, 1, -1), np.inf)
            i, j = rise.argmax(), fall.argmin()
            if rise[i] - fall[j] <= self.tol:
                break
            step = (rise[i] - fall[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
            step = min(step, (0 if beta[i] < 0 else c) - beta[i], beta[j] - (0 if beta[j] > 0 else -c))
            beta[i] += step
            beta[j] -= step
            f += step * (k[:, i] - k[:, j])
        self.coef_, self.b_ = beta, (rise[i] + fall[j]) / 2
        return self

    def predict(self, df, col="cov"):
        return apply(df, [col], {"prediction": "double"}, lambda x: (self._features(x) if self.explicit_ else self._gram(x, self.x_)) @ self.coef_ + self.b_)


def class_distinctiveness(df: DataFrame, y: str = "y", exponent: int = 1, metric="riemann", col: str = "cov") -> dict:
    """Between-class over within-class dispersion: {"distinctiveness", "between", "within"}."""
    d, m = metric_of(metric, "distance"), metric_of(metric, "mean")
    means = {k: v.matrix for k, v in group_means(df, m, col, y).items()}
    classes = sorted(means)
    own = apply(df.withColumn("__y", F.col(y).cast("string")).where(F.col(y).isNotNull()), [col, "__y"], {"__d": "double"}, lambda x, lab: D.distance(x, np.stack([means[k] for k in lab]), d))
    within = {r["__y"]: r.s for r in own.groupBy("__y").agg(F.avg(F.pow("__d", F.lit(exponent))).alias("s")).collect()}
    if len(classes) == 2:
        num = float(D.distance(means[classes[0]], means[classes[1]], d)) ** exponent
        den = 0.5 * sum(within.values())
    else:
        grand = mean(df.where(F.col(y).isNotNull()), m, col) if callable(m) else _mean_of(np.stack([means[k] for k in classes]), m)
        num = sum(float(D.distance(means[k], grand, d)) ** exponent for k in classes)
        den = sum(within.values())
    return {"distinctiveness": num / den, "between": num, "within": den}


def _mean_of(x, metric):
    from tesserae.kernels.mean import mean as local

    return local(x, metric)[0]
