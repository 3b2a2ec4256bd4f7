"""Permutation tests on matrix sets.

The pairwise test makes one pass over all pairs: sums within the classes of every permutation are added up where distances are
computed, and a row for each permutation comes back.  Labels alone are on the driver and in the closure (LIMIT rows).  The other tests, whose
every permutation needs means or models anew, run permutations as rows of spark.range, each seeded by (seed, number), with the matrices as a broadcast of
checked size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.frames import decode
from tesserae.kernels import distance as D
from tesserae.kernels.mean import mean as local_mean
from tesserae.ml.base import metric_of
from tesserae.operators.pairs import BROADCAST_MB, group_sums

LIMIT = 2_000_000


def multiset_perm_number(y) -> int:
    """Number of distinct orders of the labels."""
    out = math.factorial(len(y))
    for n in np.unique(y, return_counts=True)[1]:
        out //= math.factorial(int(n))
    return out


def unique_permutations(y):
    """All distinct orders, in ascending order."""
    y = sorted(y)
    while True:
        yield tuple(y)
        i = len(y) - 2
        while i >= 0 and not y[i] < y[i + 1]:
            i -= 1
        if i < 0:
            return
        j = len(y) - 1
        while not y[i] < y[j]:
            j -= 1
        y[i], y[j] = y[j], y[i]
        y[i + 1 :] = reversed(y[i + 1 :])


def pseudo_f(d2: np.ndarray, y: np.ndarray) -> float:
    """Anderson's pseudo-F of squared distances."""
    n, labels = len(y), np.unique(y)
    total = d2.sum() / (2 * n)
    within = sum(d2[np.ix_(y == v, y == v)].sum() / (2 * (y == v).sum()) for v in labels)
    return ((total - within) / (len(labels) - 1)) / (within / (n - len(labels)))


def t_score(x, y, metric="riemann"):
    """Distance between two class means over the pooled dispersion."""
    labels = np.unique(y)
    if len(labels) != 2:
        raise ValueError("the t-test needs two classes")
    m = [local_mean(x[y == v], metric_of(metric, "mean"))[0] for v in labels]
    d = metric_of(metric, "distance")
    spread = sum((D.distance(x[y == v], c[None], d) ** 2).mean() for v, c in zip(labels, m))
    return float(D.distance(m[0], m[1], d) / np.sqrt(spread))


def f_score(x, y, metric="riemann"):
    """Between-class over within-class variance around class means."""
    labels, mm, d = np.unique(y), metric_of(metric, "mean"), metric_of(metric, "distance")
    grand = local_mean(x, mm)[0]
    between = within = 0.0
    for v in labels:
        c = local_mean(x[y == v], mm)[0]
        between += (y == v).sum() * float(D.distance(c, grand, d)) ** 2
        within += (D.distance(x[y == v], c[None], d) ** 2).sum()
    return (between / (len(labels) - 1)) / (within / (len(y) - len(labels)))


class Codes:
    """Class numbers of rows under several labellings."""

    def __init__(self, ids, labellings):
        self.ids = np.asarray(ids)
        self.codes = np.stack([np.unique(y, return_inverse=True)[1].astype(np.int32) for y in labellings])
        self.sizes = np.stack([np.bincount(c, minlength=self.codes.max() + 1) for c in self.codes]).astype(float)

    def __call__(self, ids):
        return self.codes[:, np.searchsorted(self.ids, ids)]


class _Permutation:
    def _labels(self, df, y, groups, id_, col=None):
        """Ids, labels and groups in the order of ids, and the matrices if a column is named; after a check of their size."""
        n, width = df.agg(F.count("*"), F.max(F.size(col)) if col else F.lit(0)).first()
        if n > LIMIT or n * 8 * (width or 0) > BROADCAST_MB * 1e6:
            raise ValueError(f"{n} rows of {width or 0} values are more than one task can permute; test a sample")
        t = df.select(F.col(id_).cast("long").alias("i"), F.col(y).alias("y"), *([F.col(groups).alias("g")] if groups else []), *([F.col(col).alias("m")] if col else [])).orderBy("i").toArrow()
        return t["i"].to_numpy(), np.array(t["y"].to_pylist()), np.array(t["g"].to_pylist()) if groups else None, decode(t["m"]) if col else None

    def _orders(self, y, groups):
        """(exact, number of orders, order(k)): all distinct ones if they are no more than n_perms, else seeded shuffles within groups; order 0 is the given one."""
        total = multiset_perm_number(y)
        if groups is None and total <= self.n_perms:
            given = tuple(y)
            every = [given, *(p for p in unique_permutations(y) if p != given)]
            return True, len(every), lambda k: np.array(every[k])
        seed = self.random_state

        def order(k):
            if k == 0:
                return y
            rng = np.random.default_rng([seed, k])
            out = y.copy()
            for g in [None] if groups is None else np.unique(groups):
                at = np.arange(len(y)) if g is None else np.flatnonzero(groups == g)
                out[at] = y[rng.permutation(at)]
            return out

        return False, self.n_perms, order

    def _run(self, spark, n, score):
        def go(batches):
            for b in batches:
                ks = b.column(0).to_pylist()
                if ks:
                    yield pa.RecordBatch.from_pydict({"k": ks, "score": [float(score(int(k))) for k in ks]})

        return spark.range(n).mapInArrow(go, "k long, score double").toArrow().sort_by("k")["score"].to_numpy()

    def _finish(self, scores):
        self.scores_ = scores
        return float((scores[0] <= scores).mean()), scores[1:]


class PermutationDistance(_Permutation):
    """mode pairwise (PERMANOVA pseudo-F), ttest or ftest; test() gives (p-value, scores of the other permutations)."""

    def __init__(self, n_perms=100, metric="riemann", mode="pairwise", random_state=42):
        if mode not in ("pairwise", "ttest", "ftest"):
            raise ValueError(f"unknown mode {mode!r}")
        self.n_perms, self.metric, self.mode, self.random_state = n_perms, metric, mode, random_state

    def test(self, df: DataFrame, y: str = "y", groups: str | None = None, col: str = "cov", id_: str = "id"):
        df = df.where(F.col(y).isNotNull() & F.col(col).isNotNull())
        spark = df.sparkSession
        if self.mode == "pairwise":
            ids, lab, g, _ = self._labels(df, y, groups, id_)
            _, n, order = self._orders(lab, g)
            codes = Codes(ids, [order(k) for k in range(n)])
            got = {r.k: r for r in group_sums(df, codes, metric_of(self.metric, "distance"), id_, col).collect()}  # n rows
            size, classes = len(lab), len(np.unique(lab))
            scores = [((got[k].total / size - got[k].within) / (classes - 1)) / (got[k].within / (size - classes)) for k in range(n)]
            return self._finish(np.array(scores))
        _, lab, g, m = self._labels(df, y, groups, id_, col)
        _, n, order = self._orders(lab, g)
        x, f, metric = spark.sparkContext.broadcast(m), t_score if self.mode == "ttest" else f_score, self.metric
        return self._finish(self._run(spark, n, lambda k: f(x.value, order(k), metric)))


class PermutationModel(_Permutation):
    """Score: cross-validated accuracy of minimum distance to mean, or of a callable model(x_train, y_train, x_test) -> labels."""

    def __init__(self, n_perms=100, model=None, cv=3, metric="riemann", random_state=42):
        self.n_perms, self.model, self.cv, self.metric, self.random_state = n_perms, model, cv, metric, random_state

    def test(self, df: DataFrame, y: str = "y", groups: str | None = None, col: str = "cov", id_: str = "id"):
        df = df.where(F.col(y).isNotNull() & F.col(col).isNotNull())
        _, lab, g, m = self._labels(df, y, groups, id_, col)
        _, n, order = self._orders(lab, g)
        x = df.sparkSession.sparkContext.broadcast(m)
        model, cv = self.model or _mdm(self.metric), self.cv
        return self._finish(self._run(df.sparkSession, n, lambda k: cross_validated(x.value, order(k), model, cv)))


def _mdm(metric):
    def model(x, y, new):
        labels = np.unique(y)
        m = np.stack([local_mean(x[y == v], metric_of(metric, "mean"))[0] for v in labels])
        return labels[np.stack([D.distance(new, c[None], metric_of(metric, "distance")) for c in m]).argmin(0)]

    return model


def folds(y: np.ndarray, cv: int) -> np.ndarray:
    """Stratified fold numbers: rows of a class go round the folds."""
    out = np.empty(len(y), int)
    for v in np.unique(y):
        at = np.flatnonzero(y == v)
        out[at] = np.arange(len(at)) % cv
    return out


def cross_validated(x, y, model, cv) -> float:
    f = folds(y, cv)
    return float(np.mean([(model(x[f != k], y[f != k], x[f == k]) == y[f == k]).mean() for k in range(cv) if (f == k).any()]))


__all__ = ["PermutationDistance", "PermutationModel", "cross_validated", "f_score", "folds", "multiset_perm_number", "pseudo_f", "t_score", "unique_permutations"]
