"""Means and medians of a matrix set, overall or by group.

Direct means are one pass: a batch's row-local transforms are summed by group in
numpy, and the partial sums, one row for each batch and group, are added up
by Spark.  Iterative means repeat such passes over the persisted input with the
groups' states in the closure; groups that have converged are skipped.  Means that need
a whole set at once run in one task for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.frames import decode, encode
from tesserae.kernels import mean as M
from tesserae.kernels.geometry import geodesic

WHOLE = ("ale", "alm", "bmp", "cheap", "thompson")
GROUPS, HELD = 10_000, 20_000


def _prepared(df: DataFrame, col: str, by: str | None, weight: str | None, extra: list[str] = ()) -> DataFrame:
    key = F.col(by).cast("string") if by else F.lit("")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(F.col(col).isNotNull()).select(key.alias("key"), w.alias("w"), F.col(col).alias("m"), *extra)


def summed(rows: DataFrame, f, vectors: bool = False) -> DataFrame:
    """(key, w, re, im): sums of w and of w * f(stack, key) over rows (key, w, m); one pass, one shuffle of a row for each partition and key.

    vectors: m isn't a matrix but a vector, and so is the result.  A task holds the sums of HELD keys at most before it sends them on.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def sent():
            v = np.stack([np.ravel(t) for _, t in held.values()])
            both = encode(np.asarray(v, complex), "complex")
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([float(s) for s, _ in held.values()]), both.field("re"), both.field("im")], names=["key", "w", "re", "im"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_pylist()
            x, w = decode(batch.column("m"), (-1,) if vectors else None), batch.column("w").to_numpy()
            index: dict = {}
            for i, k in enumerate(keys):
                index.setdefault(k, []).append(i)
            for k, at in index.items():
                y = f(x[at], k)
                if y is None:
                    continue
                part = np.tensordot(w[at], y, 1)
                old = held.get(k)
                held[k] = (w[at].sum(), part) if old is None else (old[0] + w[at].sum(), old[1] + part)
            if len(held) > HELD:
                yield from sent()
                held.clear()
        if held:
            yield from sent()

    def total(table: pa.Table) -> pa.Table:
        re, im = (sum(np.asarray(v) for v in table[c].to_pylist()) for c in ("re", "im"))
        return pa.table({"key": table["key"].slice(0, 1), "w": [sum(table["w"].to_pylist())], "re": [re.tolist()], "im": [im.tolist()]})

    kind = "key string, w double, re array<double>, im array<double>"
    return rows.mapInArrow(partial, kind).groupBy("key").applyInArrow(total, kind)


def sums(rows: DataFrame, f, vectors: bool = False) -> dict[str | None, tuple[float, np.ndarray]]:
    """{key: (sum of w, sum of w * f(stack, key))} of summed(), on the driver; for few keys."""
    out = {}
    for r in summed(rows, f, vectors).toLocalIterator():
        v = np.asarray(r.re) + 1j * np.asarray(r.im) if np.any(r.im) else np.asarray(r.re)
        p = round(len(v) ** 0.5)
        out[r.key] = (r.w, v.reshape(p, p) if p * p == len(v) and not vectors else v)
    return out


class Mean:
    """matrix, n_iter and converged of one group."""

    def __init__(self, matrix, n_iter=1, converged=True):
        self.matrix, self.n_iter, self.converged = matrix, n_iter, converged

    def __repr__(self):
        return f"Mean(n_iter={self.n_iter}, converged={self.converged})"


def group_means(df: DataFrame, metric: str = "riemann", col: str = "cov", by: str | None = None, weight: str | None = None, p: float | None = None, init=None, tol=None, maxiter=None, order: str | None = None) -> dict[str | None, Mean]:
    """{group: Mean}; without `by` the only group is "".

    metric is one of kernels.mean.MEANS or a callable (stack, weights) -> matrix.  Rows with a null
    matrix are ignored.  thompson depends on the order, which `order` gives.
    """
    rows = _prepared(df, col, by, weight, [F.col(order).alias("at")] if order else [])
    if callable(metric) or metric in WHOLE:
        if metric == "thompson" and not order:
            raise ValueError("the thompson mean depends on the order of the rows; name a column in `order`")
        return _whole(rows, metric, p, init, tol, maxiter)
    f = M.mapped(metric, p)
    if f:
        return {k: Mean(f[1](s / w)) for k, (w, s) in sums(rows.select("key", "w", "m"), lambda x, k: f[0](x)).items()}
    if metric == "kullback_sym":
        return {k: Mean(_between(s / w)) for k, (w, s) in sums(rows.select("key", "w", "m"), _with_inverse).items()}
    rows = rows.select("key", "w", "m").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = {k: s / w for k, (w, s) in sums(rows, lambda x, k: x).items()} if init is None else None
        if start is None:
            keys = [r.key for r in rows.select("key").distinct().collect()]
            start = {k: init[k] if isinstance(init, dict) else init for k in keys}
        steps = {k: M.step(metric, m, p, tol, maxiter) for k, m in start.items()}
        if any(s is None for s in steps.values()):
            raise ValueError(f"unknown mean {metric!r}; known: {', '.join(M.MEANS)}")
        live = dict(steps)
        while live:
            terms = {k: s for k, s in live.items()}
            for k, (w, s) in sums(rows, lambda x, k, terms=terms: terms[k].term(x) if k in terms else None).items():
                if live[k].update(s / w):
                    live.pop(k)
        return {k: Mean(s.m, s.n_iter, s.converged) for k, s in steps.items()}
    finally:
        rows.unpersist()


def _with_inverse(x, k):
    return np.concatenate([x.reshape(len(x), -1), np.linalg.inv(x).reshape(len(x), -1)], 1)


def _between(s) -> np.ndarray:
    """The middle of the arithmetic and the harmonic mean, from the mean of _with_inverse()."""
    s = np.ravel(s)
    q = round((len(s) / 2) ** 0.5)
    return geodesic(s[: q * q].reshape(q, q), np.linalg.inv(s[q * q :].reshape(q, q)), 0.5)


def _whole(rows: DataFrame, metric, p, init, tol, maxiter) -> dict[str | None, Mean]:
    ordered = "at" in rows.columns

    def one(table: pa.Table) -> pa.Table:
        if ordered:
            table = table.sort_by("at")
        m, n, ok = M.mean(decode(table["m"]), metric, None if metric == "thompson" else table["w"].to_numpy(), p, init, tol, maxiter)
        return pa.table({"key": table["key"].slice(0, 1), "re": [np.real(m).ravel().tolist()], "im": [np.imag(m).ravel().tolist()], "n": pa.array([n], pa.int32()), "ok": [bool(ok)]})

    out = {}
    for r in rows.groupBy("key").applyInArrow(one, "key string, re array<double>, im array<double>, n int, ok boolean").collect():
        m = np.asarray(r.re) + 1j * np.asarray(r.im) if np.any(r.im) else np.asarray(r.re)
        q = round(len(m) ** 0.5)
        out[r.key] = Mean(m.reshape(q, q), r.n, r.ok)
    return out


def mean(df: DataFrame, metric: str = "riemann", col: str = "cov", weight: str | None = None, **kw) -> np.ndarray:
    """The mean of a whole set."""
    out = group_means(df, metric, col, None, weight, **kw)
    if not out:
        raise ValueError("the set is empty")
    return out[""].matrix


def mean_frame(df: DataFrame, metric: str = "riemann", col: str = "cov", by: str | None = None, **kw) -> DataFrame:
    """One row for each group: key, mean, n_iter, converged.

    Closed-form means never leave the executors, however many groups there are; iterative means of more than GROUPS groups run a task for each
    instead of driver loops.
    """
    f = None if callable(metric) else M.mapped(metric, kw.get("p"))
    if f or metric == "kullback_sym":
        inner, outer = (lambda x, k: f[0](x), f[1]) if f else (_with_inverse, _between)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, ws, rows = b.column("key"), b.column("w").to_numpy(), b.column("re").to_pylist()
                got = []
                for w, r in zip(ws, rows):
                    v = np.asarray(r) / w
                    q = round(len(v) ** 0.5)
                    got.append(np.real(outer(v.reshape(q, q) if q * q == len(v) and f else v)).ravel().tolist())
                yield pa.RecordBatch.from_arrays([keys, pa.array(got, pa.list_(pa.float64())), pa.array([1] * len(got), pa.int32()), pa.array([True] * len(got))], names=["key", "mean", "n_iter", "converged"])

        rows = _prepared(df, col, by, kw.get("weight"))
        return summed(rows, inner).mapInArrow(finish, "key string, mean array<double>, n_iter int, converged boolean")
    if by and M.mapped(metric, kw.get("p")) is None and metric not in WHOLE and not callable(metric) and df.select(by).distinct().limit(GROUPS + 1).count() > GROUPS:
        rows = _prepared(df, col, by, kw.get("weight"))

        def one(table: pa.Table) -> pa.Table:
            m, n, ok = M.mean(decode(table["m"]), metric, table["w"].to_numpy(), kw.get("p"), None, kw.get("tol"), kw.get("maxiter"))
            return pa.table({"key": table["key"].slice(0, 1), "mean": [np.real(m).ravel().tolist()], "n_iter": pa.array([n], pa.int32()), "converged": [bool(ok)]})

        return rows.groupBy("key").applyInArrow(one, "key string, mean array<double>, n_iter int, converged boolean")
    got = group_means(df, metric, col, by, **kw)
    rows = [(k, np.real(m.matrix).ravel().tolist(), int(m.n_iter), bool(m.converged)) for k, m in got.items()]
    return df.sparkSession.createDataFrame(rows, "key string, mean array<double>, n_iter int, converged boolean")


def median(df: DataFrame, metric: str = "euclid", col: str = "cov", weight: str | None = None, tol: float = 1e-5, maxiter: int = 50, step_size: float = 1.0, init=None) -> Mean:
    """Geometric median by passes of weighted sums."""
    rows = _prepared(df, col, None, weight).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = rows.agg(F.sum("w")).first()[0]
        m = mean(df, "euclid", col, weight) if init is None else init
        for k in range(maxiter):

            def one(x, _, m=m):
                d = M.distance(x, m, metric)
                off = d > 1e-10
                u = np.where(off, 1 / np.where(off, d, 1), 0)
                y = x if metric == "euclid" else M.log_map(x, m)
                return np.concatenate([(u[:, None, None] * y).reshape(len(x), -1), u[:, None], (~off)[:, None].astype(float)], 1)

            s = np.ravel(sums(rows, one)[""][1]) / total
            q = m.shape[0]
            new = M.median_update(m, s[: q * q].reshape(q, q), s[-2], s[-1], metric, step_size)
            crit = np.linalg.norm(new - m) / np.linalg.norm(m)
            m = new
            if crit <= tol:
                return Mean(m, k + 1, True)
        return Mean(m, maxiter, False)
    finally:
        rows.unpersist()


def maskedmean_riemann(df: DataFrame, col: str = "cov", keep: str | None = None, mask: str | None = None, weight: str | None = None, tol: float = 1e-8, maxiter: int = 50, init=None) -> Mean:
    """Riemannian mean of matrices of which only some channels are there.

    keep is a column of 0/1 for each channel; mask one of semi-orthogonal p x m matrices, row by row, through which the matrices are seen; without
    either, rows and columns of NaN are missing (nanmean).
    """
    if keep and mask:
        raise ValueError("give keep or mask, not both")
    rows = _prepared(df, col, None, weight, [F.col(keep or mask).alias("keep")] if keep or mask else []).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def term(state):
            def f(batches):
                weight, total, count = 0.0, 0, 0
                for b in batches:
                    if not b.num_rows:
                        continue
                    x, w = decode(b.column("m")), b.column("w").to_numpy()
                    p = x.shape[-1]
                    weight += w.sum()
                    if mask:
                        kinds: dict[tuple, list[int]] = {}
                        for i, q in enumerate(b.column("keep").to_pylist()):
                            kinds.setdefault(tuple(q), []).append(i)
                        total, count = total + np.zeros((p, p)), count + np.full((p, p), w.sum())
                        for q, at in kinds.items() if state is not None else ():
                            q = np.asarray(q).reshape(p, -1)
                            total += np.tensordot(w[at], M.masked_term(state, q.T @ x[at] @ q, q), 1)
                        continue
                    masks = decode(b.column("keep"), (-1,)).astype(bool) if keep else M.masks_from_nan(x)
                    codes = np.packbits(masks, axis=1)
                    codes = codes.astype(np.int64) @ (1 << 8 * np.arange(codes.shape[1])) if codes.shape[1] < 8 else codes
                    _, first, which = np.unique(codes, axis=None if codes.ndim == 1 else 0, return_index=True, return_inverse=True)
                    for j, k in enumerate(masks[first]):  # all matrices with the same channels at once
                        at = np.ravel(which) == j
                        q = np.eye(p)[:, k]
                        y = np.nan_to_num(x[at])
                        total = total + np.tensordot(w[at], M.masked_term(state, y[:, k][:, :, k], q) if state is not None else y * np.outer(k, k), 1)
                        count = count + w[at].sum() * np.outer(k, k)
                if np.ndim(total):
                    yield pa.RecordBatch.from_pydict({"w": [float(weight)], "s": [total.ravel().tolist()], "c": [count.ravel().tolist()]})

            got = rows.mapInArrow(f, "w double, s array<double>, c array<double>").collect()  # a row for each partition, all at the same time
            w, s, c = 0.0, 0.0, 0.0
            for r in got:
                w, s, c = w + r.w, s + np.asarray(r.s), c + np.asarray(r.c)
            q = round(len(s) ** 0.5)
            return w, s.reshape(q, q), c.reshape(q, q)

        if init is None:
            w, s, c = term(None)
            init = np.where(c > 0, s / np.maximum(c, 1e-300), 0) + 1e-6 * np.eye(len(s)) if not keep and not mask else np.eye(len(s))
        m, nu, last, k = init, 1.0, np.inf, 0
        while True:
            w, grad, _ = term(m)
            grad = grad / w
            r, s = M.roots(m)
            m = M.sym(r @ M.expm(nu * M.sym(s @ grad @ s)) @ r)
            crit, k = np.linalg.norm(grad), k + 1
            nu, last = (0.95 * nu, nu * crit) if nu * crit < last else (0.5 * nu, last)
            if crit <= tol or nu <= tol or k >= maxiter:
                return Mean(m, k, bool(crit <= tol or nu <= tol))
    finally:
        rows.unpersist()
