"""Row-local functions of matrix columns: spectral functions, distances, geodesics, maps, predicates, estimators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.columns import DISTANCE2
from tesserae.frames import _types, apply, decode, encode
from tesserae.kernels import covariance as C
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels import spectral as S
from tesserae.kernels.mean import masks_from_nan

SPECTRAL = {"expm": S.expm, "logm": S.logm, "sqrtm": S.sqrtm, "invsqrtm": S.invsqrtm, "powm": S.powm, "ctranspose": S.ct, "nearest_spd": S.nearest_spd}


def _kind(df: DataFrame, col: str) -> str:
    return "complex" if df.schema[col].dataType.typeName() == "struct" else "matrix"


def matrix_function(df: DataFrame, name: str, col: str = "cov", out: str = "out", **kw) -> DataFrame:
    """df with a spectral function of a matrix column: expm, logm, sqrtm, invsqrtm, powm(alpha), ctranspose, nearest_spd(reg)."""
    f = SPECTRAL[name]
    return apply(df, [col], {out: _kind(df, col)}, lambda x: f(x, **kw))


def predicate(df: DataFrame, name: str, col: str = "cov", out: str = "out", **kw) -> DataFrame:
    """df with a boolean column: sym, skew_sym, hankel, real, hermitian, pos_def, pos_semi_def, spd, spsd, hpd, hpsd."""
    f = S.PREDICATES[name]
    return apply(df, [col], {out: "boolean"}, lambda x: f(x, **kw))


def validate(df: DataFrame, col: str = "cov", mode: str = "raise") -> DataFrame:
    """df of positive definite matrices only: others raise, are dropped (drop) or replaced by a near one (repair)."""
    if mode == "repair":
        return apply(df, [col], {"__fixed": _kind(df, col)}, lambda x: np.where(S.is_hpd(x)[:, None, None], x, S.nearest_spd(x))).drop(col).withColumnRenamed("__fixed", col).select(*df.columns)
    ok = predicate(df, "hpd", col, "__ok")
    if mode == "drop":
        return ok.where("__ok").drop("__ok")
    if mode == "raise":
        return ok.where(F.when(F.col("__ok"), True).otherwise(F.raise_error(F.lit("a matrix isn't positive definite")).cast("boolean"))).drop("__ok")
    raise ValueError("mode is raise, drop or repair")


def distance(df: DataFrame, a: str, b, metric: str = "riemann", squared: bool = False, out: str = "distance", p: float | None = None, order: int | None = None) -> DataFrame:
    """df with the distance of matrix column a to column b or to one matrix (a numpy array).

    order=2 says that all matrices are real 2x2: then the distance is a Catalyst expression.
    """
    if order == 2 and metric in DISTANCE2:
        other = F.col(b) if isinstance(b, str) else F.array(*(F.lit(float(x)) for x in np.ravel(b)))
        d = DISTANCE2[metric](F.col(a), other)
        return df.withColumn(out, d * d if squared else d)
    if isinstance(b, str):
        return apply(df, [a, b], {out: "double"}, lambda x, y: D.distance(x, y, metric, squared, p))
    return apply(df, [a], {out: "double"}, lambda x: D.distance(x, b[None], metric, squared, p))


def distances(df: DataFrame, refs: np.ndarray, metric: str = "riemann", col: str = "cov", out: str = "distances") -> DataFrame:
    """df with the distances to each of a few matrices, in one pass."""
    return apply(df, [col], {out: "vector"}, lambda x: np.stack([D.distance(x, r[None], metric) for r in refs], 1))


def geodesic(df: DataFrame, a: str, b: str, alpha=0.5, metric: str = "riemann", out: str = "out") -> DataFrame:
    """df with the point at alpha (a number or a column's name) between two matrix columns."""
    if isinstance(alpha, str):
        return apply(df, [a, b, alpha], {out: _kind(df, a)}, lambda x, y, t: G.geodesic(x, y, t, metric))
    if not isinstance(alpha, (int, float)):
        raise ValueError("alpha is a number or the name of a column")
    return apply(df, [a, b], {out: _kind(df, a)}, lambda x, y: G.geodesic(x, y, alpha, metric))


def at_reference(df: DataFrame, name: str, ref: np.ndarray, metric: str = "riemann", col: str = "cov", out: str = "out", to: np.ndarray | None = None) -> DataFrame:
    """df with a function of a column and one reference: log_map, exp_map, tangent_space, untangent_space, transport (to another), ddexpm, ddlogm, norm."""
    if name == "norm":
        return apply(df, [col], {out: "double"}, lambda x: G.norm(x, ref, metric))
    if name == "untangent_space":
        m = ref.shape[0] * (ref.shape[0] + 1) // 2
        return apply(df, [col], {out: "matrix"}, lambda v: G.untangent_space(v, ref, metric), shapes={col: (m,)})
    f = {
        "log_map": lambda x: G.log_map(x, ref, metric), "exp_map": lambda x: G.exp_map(x, ref, metric), "tangent_space": lambda x: G.tangent_space(x, ref, metric),
        "transport": lambda x: G.transport(x, ref, to, metric), "ddexpm": lambda x: S.ddexpm(x, ref), "ddlogm": lambda x: S.ddlogm(x, ref),
    }[name]
    return apply(df, [col], {out: "vector" if name == "tangent_space" else _kind(df, col)}, f)


def inner_product(df: DataFrame, a: str, b: str, ref: np.ndarray, metric: str = "riemann", out: str = "out") -> DataFrame:
    return apply(df, [a, b], {out: "double"}, lambda x, y: G.inner(x, y, ref, metric))


def mahalanobis(df: DataFrame, col: str, cov: np.ndarray, mean=None, squared: bool = False, out: str = "distance") -> DataFrame:
    """df with the distance of each vector to the mean."""
    return apply(df, [col], {out: "double"}, lambda v: D.mahalanobis(v.T, cov, mean, squared), shapes={col: (len(cov),)})


def nan_masks(df: DataFrame, col: str = "cov", out: str = "keep") -> DataFrame:
    """df with 1 for every row of a matrix that isn't missing, else 0."""
    return apply(df, [col], {out: "ints"}, lambda x: masks_from_nan(x).astype(int))


def epoch_function(df: DataFrame, f, channels: int, col: str = "x", out: str = "cov", kind: str = "matrix") -> DataFrame:
    """df with f(stack of epochs (n, channels, times)); epochs of different lengths may meet in a batch."""

    def run(rows):
        sizes = np.array([len(r) for r in rows])
        result = None
        for s in np.unique(sizes):
            at = np.flatnonzero(sizes == s)
            y = f(np.stack([np.asarray(rows[i], float) for i in at]).reshape(len(at), channels, -1))
            if result is None:
                result = np.empty(len(rows), object)
            for i, v in zip(at, y):
                result[i] = v
        return np.stack(result)

    def batches(it):
        for b in it:
            if not b.num_rows:
                continue
            rows = b.column(col)
            ok = np.asarray(rows.is_valid())
            lists = rows.filter(pa.array(ok))
            values, offs = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            parts = [values[i:j] for i, j in zip(offs[:-1], offs[1:])]
            new = encode(run(parts), kind) if parts else None
            if new is None:
                continue
            if not ok.all():
                new = new.take(pa.array([int(k) if o else None for k, o in zip(np.cumsum(ok) - 1, ok)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), new], names=[*names, out])

    names = [c for c in df.columns if c != col]
    fields = [df.schema[c] for c in names] + [T.StructField(out, _types[kind])]
    return df.mapInArrow(batches, T.StructType(fields))


def covariances(df: DataFrame, channels: int, estimator: str = "scm", col: str = "x", out: str = "cov", **kw) -> DataFrame:
    """One covariance for each epoch (column of channels * times values, channel by channel)."""
    return epoch_function(df, lambda x: C.covariances(x, estimator, **kw), channels, col, out)


def cross_spectra(df: DataFrame, channels: int, col: str = "x", coherence: str | None = None, **kw) -> DataFrame:
    """Cross-spectra, or coherences of a kind, in long form: one row for each epoch and frequency (freq_bin, re, im)."""
    if coherence:
        f = lambda x: np.moveaxis(np.stack([C.coherence(e, kind=coherence, **kw)[0] for e in x]), -1, 1).astype(complex)
    else:
        f = lambda x: np.moveaxis(np.stack([C.cross_spectrum(e, **kw)[0] for e in x]), -1, 1)
    wide = epoch_function(df, f, channels, col, "s", "complex")
    p2 = channels * channels
    n = (F.size("s.re") / p2).cast("int")
    rest = [c for c in df.columns if c != col]
    long = wide.select(*rest, "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("freq_bin"))
    return long.select(*rest, "freq_bin", F.slice("s.re", F.col("freq_bin") * p2 + 1, p2).alias("re"), F.slice("s.im", F.col("freq_bin") * p2 + 1, p2).alias("im"))


__all__ = ["at_reference", "covariances", "cross_spectra", "decode", "distance", "distances", "epoch_function", "geodesic", "inner_product", "mahalanobis", "matrix_function", "nan_masks", "predicate", "validate"]
