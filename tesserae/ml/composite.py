"""Transformers put together from others: hybrid blocks, filter banks and band selection, image windows and pixel PCA, patches of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae import functions as fn
from tesserae.frames import apply, decode
from tesserae.kernels import covariance as C
from tesserae.ml.base import Estimator
from tesserae.ml.classification import class_distinctiveness
from tesserae.operators.means import mean_frame
from tesserae.operators.pairs import _best, _blocked, _sets

CHANNEL_KERNELS = ("linear", "poly", "polynomial", "rbf", "laplacian", "cosine")


class HybridBlocks(Estimator):
    """Block-diagonal matrices of epochs whose blocks of channels each have an estimator of their own (a channel kernel or a covariance) and a shrinkage."""

    def __init__(self, channels: int, block_size, metric="linear", shrinkage=0, **kw):
        self.channels, self.block_size, self.metric, self.shrinkage, self.kw = channels, block_size, metric, shrinkage, kw

    def fit(self, df: DataFrame | None = None, **_) -> HybridBlocks:
        n, size = self.channels, self.block_size
        if isinstance(size, int):
            self.blocks_ = [size] * (n // size) + ([n % size] if n % size else [])
        elif isinstance(size, list):
            self.blocks_ = size
            if sum(size) != n:
                raise ValueError("the blocks must add up to the channels")
        else:
            raise ValueError("block_size is a number or a list of numbers")
        self.metrics_, self.shrinkages_ = (x if isinstance(x, list) else [x] * len(self.blocks_) for x in (self.metric, self.shrinkage))
        if not len(self.metrics_) == len(self.shrinkages_) == len(self.blocks_):
            raise ValueError("a metric and a shrinkage for each block are needed")
        if bad := [m for m in self.metrics_ if m not in CHANNEL_KERNELS and m not in C.ESTIMATORS]:
            raise ValueError(f"unknown metric {bad[0]!r}")
        return self

    def transform(self, df: DataFrame, col: str = "x", out: str = "cov") -> DataFrame:
        plan = list(zip(self.blocks_, self.metrics_, self.shrinkages_))
        kw = self.kw

        def f(x):
            y = np.zeros((*x.shape[:-1], x.shape[-2]))
            at = 0
            for n, metric, shrinkage in plan:
                part = x[..., at : at + n, :]
                m = C.channel_kernel(part, metric, **kw) if metric in CHANNEL_KERNELS else C.covariances(part, metric, **kw)
                y[..., at : at + n, at : at + n] = C.shrink(m, shrinkage) if shrinkage else m
                at += n
            return y

        return fn.epoch_function(df, f, self.channels, col, out)


def bandpass(df: DataFrame, channels: int, fmin: float, fmax: float, fs: float, col: str = "x", out: str | None = None) -> DataFrame:
    """df with the epochs' frequencies outside [fmin, fmax] set to zero (an ideal filter by Fourier transform)."""

    def f(x):
        s = np.fft.rfft(x, axis=-1)
        freqs = np.fft.rfftfreq(x.shape[-1], 1 / fs)
        s[..., (freqs < fmin) | (freqs > fmax)] = 0
        return np.fft.irfft(s, x.shape[-1], axis=-1)

    target = out or col
    if target == col:
        return fn.epoch_function(df.withColumnRenamed(col, "__x"), f, channels, "__x", col, "vector")
    return fn.epoch_function(df.withColumn("__x", F.col(col)), f, channels, "__x", target, "vector")


def filter_bank(df: DataFrame, channels: int, frequencies: list[float], width: float, fs: float, col: str = "x") -> DataFrame:
    """df with epochs of channels * len(frequencies) channels: the signal around each frequency, one under the other."""
    names = [f"__band{k}" for k in range(len(frequencies))]
    wide = df
    for name, at in zip(names, frequencies):
        wide = bandpass(wide, channels, at - width, at + width, fs, col, name)
    return wide.withColumn(col, F.concat(*names)).select(*df.columns)


def band_selection(df: DataFrame, channels: int, fs: float, band=(5.0, 35.0), width: float = 4, step: float = 2, alpha: float = 0.4, y: str = "y", col: str = "x", estimator: str = "cov", metric="riemann") -> tuple[list[float], list[float]]:
    """The frequency band whose classes differ most, and the class distinctiveness of every sub-band.

    From the best sub-band the band grows to both sides as long as the sub-bands reach max - (max - min) * alpha.
    """
    low, high = np.arange(band[0], band[1] - width + 1.0, step), np.arange(band[0] + width, band[1] + 1.0, step)
    rows = df.where(F.col(y).isNotNull()).select(y, col).persist()
    try:
        found = []
        for a, b in zip(low, high):
            cov = fn.covariances(bandpass(rows, channels, a, b, fs, col), channels, estimator, col)
            found.append(class_distinctiveness(cov, y, metric=metric)["distinctiveness"])
    finally:
        rows.unpersist()
    return widest_band(found, low, high, alpha), found


def widest_band(found: list[float], low, high, alpha: float) -> list[float]:
    first = last = int(np.argmax(found))
    least = max(found) - (max(found) - min(found)) * alpha
    while first > 0 and found[first - 1] >= least:
        first -= 1
    while last < len(found) - 1 and found[last + 1] >= least:
        last += 1
    return [float(low[first]), float(high[last])]


def image_windows(pixels: DataFrame, size: int, step: int = 1, row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """(row, col, x) for every window of size x size pixels, named by its upper left one: x has a channel for each feature, the pixels row by row.

    pixels: (row, col, v array<double>).  Each pixel goes to the windows that it is in, step by step; windows that reach over the edge are left out.
    """
    if size % 2 == 0 or not 1 <= step <= max(1, size // 2):
        raise ValueError("the size must be odd, and the step within half of it")
    tops = lambda c: F.filter(F.sequence(F.col(c) - size + 1, F.col(c)), lambda t: (t >= 0) & (t % step == 0))
    sent = pixels.select(F.explode(tops(row)).alias("__r"), row, col, value).select("__r", F.explode(tops(col)).alias("__c"), row, col, value)
    g = sent.groupBy("__r", "__c").agg(F.sort_array(F.collect_list(F.struct(row, col, value))).alias("p")).where(F.size("p") == size * size)
    n = F.size(F.col("p")[0][value])
    x = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform("p", lambda q: q[value][k])))
    return g.select(F.col("__r").alias(row), F.col("__c").alias(col), x.alias("x"))


class PCAImage(Estimator):
    """Pixels reduced to their first principal components: one pass for the covariance of the features, one to project."""

    def __init__(self, n_components: int):
        self.n_components = n_components

    def fit(self, pixels: DataFrame, col: str = "v") -> PCAImage:
        pixels = pixels.where(F.col(col).isNotNull())
        split = pixels.schema[col].dataType.typeName() == "struct"

        def partial(batches):
            n, s, c = 0, 0, 0
            for b in batches:
                if b.num_rows:
                    x = decode(b.column(0), (-1,))
                    n, s, c = n + len(x), s + x.sum(0), c + x.conj().T @ x
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "re": [np.r_[np.real(s), np.real(c).ravel()].tolist()], "im": [np.r_[np.imag(s), np.imag(c).ravel()].tolist()]})

        n, total = 0, 0
        for r in pixels.select(col).mapInArrow(partial, "n long, re array<double>, im array<double>").toLocalIterator():
            n, total = n + r.n, total + np.asarray(r.re) + 1j * np.asarray(r.im)
        if not n:
            raise ValueError("there are no pixels")
        p = round((-1 + (1 + 4 * len(total)) ** 0.5) / 2)
        self.mean_ = total[:p] / n
        cov = total[p:].reshape(p, p) / n - np.outer(self.mean_.conj(), self.mean_)
        w, v = np.linalg.eigh(cov if split else cov.real)
        self.explained_variance_, self.components_ = w[::-1][: self.n_components], v[:, ::-1][:, : self.n_components]
        if not split:
            self.mean_ = self.mean_.real
        return self

    def transform(self, pixels: DataFrame, col: str = "v") -> DataFrame:
        m, v = self.mean_, self.components_
        kind = "complex" if pixels.schema[col].dataType.typeName() == "struct" else "vector"
        return apply(pixels, [col], {"__t": kind}, lambda x: (x - m) @ v, shapes={col: (-1,)}).drop(col).withColumnRenamed("__t", col).select(*pixels.columns)


def neighbour_patches(df: DataFrame, k: int = 6, id_: str = "id", col: str = "v") -> DataFrame:
    """(id, x) for every vector: x has a channel for each dimension and a sample for each of the k nearest vectors, the vector itself included: the unit direction to it (zero to itself).

    Products of vectors bound the distances; those that may count are computed from the differences, so that copies are at the same distance; ties go to the smaller id.
    """

    def f(li, lm, ri, rm, block):
        def exact(i, j):
            return np.where(li[i] == ri[j], -1, np.linalg.norm(lm[i] - rm[j], axis=1))  # itself first

        i, j, d = _best(li, lm, ri, rm, k, block, exact)
        v = rm[j] - lm[i]
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.where(size > 1e-10, v / np.maximum(size, 1e-300), 0)
        cut = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(li[i]), pa.array(ri[j]), pa.array(d), pa.ListArray.from_arrays(cut, pa.array(v.ravel()))], names=["i", "j", "d", "u"])

    a = _sets(df, id_, col)
    best = _blocked(a, a, f, "i long, j long, d double, u array<double>", shape=(-1,), whole=True)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)
    g = best.groupBy(F.col("i").alias(id_)).agg(F.sort_array(F.collect_list(F.struct("rank", "j", "u"))).alias("p"))
    n = F.size(F.col("p")[0]["u"])
    x = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.transform("p", lambda q: q["u"][c])))
    return g.select(id_, F.transform("p", lambda q: q["j"]).alias("neighbours"), x.alias("x"))


def aggregate(df: DataFrame, size: int, metric: str = "riemann", id_: str = "id", col: str = "cov", **kw) -> DataFrame:
    """The mean of every `size` matrices in the order of ids 0, 1, ...: (key, mean); an unfinished last group is left out."""
    key = F.floor(F.col(id_) / size).cast("long")
    rows = df.where(F.col(col).isNotNull()).select(key.alias("__k"), F.col(col).alias("cov"))
    whole = rows.groupBy("__k").agg(F.count("*").alias("__n")).where(F.col("__n") == size).select("__k")
    return mean_frame(rows.join(whole, "__k"), metric, by="__k", **kw).select("key", "mean")


__all__ = ["HybridBlocks", "PCAImage", "aggregate", "band_selection", "bandpass", "filter_bank", "image_windows", "neighbour_patches", "widest_band"]
