"""Seeded generators of matrices.  Row i depends on (seed, i) alone, so partitioning doesn't change the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.frames import COMPLEX, REAL, encode
from tesserae.kernels import geometry as G
from tesserae.kernels.spectral import ct, powm, sqrtm

KINDS = ("real", "comp", "inv", "cinv", "orth", "unit", "sym", "herm", "spd", "spsd", "hpd", "hpsd")


def one_matrix(rng, p, kind, low=0.5, high=2.0, vectors=None, mean=0.0, std=1.0):
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    a = rng.normal(mean, std, (p, p))
    c = kind in ("comp", "cinv", "unit", "herm", "hpd", "hpsd")
    if c:
        a = a + 1j * rng.normal(mean, std, (p, p))
    if kind in ("real", "comp", "inv", "cinv"):
        return a
    if kind in ("sym", "herm"):
        return a + ct(a)
    q, r = np.linalg.qr(a)
    q = q * (np.diagonal(r) / np.abs(np.diagonal(r)))
    if kind in ("orth", "unit"):
        return q
    w = rng.uniform(low, high, p)
    if kind in ("spsd", "hpsd"):
        w[-1] = 1e-10
    q = q if vectors is None else vectors
    m = (q * w) @ ct(q)
    return (m + ct(m)) / 2


def generate(spark: SparkSession, n: int, make, seed: int = 0, kind: str = "matrix", partitions: int | None = None, columns: str = "") -> DataFrame:
    """(id, cov, more columns): make(rng, id) gives a matrix, or a tuple of matrix and column values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            got = [make(np.random.default_rng([seed, int(i)]), int(i)) for i in ids]
            extra = [list(x) for x in zip(*(g[1:] for g in got))] if isinstance(got[0], tuple) else []
            x = np.stack([g[0] if isinstance(g, tuple) else g for g in got])
            names = [c.split()[0] for c in columns.split(",") if c.strip()]
            types = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in columns.split(",") if c.strip()]
            yield pa.RecordBatch.from_arrays([b.column(0), encode(x, kind), *(pa.array(v, t) for v, t in zip(extra, types))], names=["id", "cov", *names])

    from pyspark.sql.types import LongType, StructField, StructType

    fields = [StructField("id", LongType()), StructField("cov", COMPLEX if kind == "complex" else REAL)]
    if columns:
        fields += StructType.fromDDL(columns).fields
    base = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return base.mapInArrow(run, StructType(fields))


def make_matrices(spark, n, p, kind="spd", seed=0, low=0.5, high=2.0, same_vectors=False, mean=0.0, std=1.0, partitions=None):
    """n matrices of a kind."""
    vectors = None
    if same_vectors:
        vectors = one_matrix(np.random.default_rng([seed, 2**40]), p, "unit" if kind in ("hpd", "hpsd") else "orth")
    c = kind in ("comp", "cinv", "unit", "herm", "hpd", "hpsd")
    one_matrix(np.random.default_rng(0), p, kind)
    return generate(spark, n, lambda r, i: one_matrix(r, p, kind, low, high, vectors, mean, std), seed, "complex" if c else "matrix", partitions)


def make_masks(n, p, least, seed=0):
    """n semi-orthogonal p x m masks with least <= m < p."""
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.normal(size=(p, int(rng.integers(least, p)))))[0] for _ in range(n)]


def _log_density(r, sigma):
    d = np.abs(r[:, None] - r[None])[np.triu_indices(len(r), 1)] / 2
    return -(r @ r) / (2 * sigma**2) + np.log(np.maximum(np.sinh(d), 1e-300)).sum()


def sample_eigen(rng, p, sigma, burn=20, sweeps=5):
    """Log eigenvalues of a Riemannian Gaussian by slice sampling; a real chain for each row."""
    r = rng.normal(0, sigma, p)
    for _ in range(burn + sweeps):
        for i in range(p):
            x = r.copy()
            level = _log_density(r, sigma) + np.log(rng.uniform())
            width = 2 * sigma
            lo = r[i] - width * rng.uniform()
            hi = lo + width

            def dens(v, x=x, i=i):
                x[i] = v
                return _log_density(x, sigma)

            while dens(lo) > level:
                lo -= width
            while dens(hi) > level:
                hi += width
            while True:
                v = rng.uniform(lo, hi)
                if dens(v) > level:
                    r[i] = v
                    break
                lo, hi = (v, hi) if v < r[i] else (lo, v)
    return r


def one_gaussian(rng, mean, sigma, complex_=False):
    p = len(mean)
    if np.ndim(sigma) == 0:
        u = one_matrix(rng, p, "unit" if complex_ else "orth")
        c = (u * np.exp(sample_eigen(rng, p, sigma / np.sqrt(p)))) @ ct(u)
        m = sqrtm(mean)
        c = m @ c @ ct(m)
        return (c + ct(c)) / 2
    v = rng.multivariate_normal(np.zeros(len(sigma)), sigma)
    return G.untangent_space(v, mean, "riemann")


def sample_gaussian(spark, n, mean, sigma, seed=0, partitions=None):
    """n matrices: sigma a number gives the isotropic Riemannian Gaussian, a covariance of tangent vectors the wrapped one (real)."""
    c = np.iscomplexobj(mean)
    if np.ndim(sigma) == 0 and sigma <= 0:
        raise ValueError("sigma must be positive")
    return generate(spark, n, lambda r, i: one_gaussian(r, mean, sigma, c), seed, "complex" if c else "matrix", partitions)


sample_gaussian_spd = sample_gaussian


def wrapped_samples(spark, n, means, covs, weights, metric, seed=0):
    def make(rng, i):
        k = int(rng.choice(len(weights), p=weights / weights.sum()))
        return G.untangent_space(rng.multivariate_normal(np.zeros(len(covs[k])), covs[k]), means[k], metric), k

    return generate(spark, n, make, seed, columns="component int")


def make_gaussian_blobs(spark, n=100, p=2, class_sep=1.0, class_disp=1.0, seed=0, centers=None):
    """Two classes (column y) of n matrices each, class_sep * class_disp apart."""
    if centers is None:
        rng = np.random.default_rng([seed, 2**41])
        a = one_gaussian(rng, np.eye(p), 1.0)
        t = rng.normal(size=p * (p + 1) // 2)
        t *= class_sep * class_disp / np.linalg.norm(t)
        centers = np.stack([a, G.untangent_space(t, a, "riemann")])
    return generate(spark, 2 * n, lambda r, i: (one_gaussian(r, centers[int(i >= n)], class_disp), int(i >= n)), seed, columns="y int")


def make_outliers(spark, n, mean, sigma, outlier_coeff=10, seed=0):
    """Matrices outlier_coeff * sigma away from the mean, in random directions."""

    def make(rng, i):
        p = len(mean)
        m = one_matrix(rng, p, "spd")
        a = G.tangent_space(m, np.eye(p))
        a *= outlier_coeff * sigma / np.linalg.norm(a) / np.sqrt(p) * np.sqrt(p)
        r = sqrtm(mean)
        return r @ G.untangent_space(a, np.eye(p)) @ r

    return generate(spark, n, make, seed)


def make_classification_transfer(spark, n, class_sep=3.0, class_disp=1.0, domain_sep=5.0, theta=0.0, stretch=1.0, seed=0, class_names=(1, 2), domain_names=("source_domain", "target_domain")):
    """2x2 matrices of two classes in a source and a target domain that is moved, rotated and stretched; 4n rows with y and domain."""
    rng = np.random.default_rng([seed, 2**42])
    t = rng.normal(size=3)
    t *= class_sep / np.linalg.norm(t)
    far = G.untangent_space(t, np.eye(2), "riemann")
    centre = G.geodesic(np.eye(2), far, 0.5)
    w = np.linalg.inv(sqrtm(centre))
    centers = [w @ np.eye(2) @ w, w @ far @ w]
    d = np.array([np.cos(np.pi / 4), np.sin(np.pi / 4)])
    move = sqrtm((np.outer(d, d) * (np.exp(domain_sep) - 1)) + np.eye(2)) if domain_sep else np.eye(2)
    q = np.array([[np.cos(theta), -np.sin(theta)], [np.sin(theta), np.cos(theta)]])

    def make(rng, i):
        target, k = divmod(i // n, 2)
        m = one_gaussian(rng, centers[k], class_disp)
        if target:
            m = powm(m, stretch)
            m = move @ q @ m @ q.T @ move
        return (m + m.T) / 2, str(class_names[k]), domain_names[target]

    return generate(spark, 4 * n, make, seed, columns="y string, domain string")


def random_over_sample(df: DataFrame, y: str = "y", sampling_strategy="auto", metric: str = "riemann", seed: int = 0, col: str = "cov", id_: str = "id") -> DataFrame:
    """df and new rows that bring classes to the largest one's size, each on the geodesic between two random rows of its class.

    sampling_strategy: auto or "not majority", minority, "not minority", all, or {label: rows}.  New ids follow the largest id.
    """
    from tesserae.functions import geodesic
    from tesserae.operators.order import numbered

    df = df.where(F.col(y).isNotNull() & F.col(col).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    top, low = max(counts.values()), min(counts.values())
    if isinstance(sampling_strategy, dict):
        want = {k: sampling_strategy.get(k, n) for k, n in counts.items()}
    else:
        pick = {"auto": lambda n: n < top, "not majority": lambda n: n < top, "minority": lambda n: n == low, "not minority": lambda n: n > low, "all": lambda n: True}
        if sampling_strategy not in pick:
            raise ValueError(f"unknown strategy {sampling_strategy!r}")
        want = {k: top if pick[sampling_strategy](n) else n for k, n in counts.items()}
    need = {k: want[k] - n for k, n in counts.items() if want[k] > n}
    if not need:
        return df.select(id_, col, y)
    ranked = numbered(df.select(F.col(y).alias("__y"), F.col(col).alias("__m"), F.col(id_).alias("__i")), ["__y"], F.floor(F.col("__i") / 10_000), ["__i"], "__r").withColumn("__r", F.col("__r").cast("int")).drop("__i")
    spark = df.sparkSession
    base = df.agg(F.max(id_)).first()[0] + 1
    starts = dict(zip(need, np.r_[base, base + np.cumsum(list(need.values()))].tolist()))
    plan = spark.createDataFrame([(k, n, counts[k], starts[k]) for k, n in need.items()], f"__y {df.schema[y].dataType.simpleString()}, n int, size int, start long")
    new = plan.select("__y", "size", "start", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))

    def draw(salt):
        return F.pmod(F.xxhash64("__y", "k", F.lit(seed), F.lit(salt)), F.col("size")).cast("int")

    alpha = F.pmod(F.xxhash64("__y", "k", F.lit(seed), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    new = new.select("__y", "k", "start", draw(1).alias("a"), draw(2).alias("b"), alpha.alias("alpha"))
    one = ranked.select("__y", F.col("__r").alias("a"), F.col("__m").alias("ma"))
    two = ranked.select("__y", F.col("__r").alias("b"), F.col("__m").alias("mb"))
    made = geodesic(new.join(one, ["__y", "a"]).join(two, ["__y", "b"]), "ma", "mb", "alpha", metric, "__new")
    ids = F.col("start") + F.col("k") - 1
    return df.select(id_, col, y).unionByName(made.select(ids.cast(df.schema[id_].dataType).alias(id_), F.col("__new").alias(col), F.col("__y").alias(y)))
