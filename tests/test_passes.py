"""Fits over many rows: all partitions at once, and what makes the matrices once."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.frames import from_numpy
from tesserae.kernels import mean as M
from tesserae.ml import clustering, filters
from tesserae.operators.means import maskedmean_riemann

rng = np.random.default_rng(5)


def spd(n, p):
    a = rng.normal(size=(n, p, p))
    return a @ np.swapaxes(a, 1, 2) + np.eye(p)


def jobs(spark, f):
    """Jobs that f runs."""
    group = f"g{rng.integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, "")
    f()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_masked_mean_takes_all_partitions_in_a_job(spark):
    x = spd(60, 4)
    x[::3, 1], x[::3, :, 1] = np.nan, np.nan
    df = from_numpy(spark, x).repartition(12)
    got = []
    assert jobs(spark, lambda: got.append(maskedmean_riemann(df, tol=1e-6, maxiter=3))) <= 12  # 12 for each pass before
    assert np.allclose(maskedmean_riemann(df).matrix, M.nanmean_riemann(x)[0], atol=1e-5)


def counted(spark, n=40):
    """A matrix set that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def f(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = from_numpy(spark, spd(n, 2), y=np.arange(n) % 4, target=rng.normal(size=n))
    return df.mapInArrow(f, df.schema), made


def test_spoc_makes_its_matrices_once(spark):
    df, made = counted(spark)
    filters.SPoC(2).fit(df, "target")
    assert made.value == 40


def test_kmeans_per_class_makes_its_matrices_once(spark):
    df, made = counted(spark)
    m = clustering.KmeansPerClassTransform(2, max_iter=3, n_init=1, metric="logeuclid").fit(df)
    assert made.value == 40 and m.covmeans_.shape == (8, 2, 2)
    assert m.transform(df.where(F.col("id") < 5)).count() == 5
