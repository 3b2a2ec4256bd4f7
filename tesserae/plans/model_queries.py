"""Queries of iterative, stateful or randomised operators, which SQL can't express; tests/ compares them with brute force or properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae import functions as fn
from tesserae.frames import apply
from tesserae.kernels import geometry as G
from tesserae.kernels.ajd import ajd
from tesserae.ml import artifacts, classification, clustering, embedding, filters, tangent
from tesserae.operators import stats, transfer
from tesserae.operators.means import group_means, maskedmean_riemann, mean, mean_frame, median
from tesserae.operators.pairs import pairwise_distance
from tesserae.sources import synthetic
from tesserae.sources import tables as S
from tesserae.plans.closed_queries import domains, with_gaps
from tesserae.shared import shared_folder
from tesserae.streaming import OnlinePotato, OnlineWhitening, drain, keyed_means, read_events, read_table, stream_name

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def named(name):
    def put(f):
        f.__name__ = name
        return query(f)

    return put


def _matrices(spark, named_matrices: dict):
    rows = [(str(k), [float(v) for v in np.real(np.ravel(m))]) for k, m in named_matrices.items()]
    return spark.createDataFrame(rows, "key string, matrix array<double>")


for _metric, _p in (("riemann", None), ("power", 0.5), ("logdet", None), ("wasserstein", None), ("ale", None)):

    def _run(spark, sf, metric=_metric, p=_p):
        return mean_frame(S.part_labels(spark, sf), metric, by="y", p=p)

    named(f"mean_{_metric}")(_run)


def _regions(spark, sf):
    """One matrix for each region, as a set of five."""
    s, n = S.table(spark, sf, "supplier"), S.table(spark, sf, "nation")
    lines = S.table(spark, sf, "lineitem").join(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return S.covariance_by(lines, "n_regionkey", S.CHANNELS[:2])


for _metric in ("alm", "bmp", "cheap", "thompson"):

    def _run(spark, sf, metric=_metric):
        d = _regions(spark, sf)
        return mean_frame(d, metric, order="id" if metric == "thompson" else None)

    named(f"mean_{_metric}")(_run)


@query
def median_euclid(spark, sf):
    return _matrices(spark, {"median": median(S.part_cov(spark, sf), "euclid").matrix})


@query
def median_riemann(spark, sf):
    return _matrices(spark, {"median": median(S.part_cov(spark, sf), "riemann").matrix})


@query
def nanmean_riemann(spark, sf):
    return _matrices(spark, {"mean": maskedmean_riemann(with_gaps(spark, sf), tol=1e-5, maxiter=15).matrix})


@query
def maskedmean(spark, sf):
    d = fn.nan_masks(with_gaps(spark, sf))
    return _matrices(spark, {"mean": maskedmean_riemann(d, keep="keep", tol=1e-5, maxiter=15).matrix})


@query
def tangent_space_riemann(spark, sf):
    d = S.part_cov(spark, sf, 4).select("id", "cov")
    ts = tangent.TangentSpace().fit(d)
    return ts.inverse_transform(ts.transform(d).drop("cov")).select("id", "tangent", "cov")


for _est in ("hub", "stu", "tyl", "mcd"):

    def _run(spark, sf, est=_est):
        e = S.embedding_epochs(spark, sf).select("id", F.slice("x", 1, 32).alias("x"))
        return fn.covariances(e, 2, est)

    named(f"cov_{_est}")(_run)


@query
def erp_covariances(spark, sf):
    e = S.embedding_epochs(spark, sf)
    return filters.ERPCovariances(8, estimator="lwf", svd=1).fit(e).transform(e).select("id", "cov")


@query
def xdawn(spark, sf):
    e = S.embedding_epochs(spark, sf)
    return filters.Xdawn(8, 2).fit(e).transform(e).select("id", "x")


@query
def xdawn_covariances(spark, sf):
    e = S.embedding_epochs(spark, sf)
    return filters.XdawnCovariances(8, 1, estimator="lwf").fit(e).transform(e).select("id", "cov")


@query
def block_covariances(spark, sf):
    return filters.BlockCovariances(8, [4, 4], "lwf").transform(S.embedding_epochs(spark, sf)).select("id", "cov")


def _epoch_covs(spark, sf):
    e = S.embedding_epochs(spark, sf)
    return filters.Covariances(8, "lwf").transform(e)


@query
def joint_diagonalisation(spark, sf):
    got = group_means(_epoch_covs(spark, sf), "euclid", by="y")
    x = np.stack([got[k].matrix for k in sorted(got)])
    return _matrices(spark, {m: ajd(x, m)[0] for m in ("ajd_pham", "rjd", "uwedge")})


@query
def csp(spark, sf):
    d = _epoch_covs(spark, sf)
    return filters.CSP(4).fit(d).transform(d).select("id", "filtered")


@query
def spoc(spark, sf):
    d = S.part_labels(spark, sf, 4)
    return filters.SPoC(2).fit(d, "target").transform(d).select("id", "filtered")


@query
def ajdc(spark, sf):
    e = S.embedding_epochs(spark, sf).withColumn("subject", F.col("id") % 3).withColumn("condition", F.col("y"))
    m = filters.AJDC(4, 8, 0.5, fs=64).fit(e)
    return m.inverse_transform(m.transform(e.select("id", "x")), [0])


@query
def whitening(spark, sf):
    d = S.part_cov(spark, sf, 4)
    w = tangent.Whitening("riemann", {"expl_var": 0.99}).fit(d.where("id % 2 = 0"))
    return w.partial_fit(d.where("id % 2 = 1")).transform(d).select("id", "cov")


@query
def fgda(spark, sf):
    d = S.part_labels(spark, sf)
    return tangent.FGDA().fit(d).transform(d).select("id", "cov")


def _classified(name, make):
    def run(spark, sf):
        d = _epoch_covs(spark, sf).select("id", "y", "cov")
        return make().fit(d).predict(d).select("id", "y", "prediction")

    named(name)(run)


_classified("mdm_riemann", lambda: classification.MDM())
_classified("fgmdm", lambda: classification.FgMDM())
_classified("ts_classifier", lambda: classification.TSClassifier("logeuclid"))
_classified("mean_field", lambda: classification.MeanField((-1, 0, 1)))
_classified("nearest_convex_hull", lambda: classification.NearestConvexHull())
_classified("svc", lambda: classification.SVC("logeuclid"))
_classified("knn_riemann", lambda: classification.KNearestNeighbor(5))


@query
def svr(spark, sf):
    d = S.supplier_cov(spark, sf)
    d = d.withColumn("target", F.col("target") / 1000)
    return classification.SVR("logeuclid").fit(d, "target").predict(d).select("id", "prediction")


@query
def potato(spark, sf):
    d = S.part_cov(spark, sf)
    m = artifacts.Potato(threshold=2).fit(d)
    return m.predict_proba(m.predict(d)).select("id", "z", "prediction", "p")


@query
def potato_field(spark, sf):
    d = S.part_cov(spark, sf, 4)
    two = d.select("id", F.array(*(F.col("cov")[k] for k in (0, 1, 4, 5))).alias("a"), F.array(*(F.col("cov")[k] for k in (10, 11, 14, 15))).alias("b"))
    return artifacts.PotatoField(2).fit(two, ["a", "b"]).predict(two, ["a", "b"]).select("id", "p", "prediction")


@query
def electrode_selection(spark, sf):
    d = _epoch_covs(spark, sf)
    return filters.ElectrodeSelection(4).fit(d, "y").transform(d).select("id", "cov")


@query
def flat_channel_remover(spark, sf):
    e = S.embedding_epochs(spark, sf).withColumn("x", F.concat("x", F.array_repeat(F.lit(1.0), 8)))
    return filters.FlatChannelRemover(9).fit(e).transform(e).select("id", "x")


@query
def kmeans(spark, sf):
    d = S.part_cov(spark, sf).select("id", "cov")
    return clustering.Kmeans(3, max_iter=10, n_init=1, metric="logeuclid").fit(d).predict(d).select("id", "prediction")


@query
def kmeans_per_class(spark, sf):
    d = S.supplier_cov(spark, sf).select("id", "cov", F.col("domain").alias("y"))
    return clustering.KmeansPerClassTransform(2, max_iter=5, n_init=1, metric="logeuclid").fit(d).transform(d).select("id", "distances")


@query
def mean_shift(spark, sf):
    d = S.supplier_cov(spark, sf)
    return clustering.MeanShift(metric="logeuclid").fit(d).predict(d).select("id", "prediction")


@query
def gaussian_mixture(spark, sf):
    d = S.part_cov(spark, sf)
    m = clustering.GaussianMixture(2, maxiter=10, metric="logeuclid").fit(d)
    return m.predict_proba(m.predict(d)).select("id", "prediction", "probabilities")


@query
def spectral_embedding(spark, sf):
    return embedding.SpectralEmbedding().fit_transform(S.supplier_cov(spark, sf))


@query
def locally_linear_embedding(spark, sf):
    return embedding.LocallyLinearEmbedding(2, 5).fit_transform(S.supplier_cov(spark, sf))


@query
def tsne(spark, sf):
    return embedding.TSNE(2, metric="logeuclid", max_iter=30).fit_transform(S.supplier_cov(spark, sf))


def _p(spark, name, p, scores):
    return spark.createDataFrame([(name, float(p), len(scores))], "test string, p double, n int")


for _mode in ("pairwise", "ttest", "ftest"):

    def _run(spark, sf, mode=_mode):
        d = S.supplier_cov(spark, sf)
        if mode == "ttest":
            d = d.withColumn("domain", F.when(F.col("domain") == "ASIA", "ASIA").otherwise("other"))
        return _p(spark, mode, *stats.PermutationDistance(50, "logeuclid", mode).test(d, "domain"))

    named(f"permutation_{_mode}")(_run)


@query
def permutation_model(spark, sf):
    return _p(spark, "model", *stats.PermutationModel(20, metric="logeuclid").test(S.supplier_cov(spark, sf), "domain"))


@query
def tlcenter(spark, sf):
    return transfer.TLCenter("big").fit_transform(domains(spark, sf)).select("id", "domain", "cov")


@query
def tlscale(spark, sf):
    return transfer.TLScale("big").fit_transform(domains(spark, sf)).select("id", "domain", "cov")


@query
def tlrotate(spark, sf):
    d = transfer.TLCenter("big").fit_transform(domains(spark, sf))
    return transfer.TLRotate("big").fit_transform(d).select("id", "domain", "cov")


@query
def tlrotate_vectors(spark, sf):
    d = tangent.TangentSpace("logeuclid").fit_transform(domains(spark, sf))
    return transfer.TLRotate("big", vectors=True).fit_transform(d, col="tangent").select("id", "tangent")


@query
def tl_classifier(spark, sf):
    d = domains(spark, sf)
    m = transfer.TLClassifier("big", classification.MDM("logeuclid"), {"big": 1.0, "small": 0.5})
    return m.fit(d).predict(d).select("id", "prediction")


@query
def tl_regressor(spark, sf):
    d = S.supplier_cov(spark, sf)
    return transfer.TLRegressor("ASIA", classification.KNearestNeighborRegressor(5, "logeuclid")).fit(d, "target").predict(d).select("id", "prediction")


@query
def mdwm(spark, sf):
    d = domains(spark, sf)
    return transfer.MDWM(0.5, "big").fit(d).predict(d).select("id", "prediction")


@query
def sample_gaussian(spark, sf):
    return synthetic.sample_gaussian(spark, 200, np.eye(2), 0.7, seed=1, partitions=4)


@query
def make_matrices(spark, sf):
    sets = [synthetic.make_matrices(spark, 20, 3, k, partitions=2).withColumn("kind", F.lit(k)) for k in ("real", "inv", "orth", "sym", "spd", "spsd")]
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


@query
def make_complex_matrices(spark, sf):
    return synthetic.make_matrices(spark, 50, 3, "hpd", partitions=2)


@query
def make_gaussian_blobs(spark, sf):
    return synthetic.make_gaussian_blobs(spark, 50, seed=2)


@query
def make_outliers(spark, sf):
    return synthetic.make_outliers(spark, 20, np.eye(2), 0.5, seed=3)


@query
def make_classification_transfer(spark, sf):
    return synthetic.make_classification_transfer(spark, 25, theta=0.3, stretch=1.2, seed=4)


@query
def stream_online_mean(spark, sf):
    e = read_events(spark, sf)
    rows = e.select("event_type", "event_id", F.array(1 + F.abs("value"), F.lit(0.1), F.lit(0.1), 1 + (F.col("user_id") % 7).cast("double")).alias("cov"))
    return drain(keyed_means(rows, "event_type", "event_id"), stream_name("means"), "update")


def _order_stream(spark, sf):
    """Orders as a stream of 2x2 matrices."""
    o = read_table(spark, sf, "orders")
    x, y = F.col("o_totalprice") / 1e5 + 0.1, F.col("o_custkey") % 7 + 1.0
    return o.select(F.col("o_orderkey").alias("id"), F.array(x + 1, F.lit(0.1), F.lit(0.1), y).alias("cov"), F.array(y, F.lit(0.2), F.lit(0.2), x + 2).alias("other"))


@query
def stream_online_potato(spark, sf):
    d = _order_stream(spark, sf).where("id % 40 = 0")
    still = S.table(spark, sf, "orders").where("o_orderkey % 40 = 1")
    x, y = F.col("o_totalprice") / 1e5 + 0.1, F.col("o_custkey") % 7 + 1.0
    fitted = artifacts.Potato(threshold=3).fit(still.select(F.array(x + 1, F.lit(0.1), F.lit(0.1), y).alias("cov")))
    folder = f"{shared_folder(spark)}/{stream_name('potato')}"
    OnlinePotato(fitted, "id", folder=folder).run(d)
    return spark.read.parquet(f"{folder}/out").select("at", F.col("z")[0].alias("z"))


@query
def stream_online_potato_field(spark, sf):
    d = _order_stream(spark, sf).where("id % 40 = 0")
    still = S.table(spark, sf, "orders").where("o_orderkey % 40 = 1")
    x, y = F.col("o_totalprice") / 1e5 + 0.1, F.col("o_custkey") % 7 + 1.0
    two = still.select(F.array(x + 1, F.lit(0.1), F.lit(0.1), y).alias("cov"), F.array(y, F.lit(0.2), F.lit(0.2), x + 2).alias("other"))
    folder = f"{shared_folder(spark)}/{stream_name('field')}"
    OnlinePotato(artifacts.PotatoField(2).fit(two, ["cov", "other"]), "id", ["cov", "other"], folder=folder).run(d)
    return spark.read.parquet(f"{folder}/out").select("at", "z")


@query
def stream_online_whitening(spark, sf):
    folder = f"{shared_folder(spark)}/{stream_name('whitening')}"
    OnlineWhitening(tangent.Whitening("riemann"), "id", folder=folder).run(_order_stream(spark, sf).where("id % 10 = 0").select("id", "cov"))
    return spark.read.parquet(f"{folder}/out").select("id", "cov")
