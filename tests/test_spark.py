"""Operators on DataFrames against local numpy, DuckDB, and themselves under other partitionings."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import columns as X
from tesserae import functions as fn
from tesserae.frames import decode, from_numpy, to_numpy
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels import mean as M
from tesserae.ml import artifacts, classification, clustering, embedding, filters, tangent
from tesserae.operators import means, pairs, stats, transfer
from tesserae.plans import sql_queries
from tesserae.sources import synthetic, tables

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(7)


def spd(n, p):
    return np.stack([synthetic.one_matrix(rng, p, "spd") for _ in range(n)])


@pytest.fixture(scope="module")
def data(spark):
    x = spd(40, 3)
    return x, from_numpy(spark, x, y=(np.arange(40) % 2), w=np.linspace(1, 2, 40)).repartition(5).persist()


@pytest.mark.parametrize("metric", ["euclid", "harmonic", "logeuclid", "chol", "logchol", "kullback_sym", "riemann", "logdet", "wasserstein", "power", "poweuclid"])
def test_means_match_local_ones(data, metric):
    x, df = data
    p = 0.5 if metric.startswith("pow") else None
    w = np.linspace(1, 2, 40)
    assert np.allclose(means.mean(df, metric, weight="w", p=p), M.mean(x, metric, w, p)[0], atol=1e-8)
    got = means.group_means(df, metric, by="y", p=p)
    for k in (0, 1):
        assert np.allclose(got[str(k)].matrix, M.mean(x[k::2], metric, p=p)[0], atol=1e-8)
    if metric in ("euclid", "riemann"):
        one = means.mean(df.repartition(1), metric)
        assert np.allclose(one, means.mean(df.repartition(40), metric), atol=1e-9)


def test_whole_set_means_and_order(data):
    x, df = data
    assert np.allclose(means.mean(df, "thompson", order="id"), M.mean(x, "thompson")[0])
    with pytest.raises(ValueError):
        means.mean(df, "thompson")
    with pytest.raises(ValueError):
        means.mean(df.where("id < 0"))
    assert np.allclose(means.mean(df, "ale"), M.mean(x, "ale")[0], atol=1e-6)
    with pytest.raises(Exception, match="factorial"):
        means.mean(df, "alm")


def test_median_and_gaps(data, spark):
    x, df = data
    for m in ("euclid", "riemann"):
        assert np.allclose(means.median(df, m).matrix, M.median(x, m)[0], atol=1e-6)
    y = x.copy()
    y[::3, 1], y[::3, :, 1] = np.nan, np.nan
    assert np.allclose(means.maskedmean_riemann(from_numpy(spark, y)).matrix, M.nanmean_riemann(y)[0], atol=1e-5)


def test_row_functions_pass_nulls(data, spark):
    x, df = data
    with_null = df.select("id", F.when(F.col("id") % 7 != 0, F.col("cov")).alias("cov"))
    out = fn.matrix_function(with_null, "logm").orderBy("id").collect()
    assert all((r["out"] is None) == (r["id"] % 7 == 0) for r in out)
    assert np.allclose(np.array(out[1]["out"]).reshape(3, 3), fn.SPECTRAL["logm"](x[1:2])[0])
    assert fn.matrix_function(df.where("id < 0"), "sqrtm").count() == 0
    bad = from_numpy(spark, np.stack([np.eye(2), -np.eye(2)]))
    assert fn.validate(bad, mode="drop").count() == 1
    assert fn.predicate(fn.validate(bad, mode="repair"), "spd").where("out").count() == 2
    with pytest.raises(Exception):
        fn.validate(bad).count()


@pytest.mark.parametrize("metric", list(X.DISTANCE2))
def test_closed_forms(spark, metric):
    a, b = spd(30, 2), spd(1, 2)[0]
    df = from_numpy(spark, a)
    fast = to_numpy_col(fn.distance(df, "cov", b, metric, order=2).orderBy("id"), "distance")
    assert np.allclose(fast, D.distance(a, b[None], metric), atol=1e-7)


def to_numpy_col(df, c):
    return np.array([r[0] for r in df.select(c).collect()])


def test_pairs(data, monkeypatch):
    x, df = data
    ids = list(range(40))
    full = pairs.dense(pairs.pairwise_distance(df), ids)
    assert np.allclose(full, D.pairwise(x))
    k = pairs.dense(pairs.kernel(df, metric="logeuclid"), ids, "k", False)
    assert np.allclose(k, G.kernel(x, metric="logeuclid"))
    near = pairs.nearest(df, df, 3, skip_self=True).orderBy("i", "rank").collect()
    assert [r["j"] for r in near[:3]] == list(np.argsort(full[0])[1:4])
    monkeypatch.setattr(pairs, "BROADCAST_MB", 0)  # beyond the bound: by blocks
    monkeypatch.setattr(pairs, "BLOCK", 16)
    assert np.allclose(pairs.dense(pairs.pairwise_distance(df), ids), full)


@pytest.mark.parametrize("name", sorted(sql_queries.QUERIES))
def test_sql_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sql_queries.SQL[name]).df()
    got = sql_queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    key = [c for c in want.columns if want[c].dtype.kind not in "f"] or list(want.columns)
    a, b = (d.sort_values(key).reset_index(drop=True) for d in (want, got))
    for c in want.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c].astype(float), atol=2e-6)
        else:
            assert (a[c] == b[c]).all()


@pytest.fixture(scope="module")
def blobs(spark):
    d = synthetic.make_gaussian_blobs(spark, 25, 2, class_sep=6.0, class_disp=0.3, seed=5)
    return from_numpy(spark, to_numpy(d, order="id"), y=np.array([r[0] for r in d.orderBy("id").select("y").collect()])).persist()


@pytest.mark.parametrize(
    "make",
    [classification.MDM, classification.FgMDM, classification.TSClassifier, classification.KNearestNeighbor, classification.SVC, classification.MeanField, classification.NearestConvexHull],
)
def test_classifiers_separate_blobs(blobs, make):
    m = make().fit(blobs)
    assert m.score(blobs) > 0.95
    assert m.predict(blobs).count() == 50


def test_regressors(blobs):
    for m in (classification.KNearestNeighborRegressor(3), classification.SVR(C=10.0)):
        assert m.fit(blobs).score(blobs) > 0.7


def test_simplex_qp():
    q = rng.normal(size=(5, 3))
    inside = np.array([0.1, 0.2, 0.3, 0.2, 0.2]) @ q
    w = classification.simplex_qp(q @ q.T, (inside @ q.T)[None], 20000, 1e-14)
    assert np.allclose(w.sum(), 1) and (w >= 0).all() and np.allclose(w @ q, inside, atol=1e-3)


def test_tangent_space_round_trip(data):
    x, df = data
    ts = tangent.TangentSpace().fit(df)
    back = ts.inverse_transform(ts.transform(df).drop("cov"))
    assert np.allclose(to_numpy(back, order="id"), x)


def test_whitening(data):
    x, df = data
    w = tangent.Whitening("riemann").fit(df)
    assert np.allclose(means.mean(w.transform(df)), np.eye(3), atol=1e-6)
    assert np.allclose(to_numpy(w.inverse_transform(w.transform(df)), order="id"), x)
    half = tangent.Whitening("euclid").fit(df.where("id < 20")).partial_fit(df.where("id >= 20"))
    assert np.allclose(half.mean_, x.mean(0))
    assert tangent.Whitening(dim_red={"n_components": 2}).fit(df).filters_.shape == (3, 2)
    with pytest.raises(ValueError):
        tangent.Whitening(dim_red={"max_cond": 0.5}).fit(df)


def test_potato_finds_outliers(spark):
    good, bad = spd(60, 2), 50 * spd(3, 2)
    df = from_numpy(spark, np.concatenate([good, bad]))
    p = artifacts.Potato(threshold=3).fit(df)
    out = p.predict(df).orderBy("id").toPandas()
    assert (out.prediction[60:] == 0).all() and out.prediction[:60].mean() > 0.9
    before = p.mean_.copy()
    p.partial_fit(df.where("id < 5"), alpha=0.5)
    assert not np.allclose(before, p.mean_)
    f = artifacts.PotatoField(2).fit(df.withColumn("b", F.col("cov")), ["cov", "b"])
    assert f.predict(df.withColumn("b", F.col("cov")), ["cov", "b"]).where("id >= 60 and prediction = 1").count() == 0
    for how in artifacts.COMBINE:
        f.method_combination = how
        assert f.predict_proba(df.withColumn("b", F.col("cov")), ["cov", "b"]).where("p between 0 and 1").count() == 63


def test_clustering(blobs):
    k = clustering.Kmeans(2, n_init=3).fit(blobs).predict(blobs)
    t = k.groupBy("y", "prediction").count().collect()
    assert len(t) == 2
    g = clustering.GaussianMixture(2, maxiter=20, random_state=1).fit(blobs)
    assert np.isclose(g.weights_.sum(), 1) and np.isfinite(g.score(blobs))
    assert g.predict_proba(blobs).count() == 50
    assert len(clustering.MeanShift(bandwidth=2.0).fit(blobs).modes_) >= 1
    assert len(clustering.KmeansPerClassTransform(2, n_init=1).fit(blobs).covmeans_) == 4


def test_embeddings(blobs):
    for kind in ("Spectral", "LocallyLinear"):
        e = embedding.embed(blobs, kind).orderBy("id").toPandas()
        assert len(e) == 50 and len(e.embedding[0]) == 2
    t = embedding.TSNE(max_iter=20, metric="logeuclid").fit(blobs)
    assert t.losses_[-1] < t.losses_[0]
    w = embedding.barycenter_weights(spd(2, 2), spd(6, 2), np.array([[0, 1, 2], [3, 4, 5]]))
    assert np.allclose(w.sum(1), 1)


def test_permutations(blobs):
    p, scores = stats.PermutationDistance(30).test(blobs)
    assert p <= 2 / 30 and len(scores) == 29
    small = blobs.where("id in (0, 1, 30, 31)")
    p, scores = stats.PermutationDistance(100).test(small)
    assert len(scores) == stats.multiset_perm_number([0, 0, 1, 1]) - 1 == 5
    assert len(set(stats.unique_permutations([0, 0, 1, 1]))) == 6
    assert stats.PermutationModel(10).test(blobs)[0] <= 0.2


def test_transfer(spark):
    d = synthetic.make_classification_transfer(spark, 15, class_disp=0.3, theta=0.4, seed=3).persist()
    c = transfer.TLCenter("target_domain").fit_transform(d)
    for k, m in means.group_means(c, by="domain").items():
        assert np.allclose(m.matrix, np.eye(2), atol=1e-5), k
    s = transfer.TLScale("target_domain", centered_data=True).fit_transform(c)
    again = transfer.TLScale("target_domain", centered_data=True).fit(s)
    assert all(np.isclose(v, 1) for v in again.dispersions_.values())
    r = transfer.TLRotate("target_domain").fit(s)
    q = r.rotations_["source_domain"]
    assert np.allclose(q @ q.T, np.eye(2))
    rotated = transfer.TLRotate("target_domain").fit_transform(s)
    m = classification.MDM().fit(rotated.where("domain = 'source_domain'"))
    assert m.score(rotated.where("domain = 'target_domain'")) > 0.9
    assert transfer.MDWM(0.5, "target_domain").fit(rotated).score(rotated) > 0.9
    folds = list(transfer.TLSplitter("target_domain", 3).split(d))
    assert sum(t.count() for _, t in folds) == 30 and all(a.where("domain = 'source_domain'").count() == 30 for a, _ in folds)
    back = transfer.decode_domains(transfer.encode_domains(d).drop("y", "domain"))
    assert {r["domain"] for r in back.select("domain").distinct().collect()} == {"source_domain", "target_domain"}


def test_rotation_is_recovered():
    t = 0.7
    q = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    x = spd(6, 2)
    for metric in ("euclid", "riemann"):
        got = transfer.grassmann_rotation(x, q @ x @ q.T, metric=metric)
        assert np.allclose(got @ x @ got.T, q @ x @ q.T, atol=1e-4)


def test_filters(spark):
    x = rng.normal(size=(30, 4, 64))
    x[:15, 0] *= 4
    x[15:, 1] *= 4
    rows = [(i, int(i >= 15), [float(v) for v in e.ravel()]) for i, e in enumerate(x)]
    e = spark.createDataFrame(rows, "id long, y int, x array<double>").persist()
    covs = filters.Covariances(4).transform(e).persist()
    f = filters.CSP(2).fit(covs).transform(covs)
    assert classification_of(f) > 0.9
    assert filters.SPoC(2).fit(covs.withColumn("y", F.col("cov")[0])).transform(covs).count() == 30
    assert decode(filters.ERPCovariances(4, svd=1).fit(e).transform(e).select("cov").toArrow()["cov"]).shape == (30, 6, 6)
    xd = filters.Xdawn(4, 2).fit(e)
    assert xd.filters_.shape == (4, 4) and xd.transform(e).count() == 30
    td = filters.TimeDelayCovariances(4, 3).transform(e)
    assert decode(td.select("cov").toArrow()["cov"]).shape == (30, 12, 12)
    assert filters.FlatChannelRemover(5).fit(e.withColumn("x", F.concat("x", F.array_repeat(F.lit(1.0), 64)))).channels_.tolist() == [0, 1, 2, 3]
    assert len(filters.ElectrodeSelection(2).fit(covs, "y").subelec_) == 2
    spectra = filters.CrossSpectra(4, 32, 0.5, fs=64).transform(e.select("id", "x"))
    assert spectra.count() == 30 * 17


def classification_of(f):
    rows = f.select("y", "filtered").collect()
    a = np.array([r["filtered"] for r in rows])
    y = np.array([r["y"] for r in rows])
    side = (a[:, 0] > a[:, 0].mean()).astype(int)
    return max((side == y).mean(), (side != y).mean())


def test_generators_do_not_depend_on_partitions(spark):
    a, b = (to_numpy(synthetic.make_matrices(spark, 10, 3, "spd", seed=3, partitions=k), order="id") for k in (1, 7))
    assert np.array_equal(a, b)
    assert np.allclose(means.mean(synthetic.sample_gaussian(spark, 400, np.eye(2), 0.5, seed=2)), np.eye(2), atol=0.15)
    d = synthetic.make_gaussian_blobs(spark, 10).where("id < 13")
    up = synthetic.random_over_sample(d.select("id", "cov", "y"))
    assert {r[0]: r[1] for r in up.groupBy("y").count().collect()} == {0: 10, 1: 10}
    assert up.select("id").distinct().count() == 20


def test_streams_equal_batches(spark, tmp_path):
    from tesserae.streaming import drain, read_events, windowed_covariance

    def cov(df):
        return windowed_covariance(df, "ts", ["value"], ["event_type"], "1 day", "12 hours", "1 day")

    stream = drain(cov(read_events(spark, SF)), "w_test", "complete", str(tmp_path / "cp"))
    batch = cov(tables.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    key = ["start", "event_type"]
    a, b = (d.orderBy(*key).toPandas() for d in (stream, batch))
    assert len(a) == len(b) and np.allclose(np.stack(a["cov"]), np.stack(b["cov"]))


def test_online_models_ignore_repeated_batches(data):
    from tesserae.streaming import OnlinePotato, OnlineWhitening

    _, df = data
    p = OnlinePotato(artifacts.Potato().fit(df), "id")
    p(df, 0)
    n = len(p.scores)
    p(df, 0)
    assert n == len(p.scores) == 40
    w = OnlineWhitening(tangent.Whitening("euclid"), "id")
    w(df.where("id < 20"), 0)
    w(df.where("id >= 20"), 1)
    assert np.allclose(w.model.mean_, to_numpy(df).mean(0))


def test_plans(spark):
    """Filters and columns reach the scan; k distances take one Arrow stage."""
    d = tables.part_cov(spark, SF)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" in plan and "l_comment" not in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_discount:double>" in plan
    text = fn.distances(d, np.stack([np.eye(2)] * 3))._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1
    assert "MapInArrow" not in fn.distance(d, "cov", np.eye(2), order=2)._jdf.queryExecution().executedPlan().toString()


def test_sources(spark, tmp_path):
    x = spd(4, 2)
    np.save(tmp_path / "a.npy", x)
    assert np.allclose(to_numpy(tables.read_npy(spark, str(tmp_path / "a.npy")), order="id"), x)
    e = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id long, x array<double>")
    long = tables.epochs_to_long(e, 2)
    assert tables.long_to_epochs(long, ["c0", "c1"], "id", "t").first()["x"] == [1.0, 2.0, 3.0, 4.0]
