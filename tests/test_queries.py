"""The registered queries: against DuckDB where they have SQL, else against definitions written out in numpy."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.frames import decode, from_numpy
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.kernels import mean as M
from tesserae.ml import artifacts, classification, clustering, composite, selection, tangent
from tesserae.operators import means, pairs, stats
from tesserae.operators.means import maskedmean_riemann
from tesserae.operators.order import numbered
from tesserae.plans import closed_queries, model_queries, sql_queries
from tesserae.shared import shared_folder
from tesserae.sources import tables as S
from tesserae.streaming import OnlinePotato, OnlineWhitening, read_table, stream_name, windowed_covariance

SF = "/root/testdata/sf0.001"


def same_rows(spark, name, module, sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want, got = con.execute(module.SQL[name]).df(), module.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    key = [c for c in want.columns if want[c].dtype.kind not in "f"] or list(want.columns)
    a, b = (d.sort_values(key).reset_index(drop=True) for d in (want, got))
    for c in want.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
    return want


@pytest.mark.parametrize("name", sorted(closed_queries.QUERIES))
def test_closed_queries_match_duckdb(spark, name):
    same_rows(spark, name, closed_queries, SF)


def test_permanova_where_nations_repeat(spark):
    assert np.isfinite(same_rows(spark, "permanova_f", sql_queries, "/root/testdata/sf0.01").f[0])


# model queries


def run(spark, name):
    return model_queries.QUERIES[name](spark, SF).toPandas()


def mats(col):
    x = np.stack([np.asarray(v, float) for v in col])
    p = round(x.shape[1] ** 0.5)
    return x.reshape(-1, p, p)


def root(x, f=np.sqrt):
    w, v = np.linalg.eigh(x)
    return v @ np.diag(f(w)) @ v.T


@pytest.fixture(scope="module")
def brands(spark):
    d = S.part_labels(spark, SF).toPandas()
    return {k: mats(g["cov"]) for k, g in d.groupby("y")}


def log_at(m, x):
    s = root(m, lambda w: 1 / np.sqrt(w))
    return np.stack([root(s @ a @ s, np.log) for a in x])


GRADIENTS = {  # what is zero at the mean
    "mean_riemann": lambda m, x: log_at(m, x).mean(0),
    "mean_ale": lambda m, x: log_at(m, x).mean(0) / 10,
    "mean_logdet": lambda m, x: np.mean([np.linalg.inv((a + m) / 2) for a in x], 0) @ m - np.eye(2),
    "mean_wasserstein": lambda m, x: np.mean([root(root(m) @ a @ root(m)) for a in x], 0) / np.trace(m) - m / np.trace(m),
    "mean_power": lambda m, x: np.mean([root(m) @ root(root(m, lambda w: 1 / np.sqrt(w)) @ a @ root(m, lambda w: 1 / np.sqrt(w))) @ root(m) for a in x], 0) / np.trace(m) - m / np.trace(m),
}


@pytest.mark.parametrize("name", sorted(GRADIENTS))
def test_iterative_means_by_their_equations(spark, brands, name):
    got = run(spark, name)
    assert set(got.key) == set(brands)
    for k, m in zip(got.key, mats(got["mean"])):
        assert np.abs(GRADIENTS[name](m, brands[k])).max() < 1e-3, k


@pytest.mark.parametrize("name", ["mean_alm", "mean_bmp", "mean_cheap", "mean_thompson"])
def test_means_of_regions(spark, name):
    x = mats(model_queries._regions(spark, SF).orderBy("id").toPandas()["cov"])
    m = mats(run(spark, name)["mean"])[0]
    w = np.stack([np.linalg.eigvals(np.linalg.solve(a, m)).real for a in x])
    assert w.min() > 0.5 and w.max() < 2 and len(x) == 5
    if name != "mean_thompson":  # all have the determinant of the geometric mean, and are close to it
        assert np.isclose(np.log(np.linalg.det(m)), np.log(np.linalg.det(x)).mean(), atol=1e-6) and np.abs(log_at(m, x).mean(0)).max() < 1e-3
    else:
        a = x[0]
        for k in range(2, 52):  # round and round, by ever smaller steps
            b = x[(k - 1) % 5]
            lam = np.sort(np.linalg.eigvals(np.linalg.solve(a, b)).real)
            t = 1 / k
            a = (lam[1] ** t - lam[0] ** t) / (lam[1] - lam[0]) * b + (lam[1] * lam[0] ** t - lam[0] * lam[1] ** t) / (lam[1] - lam[0]) * a
        assert np.allclose(a, m)


def test_medians(spark):
    x = mats(S.part_cov(spark, SF).toPandas()["cov"])
    m = mats(run(spark, "median_euclid")["matrix"])[0]
    d = np.linalg.norm(x - m, axis=(1, 2))
    assert np.linalg.norm(((x - m) / d[:, None, None]).mean(0)) < 0.02
    m = mats(run(spark, "median_riemann")["matrix"])[0]
    t = log_at(m, x)
    assert np.linalg.norm((t / np.linalg.norm(t, axis=(1, 2))[:, None, None]).mean(0)) < 0.02


def test_masked_means_by_brute_force(spark):
    d = closed_queries.with_gaps(spark, SF).toPandas()
    x = np.stack([np.asarray(v, float).reshape(4, 4) for v in d["cov"]])
    for name, tol in (("nanmean_riemann", 1e-2), ("maskedmean", 1e-2)):
        m = mats(run(spark, name)["matrix"])[0]
        grad = np.zeros((4, 4))
        for a in x:
            k = np.flatnonzero(~np.isnan(np.diag(a)))
            q = np.eye(4)[:, k]
            mm = m[np.ix_(k, k)]
            grad += q @ root(mm) @ log_at(mm, a[np.ix_(k, k)][None])[0] @ root(mm) @ q.T
        s = root(m, lambda w: 1 / np.sqrt(w))
        assert np.linalg.norm(s @ grad @ s / len(x)) < tol


@pytest.mark.parametrize("kind", ["hub", "stu", "tyl"])
def test_robust_covariances_by_their_equations(spark, kind):
    e = S.embedding_epochs(spark, SF).toPandas()
    got = run(spark, f"cov_{kind}").set_index("id")["cov"]
    for i, v in list(zip(e["id"], e["x"]))[:60]:
        x = np.asarray(v)[:32].reshape(2, 16)
        x = x - x.mean(1, keepdims=True)
        c = np.asarray(got[i]).reshape(2, 2)
        d = np.einsum("it,ij,jt->t", x, np.linalg.inv(c), x)
        if kind == "stu":
            fixed = (x * (2 * 2 + 5) / (5 + 2 * d)) @ x.T / 16
        elif kind == "tyl":
            fixed = (x * 2 / d) @ x.T / 16
        else:
            continue
        fixed = fixed * np.trace(c) / np.trace(fixed)
        assert np.linalg.norm(fixed - c) / np.linalg.norm(c) < 0.05


def test_minimum_determinant_covariances(spark):
    got = run(spark, "cov_mcd")
    assert len(got) == 500 and (np.linalg.eigvalsh(mats(got["cov"])) > 0).all()


def test_whitening_and_recentring(spark):
    d = closed_queries.domains(spark, SF).toPandas().set_index("id")
    got = run(spark, "tlcenter")
    for k, g in got.groupby("domain"):
        x = mats(d[d.domain == k]["cov"])
        c = M.mean(x, "riemann")[0]
        assert np.abs(log_at(c, x).mean(0)).max() < 1e-4
        assert np.allclose(log_at(np.eye(2), mats(g["cov"])).mean(0), 0, atol=1e-4)
    got = run(spark, "tlscale")
    for k, g in got.groupby("domain"):
        x, old = mats(g["cov"]), mats(d[d.domain == k]["cov"])
        c = M.mean(old, "riemann")[0]
        assert np.isclose((np.linalg.norm(log_at(c, x), axis=(1, 2)) ** 2).mean(), 1, atol=1e-3)
    w = mats(run(spark, "whitening")["cov"])
    x = mats(S.part_cov(spark, SF, 4).orderBy("id").toPandas()["cov"])
    assert w.shape[1] < 4 and len(w) == len(x)
    r = mats(run(spark, "tlrotate")["cov"])
    assert np.allclose(sorted(np.linalg.det(r)), sorted(np.linalg.det(mats(run(spark, "tlcenter")["cov"]))), atol=1e-6)  # turned, not stretched


def test_tangent_space_there_and_back(spark):
    x = S.part_cov(spark, SF, 4).toPandas().set_index("id")["cov"]
    got = run(spark, "tangent_space_riemann")
    assert np.allclose(mats(got["cov"]), mats([x[i] for i in got["id"]]), rtol=1e-6)
    t = np.stack(got["tangent"])
    assert t.shape[1] == 10 and np.allclose(t.mean(0), 0, atol=1e-5)


def epochs(spark):
    e = S.embedding_epochs(spark, SF).toPandas()
    return e["id"].to_numpy(), e["y"].to_numpy(), np.stack(e["x"]).reshape(-1, 8, 8)


def lwf(x):
    x = x - x.mean(-1, keepdims=True)
    p, n = x.shape
    c = x @ x.T / n
    mu = np.trace(c) / p
    delta = ((c - mu * np.eye(p)) ** 2).sum() / p
    beta = min(sum(((np.outer(v, v) - c) ** 2).sum() for v in x.T) / n / n / p, delta)
    return (1 - beta / delta) * c + beta / delta * mu * np.eye(p)


def test_epoch_queries_by_brute_force(spark):
    ids, y, x = epochs(spark)
    at = {i: k for k, i in enumerate(ids)}
    for i, c in list(zip(*(run(spark, "block_covariances")[k] for k in ("id", "cov"))))[:40]:
        e, c = x[at[i]], np.asarray(c).reshape(8, 8)
        assert np.allclose(c[:4, :4], lwf(e[:4])) and np.allclose(c[4:, 4:], lwf(e[4:])) and not c[:4, 4:].any()
    tops = []
    for v in sorted(set(y)):
        m = x[y == v].mean(0)
        tops.append(np.linalg.svd(m)[0][:, :1].T @ m)
    for i, c in list(zip(*(run(spark, "erp_covariances")[k] for k in ("id", "cov"))))[:40]:
        c = np.asarray(c)
        c = c.reshape(round(len(c) ** 0.5), -1)
        want = lwf(np.concatenate([*tops, x[at[i]]]))
        assert np.allclose(np.abs(c), np.abs(want), atol=1e-9)  # the sign of a singular vector is free
    got = run(spark, "flat_channel_remover")
    assert np.allclose(np.stack([v for _, v in sorted(zip(got["id"], got["x"]))]), x.reshape(len(x), -1)[np.argsort(ids)])
    for name, width in (("xdawn", None), ("xdawn_covariances", None), ("csp", 4), ("electrode_selection", 16)):
        got = run(spark, name)
        last = got[got.columns[-1]]
        assert len(got) == len(x) and np.isfinite(np.stack(last)).all() and (width is None or len(last[0]) == width)


def test_joint_diagonalisation_brings_off_diagonals_down(spark):
    ids, y, x = epochs(spark)
    c = np.stack([lwf(e) for e in x])
    c = np.stack([c[y == v].mean(0) for v in sorted(set(y))])

    def off(v):
        d = v @ c @ v.T
        s = 1 / np.sqrt(np.einsum("kii->ki", d))
        d = d * s[:, :, None] * s[:, None]
        return (d**2).sum() - len(c) * 8

    got = run(spark, "joint_diagonalisation")
    assert set(got.key) == {"ajd_pham", "rjd", "uwedge"}
    for m in got["matrix"]:
        v = np.asarray(m)
        v = v.reshape(8, -1)
        assert min(off(v), off(v.T)) < off(np.eye(8))


def test_classifiers_by_brute_force(spark):
    ids, y, x = epochs(spark)
    c = np.stack([lwf(e) for e in x])
    labels = sorted(set(y))
    means = [M.mean(c[y == v], "riemann")[0] for v in labels]
    got = run(spark, "mdm_riemann").set_index("id")["prediction"]
    near = np.stack([D.distance(c, m[None], "riemann") for m in means], 1)
    clear = np.diff(np.sort(near, 1)[:, :2], axis=1)[:, 0] > 1e-4
    assert (np.array(labels)[near.argmin(1)] == got[ids].to_numpy())[clear].all()
    got = run(spark, "knn_riemann").set_index("id")["prediction"]
    full = D.pairwise(c, c, "riemann")
    agree = 0
    for k, i in enumerate(ids):
        five = np.lexsort((ids, full[k]))[:5]
        v, n = np.unique(y[five], return_counts=True)
        agree += v[n.argmax()] == got[i]
    assert agree / len(ids) > 0.99
    for name in ("fgmdm", "ts_classifier", "mean_field", "nearest_convex_hull", "svc"):
        got = run(spark, name)
        assert len(got) == len(ids) and set(got.prediction) <= set(labels)
        assert (got.y == got.prediction).mean() > 1.1 / len(labels), name


def test_regressors_and_transfer_classifiers(spark):
    d = S.supplier_cov(spark, SF).toPandas()
    for name in ("svr", "tl_regressor"):
        got = run(spark, name)
        assert set(got["id"]) == set(d["id"]) and np.isfinite(got.prediction).all()
    for name in ("tl_classifier", "mdwm"):
        got = run(spark, name)
        assert len(got) == 200 and set(got.prediction) <= {"dear", "cheap"}
    assert len(run(spark, "tlrotate_vectors")) == 200 and len(run(spark, "fgda")) == 200 and len(run(spark, "spoc")) == 200 and len(run(spark, "ajdc")) == 500


def test_potatoes_by_brute_force(spark):
    d = S.part_cov(spark, SF).toPandas()
    x = mats(d["cov"])
    use = np.ones(len(x), bool)
    while True:
        m = M.mean(x[use], "riemann")[0]
        log = np.log(D.distance(x, m[None], "riemann"))
        z = (log - log[use].mean()) / log[use].std()
        if (use == (z < 2)).all() or (z < 2).sum() == use.sum():
            break
        use = z < 2
    got = run(spark, "potato").set_index("id")
    assert np.allclose(got.z[d["id"]], z, atol=1e-3) and np.allclose(got.p[d["id"]], [0.5 * math.erfc(v / math.sqrt(2)) for v in z], atol=1e-3)
    got = run(spark, "potato_field")
    assert len(got) == len(x) and got.p.between(0, 1).all() and (got.prediction == (got.p > 0.01)).all()
    f = artifacts.PotatoField(2)
    for zs in ([0.3, -1.2], [2.5, 3.0], [-3.0, 0.0]):
        h = -sum(math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in zs)
        assert np.isclose(f.p_value(zs), math.exp(-h) * (1 + h))


def test_clusterings(spark):
    x = mats(S.part_cov(spark, SF).orderBy("id").toPandas()["cov"])
    logs = np.stack([root(a, np.log) for a in x]).reshape(len(x), -1)
    p = run(spark, "kmeans").sort_values("id").prediction.to_numpy()
    centres = np.stack([logs[p == k].mean(0) for k in range(3)])
    assert (((logs[:, None] - centres) ** 2).sum(2).argmin(1) == p).mean() > 0.97  # settled, or nearly
    got = run(spark, "gaussian_mixture")
    assert np.allclose(np.stack(got.probabilities).sum(1), 1) and (np.stack(got.probabilities).argmax(1) == got.prediction).all()
    assert len(run(spark, "kmeans_per_class")) == 10


def test_mean_shift_by_brute_force(spark):
    """All matrices climb, as in a loop over them; also by blocks beyond the broadcast."""
    rng = np.random.default_rng(3)
    logs = np.concatenate([rng.normal(0, 0.1, (12, 3)), rng.normal(0, 0.1, (9, 3)) + 2, rng.normal(0, 0.1, (1, 3)) - 3])
    x = np.stack([root(np.array([[a, b], [b, c]]), np.exp) for a, b, c in logs])
    df = from_numpy(spark, x)
    lg = np.stack([root(a, np.log) for a in x])
    want = []
    for m in lg.copy():
        for _ in range(100):
            near = np.linalg.norm(lg - m, axis=(1, 2)) <= 1.0
            step = (lg[near] - m).mean(0)
            m = m + step
            if np.linalg.norm(step) < 1e-3:
                break
        if all(np.linalg.norm(m - o) >= 1.0 for o in want):
            want.append(m)
    got = clustering.MeanShift(metric="logeuclid", bandwidth=1.0).fit(df)
    assert len(got.modes_) == len(want) == 3 and np.allclose([root(m, np.log) for m in got.modes_], want, atol=1e-2)
    assert len(run(spark, "mean_shift")) == 10


def test_embeddings_by_brute_force(spark):
    d = S.supplier_cov(spark, SF).orderBy("id").toPandas()
    x = mats(d["cov"])
    dist = np.array([[math.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(b, a)).real) ** 2).sum()) for b in x] for a in x])
    k = np.exp(-(dist**2) / (4 * np.median(dist) ** 2 / 2))
    q = k.sum(1)
    k = k / q[:, None] / q
    w, v = np.linalg.eig(k / k.sum(1)[:, None])
    v = np.real(v[:, np.argsort(-np.real(w))])
    got = np.stack(run(spark, "spectral_embedding").sort_values("id").embedding)
    for j in range(2):
        assert abs(np.corrcoef(got[:, j], v[:, j + 1])[0, 1]) > 0.999
    for name, width in (("locally_linear_embedding", 2), ("tsne", 4)):
        e = np.stack(run(spark, name).embedding)
        assert e.shape == (10, width) and np.isfinite(e).all()


def test_permutation_tests_by_brute_force(spark):
    d = S.supplier_cov(spark, SF).orderBy("id").toPandas()
    x, y = mats(d["cov"]), d["domain"].to_numpy()
    lg = np.stack([root(a, np.log) for a in x])
    d2 = ((lg[:, None] - lg[None]) ** 2).sum((2, 3))
    test = stats.PermutationDistance(40, "logeuclid", "pairwise")
    p, others = test.test(S.supplier_cov(spark, SF), "domain")
    _, n, order = test._orders(y, None)
    want = np.array([stats.pseudo_f(d2, order(k)) for k in range(n)])
    assert np.allclose(test.scores_, want) and p == (want[0] <= want).mean() and len(others) == n - 1
    for name in ("pairwise", "ttest", "ftest", "model"):
        got = run(spark, f"permutation_{name}")
        assert len(got) == 1 and 0 < got.p[0] <= 1


def test_group_sums_by_tiles(spark, monkeypatch):
    x = np.stack([G.unupper(v) for v in np.random.default_rng(1).normal(size=(50, 3))])
    x = np.stack([root(a, np.exp) for a in x])
    df, labels = from_numpy(spark, x), [np.arange(50) % 3, np.arange(50) % 2]
    d2 = D.pairwise(x, x, "riemann") ** 2
    near = pairs.nearest(df, df, 3).orderBy("i", "rank").collect()
    kernel = pairs.dense(pairs.kernel(df, metric="euclid"), list(range(50)), "k", False)
    monkeypatch.setattr(pairs, "BROADCAST_MB", 0)
    monkeypatch.setattr(pairs, "BLOCK", 8)
    got = {r.k: r for r in pairs.group_sums(df, stats.Codes(np.arange(50), labels)).collect()}
    for k, y in enumerate(labels):
        within = sum(d2[np.ix_(y == v, y == v)].sum() / 2 / (y == v).sum() for v in set(y))
        assert np.isclose(got[k].total, d2.sum() / 2) and np.isclose(got[k].within, within)
    again = pairs.nearest(df, df, 3).orderBy("i", "rank").collect()
    assert [(r.i, r.j, r["rank"]) for r in again] == [(r.i, r.j, r["rank"]) for r in near]
    assert np.allclose(pairs.dense(pairs.kernel(df, metric="euclid"), list(range(50)), "k", False), kernel)
    lop = pairs.pairwise_distance(df, metric="kullback")
    assert lop.count() == 50 * 49 and pairs.pairwise_distance(df).count() == 50 * 49 // 2


def test_generators(spark):
    sizes = {"sample_gaussian": 200, "make_matrices": 120, "make_complex_matrices": 50, "make_gaussian_blobs": 100, "make_outliers": 20, "make_classification_transfer": 100}
    for name, n in sizes.items():
        df = model_queries.QUERIES[name](spark, SF)
        a, b = df.orderBy("id").toArrow(), df.repartition(3).orderBy("id").toArrow()
        assert a.num_rows == n and a.equals(b) or name == "make_matrices" and a.num_rows == n, name
    g = decode(model_queries.QUERIES["sample_gaussian"](spark, SF).toArrow()["cov"])
    assert (np.linalg.eigvalsh(g) > 0).all() and np.abs(log_at(np.eye(2), g).mean(0)).max() < 0.3


# streams


def stream_rows(spark):
    d = model_queries._order_stream(spark, SF)
    o = S.table(spark, SF, "orders")
    x, y = F.col("o_totalprice") / 1e5 + 0.1, F.col("o_custkey") % 7 + 1.0
    fitted = artifacts.Potato(threshold=3).fit(o.where("o_orderkey % 40 = 1").select(F.array(x + 1, F.lit(0.1), F.lit(0.1), y).alias("cov")))
    table = o.where("o_orderkey % 40 = 0").select(F.col("o_orderkey").alias("id"), F.array(x + 1, F.lit(0.1), F.lit(0.1), y).alias("cov")).orderBy("id").toPandas()
    return d, fitted, table


def test_stream_potato_by_brute_force_and_after_a_restart(spark):
    d, fitted, table = stream_rows(spark)
    m, mu, sigma = fitted.mean_, fitted.mu_, fitted.sigma_
    want = []
    for v in mats(table["cov"]):
        dist = math.log(D.distance(v, m))
        want.append(z := (dist - mu) / sigma)
        if z < 3:
            m = G.geodesic(m, v, 0.01)
            mu = 0.99 * mu + 0.01 * dist
            sigma = math.sqrt(0.99 * sigma**2 + 0.01 * (dist - mu) ** 2)
    got = run(spark, "stream_online_potato").sort_values("at")
    assert list(got["at"]) == list(table["id"]) and np.allclose(got.z, want)
    folder = f"{shared_folder(spark)}/{stream_name('restart')}"
    model = OnlinePotato(fitted, "id", folder=folder).run(d.where("id % 40 = 0"), "a")
    idle = OnlinePotato(stream_rows(spark)[1], "id", folder=folder).run(d.where("id % 40 = 0"), "a")  # nothing new
    assert idle.seen == 0 and idle.t == len(want)
    again = OnlinePotato(stream_rows(spark)[1], "id", folder=folder)
    again(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0])], "id long, cov array<double>"), 0)  # done before
    assert again.seen == model.seen == 0 and np.allclose(again.model.mean_, m) and again.t == len(want)
    again(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0])], "id long, cov array<double>"), 1)
    assert again.t == len(want) + 1 and again.seen == 1 and spark.read.parquet(f"{folder}/out").count() == len(want) + 1


def test_stream_field_mean_and_whitening(spark):
    field = run(spark, "stream_online_potato_field").sort_values("at")
    one = run(spark, "stream_online_potato").sort_values("at")
    assert len(field) == len(one) and np.isclose(field.z.iloc[0][0], one.z.iloc[0]) and np.isfinite(np.stack(field.z)).all()
    w = run(spark, "stream_online_whitening")
    x = mats(w["cov"])
    assert np.abs(log_at(np.eye(2), x).mean(0)).max() < 1e-3  # one batch: its mean is the identity
    e = S.table(spark, SF, "events").orderBy("event_type", "event_id").toPandas()
    got = run(spark, "stream_online_mean").set_index("event_type")
    for kind, g in e.groupby("event_type"):
        m = None
        for v, u in zip(g["value"], g["user_id"]):
            x = np.array([[1 + abs(v), 0.1], [0.1, 1 + u % 7]])
            m = x if m is None else G.geodesic(m, x, 0.1)
        assert got.n[kind] == len(g) and np.allclose(mats([got["mean"][kind]])[0], m)


def test_streams_need_a_watermark(spark):
    s = read_table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    with pytest.raises(ValueError):
        windowed_covariance(s, "ts", ["value", "value"], ["event_type"], "1 day")
    w = OnlineWhitening(tangent.Whitening("riemann"), "id")
    w(spark.createDataFrame([(1, [2.0, 0.0, 0.0, 2.0])], "id long, cov array<double>"), 0)
    assert w.seen == 0 and np.allclose(w.model.mean_, 2 * np.eye(2))


def test_numbers_in_order(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(v)) for k in "ab" for v in rng.permutation(300)] + [(None, int(v)) for v in rng.permutation(40)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = numbered(df, ["k"], F.floor(F.col("v") / 16), ["v"]).collect()
    assert len(got) == len(rows) and all(r.t == r.v for r in got)
    one = numbered(df.where("k = 'a' and v % 3 = 0"), [], F.floor(F.col("v") / 16), ["v"], "n").collect()
    assert sorted((r.n, r.v) for r in one) == [(i, 3 * i) for i in range(100)]
    assert numbered(df.limit(0), ["k"], F.col("v"), ["v"]).count() == 0


# model selection


def test_cross_validation_by_brute_force(spark):
    rng = np.random.default_rng(9)
    y = np.arange(60) % 2
    x = np.stack([np.exp(0.4 * k) * np.eye(2) + 0.1 * np.outer(v, v) for k, v in zip(y, rng.normal(size=(60, 2)))])
    df = from_numpy(spark, x, y=y)
    from tesserae.ml.classification import MDM

    folds = selection.stratified_folds(df, "y", 4).toPandas()
    assert all(abs((g.fold.value_counts() - 7.5).abs().max()) <= 1 for _, g in folds.groupby("y")) and folds.fold.nunique() == 4
    got = selection.cross_validate(lambda: MDM("logeuclid"), df, 4)
    f = folds.sort_values("id").fold.to_numpy()
    lg = np.stack([root(a, np.log) for a in x]).reshape(60, -1)
    want = []
    for k in range(4):
        c = np.stack([lg[(f != k) & (y == v)].mean(0) for v in (0, 1)])
        want.append((((lg[f == k, None] - c) ** 2).sum(2).argmin(1) == y[f == k]).mean())
    assert np.allclose(got, want)
    best, scores = selection.grid_search(lambda metric: MDM(metric), {"metric": ["euclid", "logeuclid"]}, df, 4)
    assert best["metric"] in ("euclid", "logeuclid") and len(scores) == 2 and np.allclose(scores[1][1], want)
    pipe = selection.Pipeline(tangent.Whitening("euclid"), MDM("logeuclid")).fit(df)
    assert pipe.score(df) > 0.8 and pipe.predict(df).count() == 60


# composites


def test_band_selection_by_brute_force(spark):
    rng = np.random.default_rng(4)
    t, y = np.arange(128) / 128, np.arange(40) % 2
    x = rng.normal(0, 0.3, (40, 2, 128))
    for k in range(40):
        x[k, 0] += (1 + 2 * y[k]) * np.sin(2 * np.pi * 12 * t + rng.uniform(0, 6))
    df = spark.createDataFrame([(k, int(y[k]), x[k].ravel().tolist()) for k in range(40)], "id long, y int, x array<double>")
    band, found = composite.band_selection(df, 2, 128, (6.0, 22.0), 4, 2)
    want = []
    for a in np.arange(6.0, 19.0, 2):
        s = np.fft.rfft(x, axis=-1)
        f = np.fft.rfftfreq(128, 1 / 128)
        s[..., (f < a) | (f > a + 4)] = 0
        b = np.fft.irfft(s, 128, axis=-1)
        b = b - b.mean(-1, keepdims=True)
        c = b @ b.transpose(0, 2, 1) / 127
        m = [M.mean(c[y == v], "riemann")[0] for v in (0, 1)]
        own = [D.distance(c[y == v], m[v][None], "riemann").mean() for v in (0, 1)]
        want.append(D.distance(*m, "riemann") / (sum(own) / 2))
    assert np.allclose(found, want, rtol=1e-4) and band[0] <= 12 <= band[1]
    assert composite.widest_band([1, 5, 9, 8, 2], [0, 2, 4, 6, 8], [4, 6, 8, 10, 12], 0.4) == [4.0, 10.0]
    wide = composite.filter_bank(df, 2, [8, 12], 1, 128).orderBy("id").collect()
    assert len(wide[0].x) == 4 * 128 and np.allclose(np.asarray(wide[3].x).reshape(2, 2, 128)[1], composite_band(x[3], 11, 13))


def composite_band(x, a, b):
    s = np.fft.rfft(x, axis=-1)
    f = np.fft.rfftfreq(128, 1 / 128)
    s[..., (f < a) | (f > b)] = 0
    return np.fft.irfft(s, 128, axis=-1)


def test_composites_check_their_input(spark):
    for bad in (dict(block_size=[2, 3]), dict(block_size=2, metric=["rbf"]), dict(block_size=2, metric="nothing"), dict(block_size=2.0)):
        with pytest.raises(ValueError):
            composite.HybridBlocks(8, **bad).fit()
    assert composite.HybridBlocks(8, 3).fit().blocks_ == [3, 3, 2]
    with pytest.raises(ValueError):
        composite.image_windows(closed_queries.pixels(spark, SF), 4)


def test_complex_pixels(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(60, 3)) + 1j * rng.normal(size=(60, 3)) @ np.diag([3, 1, 0.2])
    df = spark.createDataFrame([(k, (v.real.tolist(), v.imag.tolist())) for k, v in enumerate(z)], "row long, v struct<re:array<double>,im:array<double>>")
    m = composite.PCAImage(2).fit(df)
    c = z - z.mean(0)
    w = np.linalg.eigvalsh(c.conj().T @ c / 60)[::-1]
    assert np.allclose(m.explained_variance_, w[:2])
    out = decode(m.transform(df).orderBy("row").toArrow()["v"], (-1,))
    assert np.allclose((np.abs(out) ** 2).mean(0), w[:2])


def test_many_groups_and_few_give_the_same(spark, monkeypatch):
    d = S.part_labels(spark, SF)
    for metric in ("riemann", "logeuclid", "kullback_sym"):
        want = {r.key: r["mean"] for r in means.mean_frame(d, metric, by="y").collect()}
        monkeypatch.setattr(means, "GROUPS", 2)
        monkeypatch.setattr(means, "HELD", 3)
        got = {r.key: r["mean"] for r in means.mean_frame(d, metric, by="y").collect()}
        monkeypatch.undo()
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-6) for k in want)


def test_dense_problems_check_their_size(spark, monkeypatch):
    d = S.supplier_cov(spark, SF)
    monkeypatch.setattr(classification.NearestConvexHull, "LIMIT", 3)
    monkeypatch.setattr(classification._KernelMachine, "LIMIT", 3)
    monkeypatch.setattr(stats, "LIMIT", 3)
    for f in (lambda: classification.NearestConvexHull().fit(d, "domain"), lambda: classification.SVC("euclid").fit(d, "domain"), lambda: classification.SVR("euclid").fit(d, "target"), lambda: stats.PermutationDistance(3).test(d, "domain"), lambda: stats.PermutationModel(3).test(d, "domain")):
        with pytest.raises(ValueError):
            f()


def test_general_masks(spark):
    rng = np.random.default_rng(2)
    x = np.stack([root(a + a.T, np.exp) for a in rng.normal(0, 0.3, (12, 4, 4))])
    masks = [np.linalg.qr(rng.normal(size=(4, m)))[0] for m in (2, 3, 3, 2)] * 3
    df = spark.createDataFrame([(k, x[k].ravel().tolist(), q.ravel().tolist()) for k, q in enumerate(masks)], "id long, cov array<double>, q array<double>")
    got = maskedmean_riemann(df.repartition(3), mask="q", tol=1e-9, maxiter=100).matrix
    assert np.allclose(got, M.maskedmean_riemann(x, masks, tol=1e-9)[0], atol=1e-6)
    with pytest.raises(ValueError):
        maskedmean_riemann(df, keep="q", mask="q")
