"""Queries that SQL expresses too: their plans are Catalyst expressions or single Arrow stages, and each has DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae import columns as X
from tesserae import functions as fn
from tesserae.frames import apply
from tesserae.kernels import geometry as G
from tesserae.ml.artifacts import Potato
from tesserae.ml.classification import MDM, KNearestNeighbor, KNearestNeighborRegressor, class_distinctiveness
from tesserae.operators.means import mean, mean_frame
from tesserae.operators.order import numbered
from tesserae.operators.pairs import group_sums, kernel, pairwise_distance
from tesserae.operators.stats import Codes
from tesserae.operators.transfer import TLCenter, TLScale, decode_domains, encode_domains
from tesserae.sources import tables as S
from tesserae.streaming import windowed_covariance

QUERIES, SQL = {}, {}


def query(sql):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


#: Added before rounding: sums of decimals lie on ties, which two engines round apart.
SHIFT = 3e-8


def entries(m, p=2, names=None):
    m = F.col(m) if isinstance(m, str) else m
    names = names or [f"m{i}{j}" for i in range(p) for j in range(i, p)]
    at = [i * p + j for i in range(p) for j in range(i, p)]
    return [F.round(m[k] + SHIFT, 6).alias(n) for k, n in zip(at, names)]


CH = ["l_quantity", "100 * l_discount", "l_extendedprice / 1000", "100 * l_tax"]


def _cov_sql(f="covar_pop", p=2, key="l_partkey"):
    e = ", ".join(f"{f}({CH[i]}, {CH[j]}) AS m{i}{j}" for i in range(p) for j in range(i, p))
    return f"SELECT {key} AS id, {e} FROM lineitem GROUP BY {key} HAVING count(*) >= 12"


C2 = f"c AS ({_cov_sql()})"
L2 = C2 + ", d AS (SELECT c.*, p_brand AS y FROM c JOIN part ON p_partkey = id)"
S2 = f"""c AS ({_cov_sql(key="l_suppkey")}), d AS (SELECT c.*, n_name AS y, r_name AS domain, s_acctbal AS target FROM c JOIN supplier ON s_suppkey = id
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _r(**cols):
    return ", ".join(f"round(({v}) + {SHIFT}, 6) AS {k}" for k, v in cols.items())


def eig(m):
    """(larger, smaller) eigenvalue of a matrix given by its three entries."""
    a, b, c = m
    big = f"((({a}) + ({c}) + sqrt((({a}) - ({c})) * (({a}) - ({c})) + 4 * ({b}) * ({b}))) / 2)"
    return big, f"((({a}) * ({c}) - ({b}) * ({b})) / {big})"


def fun(m, f):
    a, b, c = m
    x, y = eig(m)
    beta = f"(CASE WHEN abs({x} - {y}) <= abs({x}) * 1e-12 THEN 0 ELSE ({f(x)} - {f(y)}) / ({x} - {y}) END)"
    alpha = f"({f(x)} - {beta} * {x})"
    return f"({alpha} + {beta} * ({a}))", f"({beta} * ({b}))", f"({alpha} + {beta} * ({c}))"


def log2(m):
    return fun(m, lambda v: f"ln({v})")


def exp2(m):
    a, b, c = m
    h, d = f"(({a} + {c}) / 2)", f"(({a} - {c}) / 2)"
    r = f"sqrt({d} * {d} + {b} * {b})"
    s = f"(CASE WHEN {r} < 1e-12 THEN 1 ELSE (exp({r}) - exp(-{r})) / 2 / {r} END)"
    ch = f"((exp({r}) + exp(-{r})) / 2)"
    return f"(exp({h}) * ({ch} + {s} * {d}))", f"(exp({h}) * {s} * {b})", f"(exp({h}) * ({ch} - {s} * {d}))"


def inv(m):
    a, b, c = m
    d = f"({a} * {c} - {b} * {b})"
    return f"({c} / {d})", f"(-{b} / {d})", f"({a} / {d})"


def chol(m):
    a, b, c = m
    return f"sqrt({a})", f"({b} / sqrt({a}))", f"sqrt({c} - {b} * {b} / {a})"


def unchol(low):
    p, q, r = low
    return f"({p} * {p})", f"({p} * {q})", f"({q} * {q} + {r} * {r})"


def det(m):
    return f"({m[0]} * {m[2]} - {m[1]} * {m[1]})"


def fro(x, y):
    return f"sqrt(({x[0]} - {y[0]}) ** 2 + 2 * ({x[1]} - {y[1]}) ** 2 + ({x[2]} - {y[2]}) ** 2)"


def pencil(a, b):
    t = f"(({a[0]} * {b[2]} + {a[2]} * {b[0]} - 2 * {a[1]} * {b[1]}) / {det(b)})"
    q = f"({det(a)} / {det(b)})"
    big = f"(({t} + sqrt(greatest({t} * {t} - 4 * {q}, 0))) / 2)"
    return big, f"({q} / {big})"


def _low3(x, y):
    return f"sqrt(({x[0]} - {y[0]}) ** 2 + ({x[1]} - {y[1]}) ** 2 + ({x[2]} - {y[2]}) ** 2)"


def _kl(a, b):
    x, y = pencil(a, b)
    return f"(({x} + {y} - 2 - ln({x} * {y})) / 2)"


def logchol(m):
    p, q, r = chol(m)
    return f"ln({p})", q, f"ln({r})"


DIST = {
    "euclid": fro,
    "harmonic": lambda a, b: fro(inv(a), inv(b)),
    "logeuclid": lambda a, b: fro(log2(a), log2(b)),
    "chol": lambda a, b: _low3(chol(a), chol(b)),
    "logchol": lambda a, b: _low3(logchol(a), logchol(b)),
    "riemann": lambda a, b: "sqrt(ln({0}) ** 2 + ln({1}) ** 2)".format(*pencil(a, b)),
    "thompson": lambda a, b: "greatest(abs(ln({0})), abs(ln({1})))".format(*pencil(a, b)),
    "kullback": _kl,
    "kullback_right": lambda a, b: _kl(b, a),
    "kullback_sym": lambda a, b: f"{_kl(a, b)} + {_kl(b, a)}",
    "logdet": lambda a, b: f"sqrt(greatest(ln({det([f'(({p} + {q}) / 2)' for p, q in zip(a, b)])}) - (ln({det(a)}) + ln({det(b)})) / 2, 0))",
    "wasserstein": lambda a, b: f"sqrt(greatest({a[0]} + {a[2]} + {b[0]} + {b[2]} - 2 * sqrt({a[0]} * {b[0]} + 2 * {a[1]} * {b[1]} + {a[2]} * {b[2]} + 2 * sqrt({det(a)} * {det(b)})), 0))",
}
M = ("m00", "m01", "m11")
A, B = ("a.m00", "a.m01", "a.m11"), ("b.m00", "b.m01", "b.m11")


@query(f"WITH c AS ({_cov_sql(p=4)}) SELECT id, {_r(**{f'm{i}{j}': f'm{i}{j}' for i in range(4) for j in range(i, 4)})} FROM c")
def cov_scm(spark, sf):
    return S.part_cov(spark, sf, 4).select("id", *entries("cov", 4))


@query(f"WITH c AS ({_cov_sql('covar_samp')}) SELECT id, {_r(m00='m00', m01='m01', m11='m11')} FROM c")
def cov_cov(spark, sf):
    return S.part_cov(spark, sf, ddof=1).select("id", *entries("cov"))


@query(f"SELECT l_partkey AS id, round(corr({CH[0]}, {CH[1]}), 6) AS r FROM lineitem GROUP BY 1 HAVING count(*) >= 12")
def cov_corr(spark, sf):
    return S.part_cov(spark, sf).select("id", F.round(X.normalize(F.col("cov"), 2, "corr")[1], 6).alias("r"))


@query(f"WITH c AS ({_cov_sql(p=4)}) SELECT id, {_r(m00='m00', m01='m01', m11='m11', m22='m22', m23='m23', m33='m33')}, 0.0 AS m02 FROM c")
def block_cov(spark, sf):
    lines = S.table(spark, sf, "lineitem")
    two = [S.covariance_by(lines, "l_partkey", S.CHANNELS[k : k + 2]).withColumnRenamed("cov", f"b{k}") for k in (0, 2)]
    d = two[0].join(two[1].select("id", "b2"), "id")
    return d.select("id", *entries("b0"), *entries("b2", names=["m22", "m23", "m33"]), F.lit(0.0).alias("m02"))


@query(f"WITH {C2} SELECT id, {_r(m00='m00 / (m00 + m11)', m01='m01 / (m00 + m11)', m11='m11 / (m00 + m11)')} FROM c")
def normalize_trace(spark, sf):
    return S.part_cov(spark, sf).select("id", *entries(X.normalize(F.col("cov"), 2, "trace")))


@query(f"WITH {C2} SELECT id, {_r(**{k: f'{k} / sqrt(abs({det(M)}))' for k in M})} FROM c")
def normalize_determinant(spark, sf):
    return S.part_cov(spark, sf).select("id", *entries(X.normalize(F.col("cov"), 2, "determinant")))


@query(f"WITH c AS ({_cov_sql(p=4)}) SELECT id, round(2 * (m01 ** 2 + m02 ** 2 + m03 ** 2 + m12 ** 2 + m13 ** 2 + m23 ** 2) / 3 / (m00 ** 2 + m11 ** 2 + m22 ** 2 + m33 ** 2), 9) AS w FROM c")
def nondiag_weight(spark, sf):
    return S.part_cov(spark, sf, 4).select("id", F.round(X.nondiag_weight(F.col("cov"), 4), 9).alias("w"))


@query(f"WITH {C2} SELECT id, {_r(m00='0.9 * m00 + 0.05 * (m00 + m11)', m01='0.9 * m01', m11='0.9 * m11 + 0.05 * (m00 + m11)')} FROM c")
def shrinkage(spark, sf):
    return S.part_cov(spark, sf).select("id", *entries(X.shrink(F.col("cov"), 2, 0.1)))


@query(f"WITH {C2} SELECT id, m00 + m11 > 0 AND {det(M)} > 0 AS spd FROM c")
def is_spd(spark, sf):
    return fn.predicate(S.part_cov(spark, sf), "spd", out="spd").select("id", "spd")


def _spectral(name, sql):
    @query(f"WITH {C2} SELECT id, {_r(**dict(zip(M, sql(M))))} FROM c")
    def run(spark, sf):
        return fn.matrix_function(S.part_cov(spark, sf), name, **({"alpha": 2} if name == "powm" else {})).select("id", *entries("out"))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, SQL.pop("run")
    QUERIES.pop("run")


for _n, _f in {
    "logm": log2,
    "sqrtm": lambda m: fun(m, lambda v: f"sqrt({v})"),
    "invsqrtm": lambda m: fun(m, lambda v: f"(1 / sqrt({v}))"),
    "powm": lambda m: ("(m00 * m00 + m01 * m01)", "(m00 * m01 + m01 * m11)", "(m01 * m01 + m11 * m11)"),
}.items():
    _spectral(_n, _f)


@query(f"WITH {C2}, s AS (SELECT id, m00 / 50 AS m00, m01 / 50 AS m01, m11 / 50 AS m11 FROM c) SELECT id, {_r(**dict(zip(M, exp2(M))))} FROM s")
def expm(spark, sf):
    d = S.part_cov(spark, sf).select("id", F.transform("cov", lambda v: v / 50).alias("cov"))
    return d.select("id", *entries(X.exp2x2(F.col("cov"))))


def _distance(metric):
    name = f"dist_{metric}"
    sql = f"WITH {C2}, b AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM c) SELECT id, {_r(distance=DIST[metric](A, B))} FROM c a, b"

    def run(spark, sf):
        d = S.part_cov(spark, sf)
        centre = d.agg(F.array(*(F.avg(F.col("cov")[k]) for k in range(4))).alias("centre"))  # one row
        return fn.distance(d.crossJoin(F.broadcast(centre)), "cov", "centre", metric, order=2).select("id", F.round(F.col("distance") + SHIFT, 6).alias("distance"))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


for _n in DIST:
    _distance(_n)


@query(f"WITH {C2}, b AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM c) SELECT id, {_r(distance=DIST['riemann'](A, B))} FROM c a, b")
def dist_riemann_kernel(spark, sf):
    """The same by the numpy kernel, whose cost doesn't depend on closed forms."""
    d = S.part_cov(spark, sf)
    return fn.distance(d, "cov", mean(d, "euclid")).select("id", F.round(F.col("distance") + SHIFT, 6).alias("distance"))


def _mean(metric, to, back):
    name = f"mean_{metric}"
    inner = ", ".join(f"avg({e}) AS {k}" for k, e in zip(M, to(M)))
    sql = f"WITH {L2}, g AS (SELECT y AS key, {inner} FROM d GROUP BY y) SELECT key, {_r(**dict(zip(M, back(M))))} FROM g"

    def run(spark, sf):
        return mean_frame(S.part_labels(spark, sf), metric, by="y").select("key", *entries("mean"))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


_mean("euclid", lambda m: m, lambda m: m)
_mean("harmonic", inv, inv)
_mean("logeuclid", log2, exp2)
_mean("chol", chol, unchol)
_mean("logchol", logchol, lambda m: unchol((f"exp({m[0]})", m[1], f"exp({m[2]})")))


def mid(a, b):
    """Riemannian mean of two 2x2 matrices."""
    s, t = f"sqrt({det(a)})", f"sqrt({det(b)})"
    h = [f"({p} / {s} + {q} / {t})" for p, q in zip(a, b)]
    f = f"(sqrt({s} * {t}) / sqrt({det(h)}))"
    return tuple(f"({f} * {v})" for v in h)


@query(
    f"""WITH {L2}, a AS (SELECT y AS key, avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM d GROUP BY y),
h AS (SELECT y AS key, {", ".join(f"avg({e}) AS {k}" for k, e in zip(M, inv(M)))} FROM d GROUP BY y), b AS (SELECT key, {", ".join(f"{e} AS {k}" for k, e in zip(M, inv(M)))} FROM h)
SELECT a.key, {_r(**dict(zip(M, mid(A, B))))} FROM a JOIN b ON a.key = b.key"""
)
def mean_kullback_sym(spark, sf):
    return mean_frame(S.part_labels(spark, sf), "kullback_sym", by="y").select("key", *entries("mean"))


GEO = {
    "euclid": lambda a, b: tuple(f"(0.75 * {x} + 0.25 * {y})" for x, y in zip(a, b)),
    "chol": lambda a, b: unchol(tuple(f"(0.75 * {x} + 0.25 * {y})" for x, y in zip(chol(a), chol(b)))),
    "logchol": lambda a, b: unchol((f"({chol(a)[0]} ** 0.75 * {chol(b)[0]} ** 0.25)", f"(0.75 * {chol(a)[1]} + 0.25 * {chol(b)[1]})", f"({chol(a)[2]} ** 0.75 * {chol(b)[2]} ** 0.25)")),
    "logeuclid": None,
    "riemann": mid,
}


def _geodesic(metric):
    name, alpha = f"geodesic_{metric}", 0.5 if metric == "riemann" else 0.25
    head = f"WITH {C2}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM c)"
    if metric == "logeuclid":
        logs = ", ".join(f"0.75 * {x} + 0.25 * {y} AS {k}" for k, x, y in zip(M, log2(A), log2(B)))
        sql = f"{head}, t AS (SELECT a.id AS id, {logs} FROM n a JOIN n b ON b.k = a.k + 1) SELECT id, {_r(**dict(zip(M, exp2(M))))} FROM t"
    else:
        sql = f"{head} SELECT a.id AS id, {_r(**dict(zip(M, GEO[metric](A, B))))} FROM n a JOIN n b ON b.k = a.k + 1"

    def run(spark, sf):
        d = S.part_cov(spark, sf)
        n = numbered(d.select("id"), [], F.floor(F.col("id") / 10_000), ["id"], "k")
        ids = n.join(n.select(F.col("id").alias("next"), (F.col("k") - 1).alias("k")), "k").select("id", "next")
        pairs = d.join(ids, "id").join(d.select(F.col("id").alias("next"), F.col("cov").alias("other")), "next")
        return fn.geodesic(pairs, "cov", "other", alpha, metric).select("id", *entries("out"))

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


for _n in GEO:
    _geodesic(_n)


def _pairwise(metric):
    name = f"pairwise_{metric}"

    def run(spark, sf):
        return pairwise_distance(S.supplier_cov(spark, sf), metric=metric).select("i", "j", F.round(F.col("d") + SHIFT, 6).alias("d"))

    run.__name__ = name
    on = "a.id <> b.id" if metric in ("kullback", "kullback_right") else "a.id < b.id"
    QUERIES[name], SQL[name] = run, f"WITH {S2} SELECT a.id AS i, b.id AS j, {_r(d=DIST[metric](A, B))} FROM d a JOIN d b ON {on}"


for _n in ("riemann", "euclid", "logeuclid", "logchol", "wasserstein", "kullback"):
    _pairwise(_n)


def _dot(x, y):
    return f"({x[0]} * {y[0]} + 2 * {x[1]} * {y[1]} + {x[2]} * {y[2]})"


@query(f"WITH {S2} SELECT a.id AS i, b.id AS j, {_r(k=_dot(A, B))} FROM d a, d b")
def kernel_euclid(spark, sf):
    return kernel(S.supplier_cov(spark, sf), metric="euclid").select("i", "j", F.round(F.col("k") + SHIFT, 6).alias("k"))


@query(f"WITH {S2} SELECT a.id AS i, b.id AS j, {_r(k=_dot(log2(A), log2(B)))} FROM d a, d b")
def kernel_logeuclid(spark, sf):
    return kernel(S.supplier_cov(spark, sf), metric="logeuclid").select("i", "j", F.round(F.col("k") + SHIFT, 6).alias("k"))


_NN = f"""WITH {S2}, n AS (SELECT a.id AS i, b.id AS j, b.y AS y, b.target AS target, {DIST["riemann"](A, B)} AS d FROM d a, d b),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM (SELECT * REPLACE (CASE WHEN i = j THEN 0 ELSE d END AS d) FROM n) QUALIFY r <= 5)"""


@query(f"{_NN}, v AS (SELECT i, y, count(*) AS n FROM k GROUP BY i, y), b AS (SELECT i, y, row_number() OVER (PARTITION BY i ORDER BY n DESC, y) AS r FROM v) SELECT i AS id, y AS prediction FROM b WHERE r = 1")
def knn_predict(spark, sf):
    d = S.supplier_cov(spark, sf)
    return KNearestNeighbor(5).fit(d).predict(d).select("id", "prediction")


@query(f"{_NN}, w AS (SELECT i, target, exp(-d * d + min(d * d) OVER (PARTITION BY i)) AS e FROM k) SELECT i AS id, round(sum(e * target) / sum(e), 4) AS prediction FROM w GROUP BY i")
def knn_regress(spark, sf):
    d = S.supplier_cov(spark, sf)
    return KNearestNeighborRegressor(5).fit(d, "target").predict(d).select("id", F.round("prediction", 4).alias("prediction"))


@query(f"WITH {C2}, b AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM c) SELECT id, {_r(t0='a.m00 - b.m00', t1='sqrt(2) * (a.m01 - b.m01)', t2='a.m11 - b.m11')} FROM c a, b")
def tangent_space_euclid(spark, sf):
    d = S.part_cov(spark, sf)
    out = fn.at_reference(d, "tangent_space", mean(d, "euclid"), "euclid")
    return out.select("id", *(F.round(F.col("out")[k] + SHIFT, 6).alias(f"t{k}") for k in range(3)))


@query(f"WITH c AS ({_cov_sql(p=4)}) SELECT id, {_r(**{f'm{i}{j}': f'm{i}{j}' for i in range(4) for j in range(i, 4)})} FROM c")
def upper_unupper(spark, sf):
    d = S.part_cov(spark, sf, 4).withColumn("v", X.upper(F.col("cov"), 4))
    return d.select("id", *entries(X.unupper(F.col("v"), 4), 4))


_REF = "b AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM c)"


def _logmap():
    (p, q, r), (u, v, w) = chol(B), chol(A)
    s = (f"({p} * ln({u} / {p}))", f"({v} - {q})", f"({r} * ln({w} / {r}))")
    return f"(2 * {p} * {s[0]})", f"({p} * {s[1]} + {q} * {s[0]})", f"(2 * ({q} * {s[1]} + {r} * {s[2]}))"


@query(f"WITH {C2}, {_REF} SELECT id, {_r(**dict(zip(M, _logmap())))} FROM c a, b")
def log_map_logchol(spark, sf):
    d = S.part_cov(spark, sf)
    return fn.at_reference(d, "log_map", mean(d, "euclid"), "logchol").select("id", *entries("out"))


@query(f"WITH {C2} SELECT id, {_r(m00='m00', m01='m01', m11='m11')} FROM c")
def exp_log_riemann(spark, sf):
    """The logarithmic map at the mean and back."""
    d = S.part_cov(spark, sf)
    ref = mean(d, "euclid")
    out = apply(d, ["cov"], {"out": "matrix"}, lambda x: G.exp_map(G.log_map(x, ref), ref))
    return out.select("id", *entries("out"))


@query(f"WITH {C2}, {_REF} SELECT id, {_r(product=_dot(A, B))} FROM c a, b")
def innerproduct_euclid(spark, sf):
    d = S.part_cov(spark, sf)
    ref = [float(v) for v in mean(d, "euclid").ravel()]
    return d.select("id", F.round(X.dot(F.col("cov"), F.array(*map(F.lit, ref))) + SHIFT, 6).alias("product"))


@query(f"WITH {L2}, a AS (SELECT id, m00, m01, m11 FROM d), g AS (SELECT y, avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM d GROUP BY y), n AS (SELECT a.id, b.y, {DIST['riemann'](A, B)} AS dist FROM a, g b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, y) AS k FROM n) SELECT id, y AS prediction, round(dist, 6) AS dist FROM r WHERE k = 1")
def mdm_predict(spark, sf):
    d = S.part_labels(spark, sf)
    out = MDM({"mean": "euclid", "distance": "riemann"}).fit(d).predict(d)
    return out.select("id", "prediction", F.round(F.array_min("distances"), 6).alias("dist"))


@query(
    f"""WITH {L2}, g AS (SELECT y, avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM d GROUP BY y), t AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM g),
w AS (SELECT sum(v) AS w FROM (SELECT avg({fro(A, B)}) AS v FROM d a JOIN g b ON a.y = b.y GROUP BY a.y)), b AS (SELECT sum({fro(A, B)}) AS b FROM g a, t b)
SELECT round(b / w, 9) AS distinctiveness, round(b, 6) AS "between", round(w, 6) AS within FROM w, b"""
)
def class_distinctiveness_euclid(spark, sf):
    v = class_distinctiveness(S.part_labels(spark, sf), metric="euclid")
    return spark.createDataFrame([(round(v["distinctiveness"], 9), round(v["between"], 6), round(v["within"], 6))], "distinctiveness double, between double, within double")


@query(
    f"""WITH {S2}, p AS (SELECT a.y AS ya, b.y AS yb, ({DIST["riemann"](A, B)}) ** 2 AS d2 FROM d a JOIN d b ON a.id < b.id), n AS (SELECT count(*) AS n, count(DISTINCT y) AS k FROM d), cn AS (SELECT y, count(*) AS n FROM d GROUP BY y),
w AS (SELECT coalesce(sum(s / cn.n), 0) AS w FROM (SELECT ya, sum(d2) AS s FROM p WHERE ya = yb GROUP BY ya) JOIN cn ON cn.y = ya), t AS (SELECT sum(d2) AS t FROM p)
SELECT round(((t / n - w) / (k - 1)) / nullif(w / nullif(n - k, 0), 0), 9) AS f FROM t, n, w"""
)
def permanova_f(spark, sf):
    """Observed pseudo-F of nations, in one pass over the pairs, which are neither kept nor collected."""
    d = S.supplier_cov(spark, sf)
    labels = d.select("id", "y").orderBy("id").toArrow()
    y = labels["y"].to_numpy(zero_copy_only=False).astype(str)
    p = group_sums(d, Codes(labels["id"].to_numpy(), [y]))  # no label is joined to a pair
    size = d.agg(F.count("*").alias("n_all"), F.countDistinct("y").alias("k"))
    both = size.crossJoin(p.agg(F.sum("total").alias("t"), F.coalesce(F.sum("within"), F.lit(0.0)).alias("w"))).withColumn("t", F.expr("if(n_all > 1, t, null)"))
    return both.select(F.round(F.expr("((t / n_all - w) / (k - 1)) / nullif(w / nullif(n_all - k, 0), 0)"), 9).alias("f"))


@query(f"WITH {S2} SELECT id, domain || '/' || y AS y_enc, y, domain FROM d")
def encode_decode_domains(spark, sf):
    return decode_domains(encode_domains(S.supplier_cov(spark, sf)).drop("y", "domain")).select("id", "y_enc", "y", "domain")


def _vectors(spark, sf):
    return S.supplier_cov(spark, sf).withColumn("v", X.upper(F.col("cov"), 2))


@query(f"WITH {S2} SELECT id, {_r(v0='m00 - avg(m00) OVER w', v1='sqrt(2) * (m01 - avg(m01) OVER w)', v2='m11 - avg(m11) OVER w')} FROM d WINDOW w AS (PARTITION BY domain)")
def tlcenter_vectors(spark, sf):
    out = TLCenter("ASIA", vectors=True).fit_transform(_vectors(spark, sf), col="v")
    return out.select("id", *(F.round(F.col("v")[k] + SHIFT, 6).alias(f"v{k}") for k in range(3)))


@query(f"WITH {S2}, s AS (SELECT *, avg(sqrt(m00 ** 2 + 2 * m01 ** 2 + m11 ** 2)) OVER (PARTITION BY domain) AS s FROM d) SELECT id, {_r(v0='m00 / s', v1='sqrt(2) * m01 / s', v2='m11 / s')} FROM s")
def tlscale_vectors(spark, sf):
    out = TLScale("ASIA", vectors=True).fit_transform(_vectors(spark, sf), col="v")
    return out.select("id", *(F.round(F.col("v")[k] + SHIFT, 6).alias(f"v{k}") for k in range(3)))


@query(
    f"""WITH {C2}, {_REF}, l AS (SELECT id, ln({DIST["riemann"](A, B)}) AS d FROM c a, b), s AS (SELECT avg(d) AS mu, stddev_pop(d) AS sd FROM l)
SELECT id, round((d - mu) / sd, 6) AS z, CASE WHEN (d - mu) / sd < 2 THEN 1 ELSE 0 END AS prediction FROM l, s"""
)
def potato_first_pass(spark, sf):
    d = S.part_cov(spark, sf)
    out = Potato({"mean": "euclid", "distance": "riemann"}, 2, 1).fit(d).predict(d)
    return out.select("id", F.round("z", 6).alias("z"), "prediction")


@query(
    """WITH e AS (SELECT *, epoch(ts) AS s, value AS c0, (user_id % 97)::DOUBLE AS c1 FROM events),
w AS (SELECT *, unnest([floor(s / 43200) * 43200, floor(s / 43200) * 43200 - 43200]) AS start FROM e)
SELECT start::BIGINT AS start, event_type, count(*) AS n, round(var_pop(c0) + 3e-8, 6) AS m00, round(covar_pop(c0, c1) + 3e-8, 6) AS m01, round(var_pop(c1) + 3e-8, 6) AS m11 FROM w GROUP BY ALL"""
)
def windowed_cov(spark, sf):
    e = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_covariance(e, "ts", ["value", (F.col("user_id") % 97).cast("double")], ["event_type"], "1 day", "12 hours")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", *entries("cov"))


@query(f"WITH d AS (SELECT l_partkey AS id, var_pop({CH[0]}) AS v0, var_pop(l_tax * 0) AS v1, var_pop({CH[1]}) AS v2 FROM lineitem GROUP BY 1 HAVING count(*) >= 12) SELECT channel FROM (SELECT 0 AS channel, avg(v0) AS v FROM d UNION ALL SELECT 1, avg(v1) FROM d UNION ALL SELECT 2, avg(v2) FROM d) WHERE v > 0")
def flat_channels(spark, sf):
    """Channels that vary, of which one is constant."""
    d = S.covariance_by(S.table(spark, sf, "lineitem"), "l_partkey", ["l_quantity", "l_tax * 0", "100 * l_discount"])
    avg = d.agg(F.array(*(F.avg(F.col("cov")[k * 4]) for k in range(3))).alias("v"))
    return avg.select(F.posexplode("v").alias("channel", "v")).where("v > 0").select("channel")


@query(
    """WITH o AS (SELECT o_custkey AS id, o_totalprice / 1000 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
f AS (SELECT id FROM o WHERE k <= 8 GROUP BY id HAVING count(*) = 8), t AS (SELECT o.id, 8 - k AS t, v FROM o JOIN f ON o.id = f.id WHERE k <= 8)
SELECT a.id AS id, round(var_pop(a.v) + 3e-8, 6) AS m00, round(covar_pop(a.v, b.v) + 3e-8, 6) AS m01, round(var_pop(b.v) + 3e-8, 6) AS m11 FROM t a JOIN t b ON a.id = b.id AND b.t = (a.t + 7) % 8 GROUP BY a.id"""
)
def time_delay_cov(spark, sf):
    from tesserae.ml.filters import TimeDelayCovariances

    return TimeDelayCovariances(1, 2).transform(S.order_series(spark, sf)).select("id", *entries("cov"))
