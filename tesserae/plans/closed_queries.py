"""More queries with DuckDB SQL beside each: kernels, estimators and means whose results have closed forms for 2x2 matrices, or are plain sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae import functions as fn
from tesserae.frames import apply
from tesserae.kernels import geometry as G
from tesserae.ml import artifacts, composite, filters, tangent
from tesserae.operators import stats, transfer
from tesserae.operators.means import mean, mean_frame
from tesserae.operators.order import numbered
from tesserae.operators.pairs import kernel, pairwise_distance
from tesserae.plans.sql_queries import _REF, C2, CH, DIST, L2, S2, SHIFT, A, B, M, _cov_sql, chol, det, entries, eig, exp2, fro, fun, inv, log2, mid
from tesserae.sources import synthetic
from tesserae.sources import tables as S
from tesserae.streaming import drain, read_events, stream_name, windowed_covariance

QUERIES, SQL = {}, {}


def put(name, sql, f):
    f.__name__ = name
    QUERIES[name], SQL[name] = f, sql


def query(sql):
    def of(f):
        put(f.__name__, sql, f)
        return f

    return of


def _r(digits=6, **cols):
    return ", ".join(f"round(({v}) + {SHIFT}, {digits}) AS {k}" for k, v in cols.items())


def _m(x, digits=6):
    return _r(digits, **dict(zip(M, x)))


def numbers(col, names, digits=6):
    c = F.col(col) if isinstance(col, str) else col
    return [F.round(c[k] + SHIFT, digits).alias(n) for k, n in enumerate(names)]


def rounded(col, name, digits=6):
    return F.round(F.col(col) + SHIFT, digits).alias(name)


def coarse(col):
    """entries() with four digits, for results of iterations."""
    return [F.round(F.col(col)[k] + SHIFT, 4).alias(n) for k, n in zip((0, 1, 3), M)]


# algebra of symmetric 2x2 matrices in SQL


def three(t):
    return tuple(f"{t}.{k}" for k in M)


def add(x, y, a="1", b="1"):
    return tuple(f"({a} * {p} + {b} * {q})" for p, q in zip(x, y))


def dot(x, y):
    return f"({x[0]} * {y[0]} + 2 * {x[1]} * {y[1]} + {x[2]} * {y[2]})"


def sxs(s, x):
    """S X S."""
    u = (f"({s[0]} * {x[0]} + {s[1]} * {x[1]})", f"({s[0]} * {x[1]} + {s[1]} * {x[2]})", f"({s[1]} * {x[0]} + {s[2]} * {x[1]})", f"({s[1]} * {x[1]} + {s[2]} * {x[2]})")
    return f"({u[0]} * {s[0]} + {u[1]} * {s[1]})", f"({u[0]} * {s[1]} + {u[1]} * {s[2]})", f"({u[2]} * {s[1]} + {u[3]} * {s[2]})"


def exe(e, x):
    """E X E^T for a general E of four entries."""
    u = (f"({e[0]} * {x[0]} + {e[1]} * {x[1]})", f"({e[0]} * {x[1]} + {e[1]} * {x[2]})", f"({e[2]} * {x[0]} + {e[3]} * {x[1]})", f"({e[2]} * {x[1]} + {e[3]} * {x[2]})")
    return f"({u[0]} * {e[0]} + {u[1]} * {e[1]})", f"({u[0]} * {e[2]} + {u[1]} * {e[3]})", f"({u[2]} * {e[2]} + {u[3]} * {e[3]})"


def derivative(x, e, fx, fy, fd):
    """P and Q project on the eigenvectors of e's matrix, P on the larger one's: fx PXP + fy QXQ + fd (PXQ + QXP)."""
    p = (f"{e}.p00", f"{e}.p01", f"{e}.p11")
    t = dot(p, x)
    u = f"({x[0]} + {x[2]} - {t})"
    a, b = f"(({fx}) - ({fd})) * {t}", f"(({fy}) - ({fd})) * {u}"
    return (f"(({fd}) * {x[0]} + {a} * {p[0]} + {b} * (1 - {p[0]}))", f"(({fd}) * {x[1]} + {a} * {p[1]} - {b} * {p[1]})", f"(({fd}) * {x[2]} + {a} * {p[2]} + {b} * (1 - {p[2]}))")


def eigen(name, source, m=M):
    """A table with the eigenvalues x > y of source's matrix, the projector on x's vector, and the matrix itself."""
    x, y = eig(m)
    return f"{name}0 AS (SELECT *, {x} AS x, {y} AS y FROM {source}), {name} AS (SELECT *, (m00 - y) / (x - y) AS p00, m01 / (x - y) AS p01, (m11 - y) / (x - y) AS p11 FROM {name}0)"


def columns(x, prefix="m"):
    return ", ".join(f"{e} AS {prefix}{k[1:]}" for k, e in zip(M, x))


#: c: the matrices; e: their mean with its eigenvalues and projector; s, q, l: its inverse root, root and logarithm.
AT = f"""{C2}, {_REF}, {eigen("e", "b")}, s AS (SELECT {columns(fun(M, lambda v: f"(1 / sqrt({v}))"))} FROM b),
q AS (SELECT {columns(fun(M, lambda v: f"sqrt({v})"))} FROM b), l AS (SELECT {columns(log2(M))} FROM b)"""
C, E, SI, Q, LOG = three("c"), three("e"), three("s"), three("q"), three("l")
WHITE = f"w AS (SELECT id, {columns(sxs(SI, C))} FROM c, s), t AS (SELECT id, {columns(log2(M))} FROM w)"
DLOG = ("1 / e.x", "1 / e.y", "(ln(e.x) - ln(e.y)) / (e.x - e.y)")
DEXP = ("e.x", "e.y", "(e.x - e.y) / (ln(e.x) - ln(e.y))")  # of the exponential at the logarithm


def part(spark, sf):
    d = S.part_cov(spark, sf)
    return d, mean(d, "euclid")


def _at(name, sql, of, digits=6):
    def run(spark, sf):
        d, ref = part(spark, sf)
        return of(d, ref).select("id", *(entries("out") if digits == 6 else coarse("out")))

    put(name, f"WITH {AT} {sql}", run)


_at("derivative_logm", f"SELECT id, {_m(derivative(C, 'e', *DLOG))} FROM c, e", lambda d, ref: fn.at_reference(d, "ddlogm", ref))
_small = ("exp(e.x / 100)", "exp(e.y / 100)", "(exp(e.x / 100) - exp(e.y / 100)) / ((e.x - e.y) / 100)")
_at("derivative_expm", f"SELECT id, {_m(derivative(C, 'e', *_small), 4)} FROM c, e", lambda d, ref: fn.at_reference(d, "ddexpm", ref / 100), 4)


def _wasser(a, x):
    sd, tr = f"sqrt({det(a)} * {det(x)})", dot(a, x)
    tau = f"sqrt({tr} + 2 * {sd})"
    both = (f"2 * ({a[0]} * {x[0]} + {a[1]} * {x[1]})", f"({a[0]} * {x[1]} + {a[1]} * {x[2]} + {x[0]} * {a[1]} + {x[1]} * {a[2]})", f"2 * ({a[1]} * {x[1]} + {a[2]} * {x[2]})")
    return f"(({both[0]} + 2 * {sd}) / {tau})", f"({both[1]} / {tau})", f"(({both[2]} + 2 * {sd}) / {tau})"  # root of AX and its transpose


LOGMAP = {
    "euclid": f"SELECT id, {_m(add(C, E, '1', '-1'))} FROM c, e",
    "logeuclid": f"k AS (SELECT id, {columns(log2(M))} FROM c) SELECT id, {_m(derivative(add(three('k'), LOG, '1', '-1'), 'e', *DEXP))} FROM k, e, l",
    "riemann": f"{WHITE} SELECT id, {_m(M)} FROM t",
    "wasserstein": f"SELECT id, {_m(add(_wasser(E, C), E, '1', '-2'))} FROM c, e",
}
for _metric, _sql in LOGMAP.items():
    _at(f"log_map_{_metric}", (", " if _sql[0] != "S" else "") + _sql, lambda d, ref, m=_metric: fn.at_reference(d, "log_map", ref, m))

X = add(C, E, "0.1", "-0.1")  # a tangent vector
_solve = derivative(X, "e", "1 / (2 * e.x)", "1 / (2 * e.y)", "1 / (e.x + e.y)")
EXPMAP = {
    "euclid": f"SELECT id, {_m(add(X, E))} FROM c, e",
    "logeuclid": f", k AS (SELECT id, {columns(add(derivative(X, 'e', *DLOG), LOG))} FROM c, e, l) SELECT id, {_m(exp2(M))} FROM k",
    "riemann": f", k AS (SELECT id, {columns(add(C, E, '0.001', '-0.001'))} FROM c, e), h AS (SELECT id, {columns(exp2(M))} FROM k) SELECT id, {_m(sxs(Q, three('h')))} FROM h, q",
    "wasserstein": f", k AS (SELECT id, {columns(_solve)}, {columns(X, 'x')} FROM c, e) SELECT id, {_m(add(add(E, ('k.x00', 'k.x01', 'k.x11')), sxs(three('k'), E)))} FROM k, e",
}


def _exp_map(d, ref, metric):
    by = 0.001 if metric == "riemann" else 0.1
    t = apply(d, ["cov"], {"t": "matrix"}, lambda x: (x - ref) * by, ["id"])
    return fn.at_reference(t, "exp_map", ref, metric, "t")


for _metric, _sql in EXPMAP.items():
    _at(f"exp_map_{_metric}", _sql, lambda d, ref, m=_metric: _exp_map(d, ref, m))

# logarithmic and exponential map, and tangent vectors, there and back
for _metric in ("euclid", "logeuclid", "riemann", "logchol", "wasserstein"):
    _at(f"log_exp_map_{_metric}", f"SELECT id, {_m(M, 4)} FROM c", lambda d, ref, m=_metric: fn.at_reference(fn.at_reference(d, "log_map", ref, m, out="t").select("id", "t"), "exp_map", ref, m, "t"), 4)
for _metric in ("euclid", "logeuclid", "riemann"):
    _at(f"untangent_space_{_metric}", f"SELECT id, {_m(M, 4)} FROM c", lambda d, ref, m=_metric: fn.at_reference(fn.at_reference(d, "tangent_space", ref, m, out="t").select("id", "t"), "untangent_space", ref, m, "t"), 4)


def _tangent(metric, sql):
    def run(spark, sf):
        d, ref = part(spark, sf)
        return fn.at_reference(d, "tangent_space", ref, metric).select("id", *numbers("out", ["t0", "t1", "t2"]))

    put(f"tangent_space_{metric}_2x2", f"WITH {AT}, {sql} SELECT id, {_r(t0='m00', t1='sqrt(2) * m01', t2='m11')} FROM t", run)


_tangent("riemann", WHITE)
_tangent("logeuclid", f"k AS (SELECT id, {columns(log2(M))} FROM c), t AS (SELECT id, {columns(derivative(add(three('k'), LOG, '1', '-1'), 'e', *DEXP))} FROM k, e, l)")


def _inner(metric, sql):
    """Inner product of the matrix and its difference from the mean, and the matrix' norm, as tangent vectors at the mean."""

    def run(spark, sf):
        d, ref = part(spark, sf)
        d = apply(d, ["cov"], {"t": "matrix"}, lambda x: x - ref, ["id", "cov"])
        both = fn.inner_product(fn.at_reference(d, "norm", ref, metric, out="norm"), "cov", "t", ref, metric, "product")
        return both.select("id", rounded("product", "product", 4), rounded("norm", "norm", 4))

    put(f"inner_product_norm_{metric}", f"WITH {AT}, {sql}", run)


_x, _y = sxs(SI, C), sxs(SI, add(C, E, "1", "-1"))
_k, _h = three("k"), ("k.h00", "k.h01", "k.h11")
_dots = f"SELECT id, {_r(4, product=dot(_k, _h), norm=f'sqrt({dot(_k, _k)})')} FROM k"
_inner("euclid", f"k AS (SELECT id, {columns(C)}, {columns(add(C, E, '1', '-1'), 'h')} FROM c, e) {_dots}")
_inner("riemann", f"k AS (SELECT id, {columns(_x)}, {columns(_y, 'h')} FROM c, e, s) {_dots}")
_inner("logeuclid", f"k AS (SELECT id, {columns(derivative(C, 'e', *DLOG))}, {columns(derivative(add(C, E, '1', '-1'), 'e', *DLOG), 'h')} FROM c, e) {_dots}")

HARMONIC = f"hi AS (SELECT {', '.join(f'avg({x}) AS {k}' for k, x in zip(M, inv(M)))} FROM c), hm AS (SELECT {columns(inv(M))} FROM hi)"


def _transport(metric, sql):
    """From the arithmetic to the harmonic mean."""

    def run(spark, sf):
        d, ref = part(spark, sf)
        return fn.at_reference(d, "transport", ref, metric, to=mean(d, "harmonic")).select("id", *entries("out"))

    put(f"transport_{metric}", f"WITH {AT}, {HARMONIC}{sql}", run)


_transport("euclid", f" SELECT id, {_m(M)} FROM c")
_hm, _i = three("hm"), inv(E)
_ba = [f"({p} * {x} + {q} * {y})" for p, q in ((_hm[0], _hm[1]), (_hm[1], _hm[2])) for x, y in ((_i[0], _i[1]), (_i[1], _i[2]))]
_sd = f"sqrt({det(_hm)} / {det(E)})"
_root = ", ".join(f"({v}{f' + {_sd}' if k in (0, 3) else ''}) / sqrt({_ba[0]} + {_ba[3]} + 2 * {_sd}) AS r{k}" for k, v in enumerate(_ba))
_transport("riemann", f", r AS (SELECT {_root} FROM hm, e) SELECT id, {_m(exe(('r.r0', 'r.r1', 'r.r2', 'r.r3'), C))} FROM c, r")
_dexp2 = tuple(v.replace("e.", "f.") for v in DEXP)
_transport("logeuclid", f", {eigen('f', 'hm')}, k AS (SELECT id, {columns(derivative(C, 'e', *DLOG))} FROM c, e) SELECT id, {_m(derivative(three('k'), 'f', *_dexp2))} FROM k, f")


def _chol_transport():
    p, q = chol(E), chol(_hm)
    # P^-1 X P^-T with half its diagonal, its strict part as it is
    z00 = f"({C[0]} / ({p[0]} * {p[0]}))"
    z10 = f"(({C[1]} / {p[0]} - {p[1]} * {z00}) / {p[2]})"
    z11 = f"(({C[2]} - 2 * {p[1]} * {p[2]} * {z10} - {p[1]} * {p[1]} * {z00}) / ({p[2]} * {p[2]}))"
    s = (f"({p[0]} * {z00} / 2)", f"({p[1]} * {z00} / 2 + {p[2]} * {z10})", f"({p[2]} * {z11} / 2)")
    t = (f"({q[0]} / {p[0]} * {s[0]})", s[1], f"({q[2]} / {p[2]} * {s[2]})")
    return f"(2 * {q[0]} * {t[0]})", f"({q[0]} * {t[1]} + {q[1]} * {t[0]})", f"(2 * ({q[1]} * {t[1]} + {q[2]} * {t[2]}))"


_transport("logchol", f" SELECT id, {_m(_chol_transport())} FROM c, e, hm")


def _between(name, metric, x):
    """A quarter of the way from each matrix to the mean."""

    def run(spark, sf):
        d, ref = part(spark, sf)
        return apply(d, ["cov"], {"out": "matrix"}, lambda m: G.geodesic(m, ref[None], 0.25, metric), ["id"]).select("id", *entries("out"))

    put(name, f"WITH {AT} {x}", run)


_w = _wasser(C, E)
_between("geodesic_wasserstein", "wasserstein", f"SELECT id, {_m(add(add(C, E, '0.5625', '0.0625'), _w, '1', '0.1875'))} FROM c, e")
_tr, _dt = f"(({E[0]} * {C[2]} + {E[2]} * {C[0]} - 2 * {E[1]} * {C[1]}) / {det(C)})", f"({det(E)} / {det(C)})"
_big = f"(({_tr} + sqrt(greatest({_tr} * {_tr} - 4 * {_dt}, 0))) / 2)"
_between(
    "geodesic_thompson", "thompson",
    f", g AS (SELECT c.*, {_big} AS hi, {_dt} / {_big} AS lo FROM c, e) SELECT id, {_m(add(E, three('g'), '((hi ** 0.25 - lo ** 0.25) / (hi - lo))', '((hi * lo ** 0.25 - lo * hi ** 0.25) / (hi - lo))'))} FROM g, e",
)


# means of two matrices: the geometric one by many names, and that of Wasserstein

PAIR = f"WITH {C2}, n AS (SELECT *, id // 2 AS key FROM c), z AS (SELECT key FROM n GROUP BY key HAVING count(*) = 2), a AS (SELECT n.* FROM n JOIN z ON n.key = z.key WHERE id % 2 = 0), b AS (SELECT n.* FROM n JOIN z ON n.key = z.key WHERE id % 2 = 1)"
GEOMETRIC = f"{PAIR} SELECT a.key::VARCHAR AS key, {_m(mid(A, B), 4)} FROM a JOIN b ON a.key = b.key WHERE a.key % 20 = 0"


def _pairs(metric, sql=GEOMETRIC, **kw):
    def run(spark, sf):
        d = S.part_cov(spark, sf).withColumn("k", F.floor(F.col("id") / 2).cast("long")).where("k % 20 = 0").select("id", "k", "cov")
        two = d.groupBy("k").agg(F.count("*").alias("n")).where("n = 2").select("k")
        return mean_frame(d.join(two, "k"), metric, by="k", **kw).select("key", *coarse("mean"))

    put(f"mean_{metric}_of_two", sql, run)


for _metric in ("riemann", "logdet"):
    _pairs(_metric, tol=1e-11, maxiter=200)
for _metric in ("alm", "bmp", "cheap"):
    _pairs(_metric)
_pairs("power", f"{PAIR} SELECT a.key::VARCHAR AS key, {_m(add(A, B, '0.5', '0.5'), 4)} FROM a JOIN b ON a.key = b.key WHERE a.key % 20 = 0", p=1)
_pairs("wasserstein", f"{PAIR} SELECT a.key::VARCHAR AS key, {_m(add(add(A, B, '0.25', '0.25'), _wasser(A, B), '1', '0.25'), 4)} FROM a JOIN b ON a.key = b.key WHERE a.key % 20 = 0", tol=1e-12, maxiter=500)


@query(f"WITH {L2}, k AS (SELECT y, {columns(fun(M, lambda v: f'sqrt({v})'))} FROM d), g AS (SELECT y AS key, avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM k GROUP BY y) SELECT key, {_m(('m00 * m00 + m01 * m01', 'm01 * (m00 + m11)', 'm01 * m01 + m11 * m11'))} FROM g")
def mean_poweuclid(spark, sf):
    return mean_frame(S.part_labels(spark, sf), "poweuclid", by="y", p=0.5).select("key", *entries("mean"))


# distances, kernels, scores


def _half(m):
    return fun(m, lambda v: f"sqrt({v})")


@query(f"WITH {AT}, k AS (SELECT id, {columns(_half(M))} FROM c) SELECT id, {_r(distance=f'2 * {fro(three("k"), Q)}')} FROM k, q")
def dist_poweuclid(spark, sf):
    d, ref = part(spark, sf)
    return fn.distance(d, "cov", ref, "poweuclid", p=0.5).select("id", rounded("distance", "distance"))


@query(f"WITH {AT}, r AS (SELECT id, {DIST['riemann'](C, E)} AS a, {fro(C, E)} AS b FROM c, e) SELECT id, {_r(d0='a', d1='b')} FROM r")
def distances_to_references(spark, sf):
    """To several references at once, by the numpy kernels."""
    d, ref = part(spark, sf)
    two = fn.distances(fn.distances(d, ref[None], "riemann", out="r"), ref[None], "euclid", out="f")
    return two.select("id", F.round(F.col("r")[0] + SHIFT, 6).alias("d0"), F.round(F.col("f")[0] + SHIFT, 6).alias("d1"))


SUP = f"{S2}, b AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM d), s AS (SELECT {columns(fun(M, lambda v: f'(1 / sqrt({v}))'))} FROM b), w AS (SELECT id, {columns(sxs(SI, three('d')))} FROM d, s), t AS (SELECT id, {columns(log2(M))} FROM w)"


@query(f"WITH {SUP} SELECT a.id AS i, b.id AS j, {_r(k=dot(A, B))} FROM t a, t b")
def kernel_riemann(spark, sf):
    d = S.supplier_cov(spark, sf)
    return kernel(d, metric="riemann", ref=mean(d, "euclid")).select("i", "j", rounded("k", "k"))


@query(f"WITH {S2}, p AS (SELECT {DIST['thompson'](A, B)} AS d FROM d a JOIN d b ON a.id < b.id) SELECT count(*) AS pairs, {_r(mean='avg(d)', farthest='max(d)')} FROM p")
def pairwise_summary(spark, sf):
    p = pairwise_distance(S.supplier_cov(spark, sf), metric="thompson")
    return p.agg(F.count("*").alias("pairs"), F.round(F.avg("d") + SHIFT, 6).alias("mean"), F.round(F.max("d") + SHIFT, 6).alias("farthest"))


@query(f"SELECT vec_id, {_r(distance='sqrt((v0 * v0 - v0 * v1 + 2 * v1 * v1) / 1.75)', squared='(v0 * v0 - v0 * v1 + 2 * v1 * v1) / 1.75')} FROM (SELECT vec_id, embedding[1]::DOUBLE - 0.1 AS v0, embedding[2]::DOUBLE + 0.2 AS v1 FROM embeddings)")
def mahalanobis(spark, sf):
    d = S.table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"))
    c, at = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([0.1, -0.2])
    both = fn.mahalanobis(fn.mahalanobis(d, "v", c, at), "v", c, at, True, "squared")
    return both.select("vec_id", rounded("distance", "distance"), rounded("squared", "squared"))


_CLASS = f"""WITH {S2}, k AS (SELECT *, CASE WHEN domain = 'ASIA' THEN 'ASIA' ELSE 'other' END AS g FROM d), m AS (SELECT g, count(*) AS n, avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM k GROUP BY g),
v AS (SELECT k.g, {fro(three("k"), three("m"))} ** 2 AS d2 FROM k JOIN m ON k.g = m.g), g AS (SELECT avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM d)"""


def _observed(mode):
    def run(spark, sf):
        d = S.supplier_cov(spark, sf).withColumn("g", F.when(F.col("domain") == "ASIA", "ASIA").otherwise("other"))
        test = stats.PermutationDistance(3, "euclid", mode)
        test.test(d, "g")
        return spark.createDataFrame([(float(test.scores_[0]),)], "score double").select(F.round(F.col("score") + SHIFT, 6).alias("score"))

    return run


put("t_score_euclid", f"{_CLASS} SELECT {_r(score=f'(SELECT {fro(A, B)} FROM m a, m b WHERE a.g < b.g) / sqrt((SELECT sum(s) FROM (SELECT avg(d2) AS s FROM v GROUP BY g)))')}", _observed("ttest"))
put("f_score_euclid", f"{_CLASS} SELECT {_r(score=f'(SELECT sum(n * {fro(three("m"), three("g"))} ** 2) FROM m, g) / ((SELECT sum(d2) FROM v) / ((SELECT count(*) FROM k) - 2))')}", _observed("ftest"))
put("pseudo_f_euclid", f"""{_CLASS}, p AS (SELECT a.g AS ga, b.g AS gb, {fro(A, B)} ** 2 AS d2 FROM k a JOIN k b ON a.id < b.id), tot AS (SELECT sum(d2) / (SELECT count(*) FROM k) AS t FROM p),
w AS (SELECT sum(s / n) AS w FROM (SELECT ga, sum(d2) AS s FROM p WHERE ga = gb GROUP BY ga) JOIN m ON m.g = ga) SELECT {_r(score="(t - w) / (w / ((SELECT count(*) FROM k) - 2))")} FROM tot, w""", _observed("pairwise"))


# matrices that lack something

_low = f"""WITH {C2}, h AS (SELECT id, m00 - OFF AS m00, m01 - OFF AS m01, m11 - OFF AS m11 FROM c), v AS (SELECT *, (m00 + m11 + r) / 2 AS x, (m00 + m11 - r) / 2 AS y FROM (SELECT *, sqrt((m00 - m11) ** 2 + 4 * m01 * m01) AS r FROM h)),
f AS (SELECT *, CASE WHEN y > 0 THEN x ELSE greatest(x, 0) + 1e-6 END AS fx, CASE WHEN y > 0 THEN y ELSE 1e-6 END AS fy, (m00 - y) / (x - y) AS p00, m01 / (x - y) AS p01, (m11 - y) / (x - y) AS p11 FROM v)"""


@query(f"{_low.replace('OFF', '20')} SELECT id, {_m(('fx * p00 + fy * (1 - p00)', '(fx - fy) * p01', 'fx * p11 + fy * (1 - p11)'), 4)} FROM f")
def nearest_spd(spark, sf):
    d = S.part_cov(spark, sf).withColumn("cov", F.transform("cov", lambda v: v - 20))
    return fn.validate(d, mode="repair").select("id", *coarse("cov"))


@query(f"{_low.replace('OFF', '7')} SELECT id, {_m(M)} FROM f WHERE y > 0")
def validated(spark, sf):
    """What isn't positive definite is dropped."""
    d = S.part_cov(spark, sf).withColumn("cov", F.transform("cov", lambda v: v - 7))
    return fn.validate(d, mode="drop").select("id", *entries("cov"))


@query(f"WITH c AS ({_cov_sql(p=4)}) SELECT id, {', '.join(f'CASE WHEN id % 3 = 0 AND id % 4 = {k} THEN 0 ELSE 1 END AS k{k}' for k in range(4))} FROM c")
def masks_from_nan(spark, sf):
    return fn.nan_masks(with_gaps(spark, sf)).select("id", *(F.col("keep")[k].alias(f"k{k}") for k in range(4)))


def with_gaps(spark, sf):
    """4x4 matrices of which every third lacks one channel."""
    d = S.part_cov(spark, sf, 4)

    def hole(x, i):
        out = x.copy()
        for k, n in enumerate(i):
            if n % 3 == 0:
                out[k, n % 4], out[k, :, n % 4] = np.nan, np.nan
        return out

    return apply(d.withColumn("i", F.col("id")), ["cov", "i"], {"gaps": "matrix"}, hole, ["id"]).withColumnRenamed("gaps", "cov")


_KINDS = ("sym", "skew_sym", "hankel", "real", "hermitian", "pos_def", "pos_semi_def", "spd", "spsd", "hpd", "hpsd")
_PD, _SYM = f"(m00 + m11 > 0 AND {det(M)} > 0)", "(id % 3 <> 0)"


@query(
    f"""WITH {C2}, h AS (SELECT id, m00 - id % 60 AS m00, m01, m11 - id % 60 AS m11 FROM c), v AS (SELECT *, (m00 + m11) / 2 - sqrt(((m00 - m11) / 2) ** 2 + CASE WHEN id % 3 = 0 THEN m01 * (m01 + 1) ELSE m01 * m01 END) AS y FROM h WHERE id % 3 <> 0 OR m01 > 0)
SELECT id, {_SYM} AS sym, false AS skew_sym, {_SYM} AS hankel, true AS "real", {_SYM} AS hermitian, y > 0 AS pos_def, y >= 0 AS pos_semi_def, {_SYM} AND y > 0 AS spd, {_SYM} AND y >= 0 AS spsd, {_SYM} AND y > 0 AS hpd, {_SYM} AND y >= 0 AS hpsd FROM v"""
)
def predicates(spark, sf):
    """All predicates, on matrices of which some aren't definite and every third isn't symmetric."""
    d = S.part_cov(spark, sf).where("id % 3 <> 0 or cov[1] > 0")

    def spoil(x, i):
        out = x - (i % 60)[:, None, None] * np.eye(2)
        out[i % 3 == 0, 0, 1] += 1
        return out

    d = apply(d.withColumn("i", F.col("id")), ["cov", "i"], {"x": "matrix"}, spoil, ["id"])
    for k in _KINDS:
        d = fn.predicate(d, k, "x", k)
    return d.select("id", *_KINDS)


# estimators and filters

_EPOCH = """x AS (SELECT vec_id AS id, unnest(range(1, 17)) AS t, embedding FROM embeddings), u AS (SELECT id, embedding[t]::DOUBLE AS x0, embedding[t + 16]::DOUBLE AS x1 FROM x),
y AS (SELECT id, x0 - avg(x0) OVER (PARTITION BY id) AS y0, x1 - avg(x1) OVER (PARTITION BY id) AS y1 FROM u),
c AS (SELECT id, avg(y0 * y0) AS m00, avg(y0 * y1) AS m01, avg(y1 * y1) AS m11, avg((y0 * y0 + y1 * y1) ** 2) AS fourth, sum(y0 * y0 * y1 * y1) AS cross4 FROM y GROUP BY id),
k AS (SELECT *, (m00 + m11) / 2 AS mu, m00 * m00 + 2 * m01 * m01 + m11 * m11 AS f2 FROM c)"""


def _estimator(name, share, off="(1 - s) * m01", diagonal="(1 - s) * {0} + s * mu"):
    def run(spark, sf):
        e = S.embedding_epochs(spark, sf).select("id", F.slice("x", 1, 32).alias("x"))
        return fn.covariances(e, 2, name).select("id", *entries("cov"))

    put(f"cov_{name}", f"WITH {_EPOCH}, j AS (SELECT *, {share} AS s FROM k) SELECT id, {_m((diagonal.format('m00'), off, diagonal.format('m11')))} FROM j", run)


_delta, _beta = "((f2 - 2 * mu * mu) / 2)", "((fourth - f2) / 32)"
_estimator("lwf", f"CASE WHEN {_delta} > 0 THEN least({_beta}, {_delta}) / {_delta} ELSE 0 END")
_estimator("oas", "least((f2 / 4 + mu * mu) / (17 * (f2 / 4 - mu * mu / 2)), 1)")
_estimator("sch", "least(greatest((cross4 - 16 * m01 * m01) * 16 / 3375.0 / (m01 * m01 * 256 / 225.0), 0), 1)", "(1 - s) * m01 * 16 / 15.0", "{0} * 16 / 15.0")

_PAIRS8 = """v AS (SELECT vec_id AS id, unnest(range(0, 8)) AS t, embedding FROM embeddings), u AS (SELECT id, t, ch, embedding[ch * 8 + t + 1]::DOUBLE AS x FROM v, (SELECT unnest(range(0, 3)) AS ch)),
p AS (SELECT a.id, a.ch AS i, b.ch AS j, sum(a.x * b.x) AS dot, sum((a.x - b.x) ** 2) AS d2, sum(abs(a.x - b.x)) AS d1, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb FROM u a JOIN u b ON a.id = b.id AND a.t = b.t GROUP BY ALL)"""
for _k, _f in {"linear": "dot", "poly": "(dot / 8 + 1) ** 3", "rbf": "exp(-d2 / 8)", "laplacian": "exp(-d1 / 8)", "cosine": "dot / sqrt(aa * bb)"}.items():

    def _run(spark, sf, k=_k):
        out = filters.Kernels(8, k).transform(S.embedding_epochs(spark, sf)).select("id", "cov")
        return out.select("id", *(F.round(F.col("cov")[8 * i + j] + SHIFT, 6).alias(f"k{i}{j}") for i in range(3) for j in range(3)))

    put(f"channel_kernel_{_k}", f"WITH {_PAIRS8}, o AS (SELECT id, i, j, {_f} AS v FROM p) SELECT id, {_r(**{f'k{i}{j}': f'max(v) FILTER (i = {i} AND j = {j})' for i in range(3) for j in range(3)})} FROM o GROUP BY id", _run)

# Welch spectra of two channels: a sum over samples for every window and frequency
_SPECTRA = """w AS (SELECT unnest(range(0, 3)) AS win), f AS (SELECT unnest(range(0, 9)) AS freq_bin), n AS (SELECT unnest(range(0, 16)) AS t), g AS (SELECT t, 0.5 - 0.5 * cos(2 * pi() * t / 15) AS taper FROM n),
z AS (SELECT vec_id AS id, win, freq_bin, embedding[win * 8 + t + 1]::DOUBLE * taper AS x0, embedding[32 + win * 8 + t + 1]::DOUBLE * taper AS x1, cos(2 * pi() * freq_bin * t / 16) AS co, -sin(2 * pi() * freq_bin * t / 16) AS si FROM embeddings, w, f, g),
s AS (SELECT id, win, freq_bin, sum(x0 * co) AS a0, sum(x0 * si) AS b0, sum(x1 * co) AS a1, sum(x1 * si) AS b1 FROM z GROUP BY ALL),
k AS (SELECT id, freq_bin, (CASE WHEN freq_bin BETWEEN 1 AND 7 THEN 2 ELSE 1 END) / 3.0 / (SELECT sum(taper * taper) FROM g) AS u, sum(a0 * a0 + b0 * b0) AS p0, sum(a1 * a1 + b1 * b1) AS p1, sum(a0 * a1 + b0 * b1) AS re, sum(b0 * a1 - a0 * b1) AS im FROM s GROUP BY ALL)"""


@query(f"WITH {_SPECTRA} SELECT id, freq_bin, {_r(s00='u * p0', s11='u * p1', re01='u * re', im01='u * im')} FROM k")
def cross_spectra(spark, sf):
    out = filters.CrossSpectra(2, 16, 0.5, fs=64).transform(S.embedding_epochs(spark, sf).select("id", "x"))
    return out.select("id", "freq_bin", *(F.round(F.col(c)[k] + SHIFT, 6).alias(n) for c, k, n in (("re", 0, "s00"), ("re", 3, "s11"), ("re", 1, "re01"), ("im", 1, "im01"))))


@query(f"WITH {_SPECTRA} SELECT id, freq_bin, {_r(s00='u * p0', s01='u * re', s11='u * p1')} FROM k")
def cospectra(spark, sf):
    out = filters.CoSpectra(2, 16, 0.5, fs=64).transform(S.embedding_epochs(spark, sf).select("id", "x"))
    return out.select("id", "freq_bin", *(F.round(F.col("cov")[k] + SHIFT, 6).alias(n) for k, n in ((0, "s00"), (1, "s01"), (3, "s11"))))


for _coh, _f in {"ordinary": "(re * re + im * im) / (p0 * p1)", "instantaneous": "re * re / (p0 * p1)", "imaginary": "im * im / (p0 * p1)", "lagged": "CASE WHEN freq_bin % 8 = 0 THEN 0 ELSE im * im / (p0 * p1 - re * re) END"}.items():

    def _run(spark, sf, coh=_coh):
        out = filters.Coherences(2, 16, 0.5, fs=64, coh=coh).transform(S.embedding_epochs(spark, sf).select("id", "x"))
        return out.select("id", "freq_bin", F.round(F.col("cov")[1] + SHIFT, 5).alias("c01"))

    put(f"coherence_{_coh}", f"WITH {_SPECTRA} SELECT id, freq_bin, {_r(5, c01=_f)} FROM k", _run)


@query(f"WITH c AS ({_cov_sql(p=4)}) SELECT id, {_r(f0='ln(m00)', f1='ln(m00 + 2 * m01 + m11)', g01='m00 + m01')} FROM c")
def bilinear_filter(spark, sf):
    d, w = S.part_cov(spark, sf, 4), np.array([[1.0, 0, 0, 0], [1, 1, 0, 0]])
    both = filters.BilinearFilter(w).transform(filters.BilinearFilter(w, log=True).transform(d, out="f"), out="g")
    return both.select("id", *numbers("f", ["f0", "f1"]), F.round(F.col("g")[1] + SHIFT, 6).alias("g01"))


@query(
    """WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS c0, (user_id % 97)::DOUBLE AS c1 FROM events),
w AS (SELECT *, unnest(range(greatest(0, ceil((t - 63) / 32.0))::BIGINT, t // 32 + 1)) AS win FROM e)
SELECT event_type, win::INT AS win, round(var_pop(c0) + 3e-8, 6) AS m00, round(covar_pop(c0, c1) + 3e-8, 6) AS m01, round(var_pop(c1) + 3e-8, 6) AS m11 FROM w GROUP BY ALL HAVING count(*) = 64"""
)
def sliding_covariances(spark, sf):
    e = S.table(spark, sf, "events").select("event_type", "ts", "event_id", "value", (F.col("user_id") % 97).cast("double").alias("u"))
    rows = numbered(e, ["event_type"], F.date_trunc("day", "ts"), ["ts", "event_id"])
    return filters.sliding_covariances(rows, "event_type", "t", ["value", "u"], 64, 32).select("event_type", "win", *entries("cov"))


@query(f"WITH {AT} SELECT id, {_r(m00=f'{dot(("e.p00", "e.p01", "e.p11"), C)} / e.x', m11=f'({C[0]} + {C[2]} - {dot(("e.p00", "e.p01", "e.p11"), C)}) / e.y', product=f'{det(C)} / {det(E)}')} FROM c, e")
def whitening_euclid(spark, sf):
    """In the order of the mean's eigenvalues; the sign of the other entries is open, their square follows from the determinant."""
    d = S.part_cov(spark, sf)
    out = tangent.Whitening("euclid").fit(d).transform(d)
    c = F.col("cov")
    return out.select("id", F.round(c[0] + SHIFT, 6).alias("m00"), F.round(c[3] + SHIFT, 6).alias("m11"), F.round(c[0] * c[3] - c[1] * c[2] + SHIFT, 6).alias("product"))


@query(f"WITH {C2} SELECT id, {_m(M)} FROM c")
def whitening_inverse(spark, sf):
    d = S.part_cov(spark, sf)
    w = tangent.Whitening("euclid").fit(d)
    return w.inverse_transform(w.transform(d)).select("id", *entries("cov"))


_DOM = f"""WITH {L2}, k AS (SELECT d.id, d.m00, d.m01, d.m11, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS domain FROM d JOIN part ON p_partkey = d.id),
g AS (SELECT domain, avg(m00) AS m00, avg(m01) AS m01, avg(m11) AS m11 FROM k GROUP BY domain), s AS (SELECT domain, {columns(fun(M, lambda v: f"(1 / sqrt({v}))"))} FROM g)"""


def domains(spark, sf):
    """Parts by price class, in the domain of their size."""
    d = S.part_labels(spark, sf)
    return d.select("id", "cov", F.when(F.col("target") > 950, "dear").otherwise("cheap").alias("y"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("domain"))


@query(f"{_DOM} SELECT id, k.domain AS domain, {_m(sxs(SI, three('k')))} FROM k JOIN s ON k.domain = s.domain")
def tlcenter_euclid(spark, sf):
    return transfer.TLCenter("big", "euclid").fit_transform(domains(spark, sf)).select("id", "domain", *entries("cov"))


@query(
    f"""{_DOM}, w AS (SELECT id, k.domain AS domain, {columns(sxs(SI, three("k")))} FROM k JOIN s ON k.domain = s.domain), l AS (SELECT id, domain, {columns(log2(M))} FROM w),
f AS (SELECT domain, sqrt(1 / avg({dot(M, M)})) AS f FROM l GROUP BY domain), h AS (SELECT id, l.domain, f * m00 AS m00, f * m01 AS m01, f * m11 AS m11 FROM l JOIN f ON l.domain = f.domain) SELECT id, domain, {_m(exp2(M))} FROM h"""
)
def tlscale_centered(spark, sf):
    """Data centred by the arithmetic means, then stretched around the identity."""
    d = transfer.TLCenter("big", "euclid").fit_transform(domains(spark, sf))
    return transfer.TLScale("big", centered_data=True).fit_transform(d).select("id", "domain", *entries("cov"))


@query(f"WITH {L2} SELECT id, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS domain, {_m(M)} FROM d JOIN part ON p_partkey = d.id")
def tldummy(spark, sf):
    return transfer.TLDummy().fit_transform(domains(spark, sf)).select("id", "domain", *entries("cov"))


@query(f"""{_DOM}, f AS (SELECT domain, count(*) AS n FROM k GROUP BY domain), b AS (SELECT n FROM f WHERE domain = 'big'), s5 AS (SELECT unnest(range(0, 5)) AS fold)
SELECT count(*) AS folds, (SELECT count(*) FROM k) * 5 AS "rows", sum(b.n) / 5 AS tested, (SELECT n FROM f WHERE domain = 'small') * 5 AS sources FROM s5, b""".replace("sum(b.n) / 5", "max(b.n)"))
def tl_split(spark, sf):
    """Every fold tests its part of the target, all parts make the whole of it, and all sources are in every training set."""
    both = None
    for k, (train, test) in enumerate(transfer.TLSplitter("big", 5).split(domains(spark, sf))):
        x = train.select(F.lit(k).alias("fold"), F.lit(0).alias("test"), "domain").union(test.select(F.lit(k), F.lit(1), "domain"))
        both = x if both is None else both.union(x)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("rows"), n(F.col("test") == 1).alias("tested"), n((F.col("test") == 0) & (F.col("domain") == "small")).alias("sources"))


@query(
    f"""WITH c AS ({_cov_sql(p=4)}), g AS (SELECT {", ".join(f"avg({k}) AS {k}" for k in ("m00", "m01", "m11", "m22", "m23", "m33"))} FROM c),
z AS (SELECT c.id, ln({DIST["riemann"](C, three("g"))}) AS a, ln({DIST["riemann"](("c.m22", "c.m23", "c.m33"), ("g.m22", "g.m23", "g.m33"))}) AS b FROM c, g)
SELECT id, {_r(z0="(a - (SELECT avg(a) FROM z)) / (SELECT stddev_pop(a) FROM z)", z1="(b - (SELECT avg(b) FROM z)) / (SELECT stddev_pop(b) FROM z)")} FROM z"""
)
def potato_field_first_pass(spark, sf):
    d = S.part_cov(spark, sf, 4)
    two = d.select("id", F.array(*(F.col("cov")[k] for k in (0, 1, 4, 5))).alias("a"), F.array(*(F.col("cov")[k] for k in (10, 11, 14, 15))).alias("b"))
    out = artifacts.PotatoField(2, metric={"mean": "euclid", "distance": "riemann"}, n_iter_max=1).fit(two, ["a", "b"]).transform(two, ["a", "b"])
    return out.select("id", *numbers("z", ["z0", "z1"]))


@query(
    """WITH e AS (SELECT *, epoch(ts) AS s, value AS c0, (user_id % 97)::DOUBLE AS c1 FROM events),
w AS (SELECT *, unnest([floor(s / 43200) * 43200, floor(s / 43200) * 43200 - 43200]) AS start FROM e)
SELECT start::BIGINT AS start, event_type, count(*) AS n, round(var_pop(c0) + 3e-8, 6) AS m00, round(covar_pop(c0, c1) + 3e-8, 6) AS m01, round(var_pop(c1) + 3e-8, 6) AS m11 FROM w GROUP BY ALL"""
)
def stream_windowed_cov(spark, sf):
    w = windowed_covariance(read_events(spark, sf), "ts", ["value", (F.col("user_id") % 97).cast("double")], ["event_type"], "1 day", "12 hours", "1 day")
    return drain(w, stream_name("windows"), "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", *entries("cov"))


@query("""WITH k AS (SELECT CASE WHEN p_retailprice > 950 THEN 'dear' ELSE 'cheap' END AS y FROM part JOIN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 12) ON l_partkey = p_partkey)
SELECT y, (SELECT max(n) FROM (SELECT count(*) AS n FROM k GROUP BY y)) AS n FROM k GROUP BY y""")
def random_over_sampler(spark, sf):
    """Afterwards, every class has as many rows as the largest."""
    return synthetic.random_over_sample(domains(spark, sf).select("id", "cov", "y")).groupBy("y").agg(F.count("*").alias("n"))


# composites

_HYBRID = _PAIRS8.replace("range(0, 3)", "range(0, 4)")


@query(f"WITH {_HYBRID}, o AS (SELECT id, i, j, CASE WHEN i < 2 THEN dot ELSE exp(-d2 / 8) END AS v FROM p) SELECT id, {_r(k00='max(v) FILTER (i = 0 AND j = 0)', k01='0.9 * max(v) FILTER (i = 0 AND j = 1)', k23='max(v) FILTER (i = 2 AND j = 3)')}, 0.0 AS k12 FROM o GROUP BY id".replace("max(v) FILTER (i = 0 AND j = 0)", "0.9 * max(v) FILTER (i = 0 AND j = 0) + 0.05 * (max(v) FILTER (i = 0 AND j = 0) + max(v) FILTER (i = 1 AND j = 1))"))
def hybrid_blocks(spark, sf):
    e = S.embedding_epochs(spark, sf).select("id", "x")
    out = composite.HybridBlocks(8, [2, 6], ["linear", "rbf"], [0.1, 0]).fit().transform(e)
    c = lambda i, j: F.round(F.col("cov")[8 * i + j] + SHIFT, 6).alias(f"k{i}{j}")
    return out.select("id", c(0, 0), c(0, 1), c(2, 3), F.col("cov")[8 + 2].alias("k12"))


_PIXELS = "px AS (SELECT (vec_id // 25)::INT AS \"row\", (vec_id % 25)::INT AS col, embedding[1]::DOUBLE AS v0, embedding[2]::DOUBLE AS v1 FROM embeddings)"


def pixels(spark, sf):
    """The first two entries of the embeddings as an image of 25 columns."""
    e = S.table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"))


@query(f"""WITH {_PIXELS}, w AS (SELECT a."row", a.col, b."row" - a."row" AS dr, b.col - a.col AS dc, b.v0, b.v1 FROM px a JOIN px b ON b."row" BETWEEN a."row" AND a."row" + 4 AND b.col BETWEEN a.col AND a.col + 4 WHERE a."row" % 2 = 0 AND a.col % 2 = 0)
SELECT "row", col, {_r(x1='max(v0) FILTER (dr = 0 AND dc = 1)', x30='max(v1) FILTER (dr = 1 AND dc = 0)', total='sum(v0 + 2 * v1)')}, 50 AS size FROM w GROUP BY "row", col HAVING count(*) = 25""")
def image_windows(spark, sf):
    w = composite.image_windows(pixels(spark, sf), 5, 2)
    x = F.col("x")
    total = F.aggregate(F.slice(x, 1, 25), F.lit(0.0), lambda s, v: s + v) + 2 * F.aggregate(F.slice(x, 26, 25), F.lit(0.0), lambda s, v: s + v)
    return w.select("row", "col", F.round(x[1] + SHIFT, 6).alias("x1"), F.round(x[30] + SHIFT, 6).alias("x30"), F.round(total + SHIFT, 6).alias("total"), F.size("x").alias("size"))


@query(f"""WITH {_PIXELS}, b AS (SELECT avg(v0) AS a0, avg(v1) AS a1, var_pop(v0) AS m00, covar_pop(v0, v1) AS m01, var_pop(v1) AS m11 FROM px), {eigen('e', 'b')}
SELECT "row", col, {_r(squared='(v0 - a0) * ((v0 - a0) * p00 + (v1 - a1) * p01) + (v1 - a1) * ((v0 - a0) * p01 + (v1 - a1) * p11)')} FROM px, e""")
def pca_image(spark, sf):
    d = pixels(spark, sf)
    out = composite.PCAImage(1).fit(d).transform(d)
    return out.select("row", "col", F.round(F.col("v")[0] * F.col("v")[0] + SHIFT, 6).alias("squared"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS id, b.vec_id AS j, a.v AS av, b.v AS bv, CASE WHEN a.vec_id = b.vec_id THEN -1 ELSE list_distance(a.v, b.v) END AS d FROM e a, e b),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, j) - 1 AS k FROM d QUALIFY k < 4) SELECT id, k::INT AS k, j, round(CASE WHEN d > 1e-10 THEN (bv[3] - av[3]) / d ELSE 0 END + 3e-8, 6) AS u2 FROM k""")
def neighbour_patches(spark, sf):
    d = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    out = composite.neighbour_patches(d, 4)
    return out.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "neighbours", "x").select("id", "k", F.col("neighbours")[F.col("k")].alias("j"), F.round(F.col("x")[8 + F.col("k")] + SHIFT, 6).alias("u2"))


@query(GEOMETRIC.replace(" WHERE a.key % 20 = 0", ""))
def sentence_means(spark, sf):
    return composite.aggregate(S.part_cov(spark, sf), 2, tol=1e-10).select("key", *coarse("mean"))


__all__ = ["QUERIES", "SQL", "domains", "with_gaps"]
