"""Catalyst expressions on flat row-major matrices and on the 2x2 closed forms; no Python runs on the rows.

A matrix is a column array<double> of length p*p; expressions are ordinary
columns, so filters, projections and code generation apply to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry(m: Column, p: int, i: int, j: int) -> Column:
    return m[i * p + j]


def flat(rows: list[list[Column]]) -> Column:
    """A matrix of p*p entry columns."""
    return F.array(*(x for r in rows for x in r))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def trace(m: Column, p: int) -> Column:
    return reduce(lambda s, i: s + entry(m, p, i, i), range(1, p), entry(m, p, 0, 0))


def transpose(m: Column, p: int) -> Column:
    return F.array(*(entry(m, p, j, i) for i in range(p) for j in range(p)))


def distance_euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def geodesic_euclid(a: Column, b: Column, t) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)


def upper(m: Column, p: int) -> Column:
    return F.array(*(entry(m, p, i, j) * (1.0 if i == j else 2**0.5) for i in range(p) for j in range(i, p)))


def unupper(v: Column, p: int) -> Column:
    at = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(p) for j in range(i, p))}
    return F.array(*(v[at[min(i, j), max(i, j)]] / (1.0 if i == j else 2**0.5) for i in range(p) for j in range(p)))


def normalize(m: Column, p: int, norm: str) -> Column:
    if norm == "trace":
        t = trace(m, p)
        return F.transform(m, lambda x: x / t)
    if norm == "corr":
        d = [F.sqrt(entry(m, p, i, i)) for i in range(p)]
        return F.array(*(entry(m, p, i, j) / (d[i] * d[j]) for i in range(p) for j in range(p)))
    if norm == "determinant" and p == 2:
        d = F.sqrt(F.abs(det2(m)))
        return F.transform(m, lambda x: x / d)
    raise ValueError(f"no expression for norm {norm!r} at p = {p}")


def nondiag_weight(m: Column, p: int) -> Column:
    d = reduce(lambda s, i: s + entry(m, p, i, i) * entry(m, p, i, i), range(1, p), entry(m, p, 0, 0) * entry(m, p, 0, 0))
    return (total(F.transform(m, lambda x: x * x)) - d) / (p - 1) / d


def shrink(m: Column, p: int, s: float = 0.1) -> Column:
    t = trace(m, p) * (s / p)
    return F.array(*(entry(m, p, i, j) * (1 - s) + (t if i == j else F.lit(0.0)) for i in range(p) for j in range(p)))


def symmetric(m: Column, p: int, tol: float = 1e-8) -> Column:
    pairs = [F.abs(entry(m, p, i, j) - entry(m, p, j, i)) <= tol + 1e-5 * F.abs(entry(m, p, j, i)) for i in range(p) for j in range(i)]
    return reduce(lambda x, y: x & y, pairs, F.lit(True))


def softmax(values: Column) -> Column:
    """Softmax of an array column."""
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


# closed forms for symmetric 2x2 matrices [a, b, b, c]


def det2(m: Column) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def inv2(m: Column) -> Column:
    d = det2(m)
    return F.array(m[3] / d, -m[1] / d, -m[2] / d, m[0] / d)


def mul2(a: Column, b: Column) -> Column:
    return F.array(a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3])


def eig2(m: Column) -> tuple[Column, Column]:
    """Eigenvalues, the larger first; the smaller comes from the determinant, which loses no digits."""
    t, d = m[0] + m[3], m[0] - m[3]
    big = (t + F.sqrt(d * d + m[1] * m[2] * 4)) / 2
    return big, det2(m) / big


def pencil2(a: Column, b: Column) -> tuple[Column, Column]:
    """Eigenvalues of b^-1 a."""
    d = det2(b)
    t = (a[0] * b[3] + a[3] * b[0] - a[1] * b[1] * 2) / d
    q = det2(a) / d
    r = F.sqrt(F.greatest(t * t - q * 4, F.lit(0.0)))
    return (t + r) / 2, q / ((t + r) / 2)


def fun2(m: Column, f) -> Column:
    """f(m) = alpha I + beta m from the two eigenvalues."""
    x, y = eig2(m)
    near = F.abs(x - y) <= F.abs(x) * 1e-12
    beta = F.when(near, F.lit(0.0)).otherwise((f(x) - f(y)) / (x - y))
    alpha = f(x) - beta * x
    return F.array(alpha + beta * m[0], beta * m[1], beta * m[2], alpha + beta * m[3])


def log2x2(m: Column) -> Column:
    return fun2(m, F.log)


def exp2x2(m: Column) -> Column:
    x, d = (m[0] + m[3]) / 2, (m[0] - m[3]) / 2
    r = F.sqrt(d * d + m[1] * m[2])
    e, s = F.exp(x), F.when(r < 1e-12, F.lit(1.0)).otherwise(F.sinh(r) / F.when(r < 1e-12, F.lit(1.0)).otherwise(r))
    c = F.cosh(r)
    return F.array(e * (c + s * d), e * s * m[1], e * s * m[2], e * (c - s * d))


def sqrt2x2(m: Column) -> Column:
    s = F.sqrt(det2(m))
    t = F.sqrt(m[0] + m[3] + s * 2)
    return F.array((m[0] + s) / t, m[1] / t, m[2] / t, (m[3] + s) / t)


def chol2x2(m: Column) -> Column:
    """Lower Cholesky factor, flat."""
    a = F.sqrt(m[0])
    b = m[1] / a
    return F.array(a, F.lit(0.0), b, F.sqrt(m[3] - b * b))


def _logchol2(m: Column) -> Column:
    c = chol2x2(m)
    return F.array(F.log(c[0]), c[2], F.log(c[3]))


def _riemann2(a, b):
    x, y = pencil2(a, b)
    return F.sqrt(F.pow(F.log(x), 2) + F.pow(F.log(y), 2))


def _thompson2(a, b):
    x, y = pencil2(a, b)
    return F.greatest(F.abs(F.log(x)), F.abs(F.log(y)))


def _kullback2(a, b):
    x, y = pencil2(a, b)
    return (x + y - 2 - F.log(x * y)) / 2


def _logdet2(a, b):
    half = F.transform(add(a, b), lambda x: x / 2)
    return F.sqrt(F.greatest(F.log(det2(half)) - (F.log(det2(a)) + F.log(det2(b))) / 2, F.lit(0.0)))


def _wasserstein2(a, b):
    ab = a[0] * b[0] + a[1] * b[2] + a[2] * b[1] + a[3] * b[3]
    return F.sqrt(F.greatest(a[0] + a[3] + b[0] + b[3] - F.sqrt(ab + F.sqrt(det2(a) * det2(b)) * 2) * 2, F.lit(0.0)))


#: Distances between 2x2 matrices without Python.
DISTANCE2 = {
    "euclid": distance_euclid,
    "harmonic": lambda a, b: distance_euclid(inv2(a), inv2(b)),
    "logeuclid": lambda a, b: distance_euclid(log2x2(a), log2x2(b)),
    "chol": lambda a, b: distance_euclid(chol2x2(a), chol2x2(b)),
    "logchol": lambda a, b: distance_euclid(_logchol2(a), _logchol2(b)),
    "riemann": _riemann2,
    "thompson": _thompson2,
    "kullback": _kullback2,
    "kullback_right": lambda a, b: _kullback2(b, a),
    "kullback_sym": lambda a, b: _kullback2(a, b) + _kullback2(b, a),
    "logdet": _logdet2,
    "wasserstein": _wasserstein2,
}
