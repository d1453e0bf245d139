"""A geometry's operations as columns over flat arrays of doubles.

Vector geometries with closed forms are higher-order functions that stay in the JVM;
everything else is a vectorised pandas UDF around the batched kernels. A matrix is stored
row by row. Results that a geometry leaves undefined are NaN, never null; a null argument
gives null.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tangentia.functions.base import ULP, Geometry
from tangentia.session import reachable

POINT = "array<double>"
_CUT = math.sqrt(ULP)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column, s: Column | float = 1.0) -> Column:
    """a + s b"""
    k = s if isinstance(s, Column) else F.lit(float(s))
    return F.zip_with(a, b, lambda x, y: x + k * y)


def scale(a: Column, s: Column | float) -> Column:
    k = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(a, lambda x: x * k)


def clip(x: Column, low: float, high: float) -> Column:
    """Kept between two numbers; NaN stays NaN, and null null."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sqrt0(x: Column) -> Column:
    return F.sqrt(F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(x, F.lit(0.0))))


def wrap(a: Column) -> Column:
    return a - F.lit(2 * math.pi) * F.floor((a + F.lit(math.pi)) / F.lit(2 * math.pi))


def _filled(s: Column, full, series) -> Column:
    return F.when(s > _CUT, full(F.sqrt(s))).otherwise(series(s))


def sinc_of(s: Column) -> Column:
    return _filled(s, lambda r: F.sin(r) / r, lambda s: 1 - s / 6)


def cos_of(s: Column) -> Column:
    return _filled(s, F.cos, lambda s: 1 - s / 2)


def sinhc_of(s: Column) -> Column:
    return _filled(s, lambda r: F.sinh(r) / r, lambda s: 1 + s / 6)


def cosh_of(s: Column) -> Column:
    return _filled(s, F.cosh, lambda s: 1 + s / 2)


def tanhc_of(s: Column) -> Column:
    return _filled(s, lambda r: F.tanh(r) / r, lambda s: 1 - s / 3)


def atanhc_of(s: Column) -> Column:
    return _filled(F.least(s, F.lit((1 - 1e-12) ** 2)), lambda r: F.atanh(r) / r, lambda s: 1 + s / 3)


def angle_over_sine(c: Column, s2: Column) -> Column:
    return F.when((s2 <= _CUT * 1e-2) & (c > 0), 1 + s2 / 6).otherwise(F.atan2(F.sqrt(s2), c) / F.sqrt(s2))


def let(value: Column, body) -> Column:
    """body(value), computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


class Kernels:
    """Any geometry, by pandas UDFs."""

    native = False

    def __init__(self, geometry: Geometry):
        self.geometry = geometry

    def call(self, op: str, *args: Column | str, points: int | None = None, returns: str = POINT) -> Column:
        """A method of the kernels; the first `points` arguments are points or tangents, the others numbers."""
        reachable()
        geometry, n = self.geometry, len(args) if points is None else points

        @F.pandas_udf(returns)
        def run(*columns: pd.Series) -> pd.Series:
            live = reduce(lambda a, b: a & b, (c.notna() for c in columns)).to_numpy()
            out = np.full(len(live), None, object)
            if live.any():
                given = [np.stack(c[live].to_numpy()).astype(float).reshape(-1, *geometry.shape) if i < n else c[live].to_numpy(float) for i, c in enumerate(columns)]
                got = getattr(geometry, op)(*given)
                for i, value in zip(np.flatnonzero(live), got.reshape(len(got), -1) if returns == POINT else got):
                    out[i] = value
            return pd.Series(out, dtype=object)

        return run(*map(col, args))

    def _point(op):  # noqa: N805
        return lambda self, *a: self.call(op, *a)

    project, tangent_project, exp, log, transport, pair_mean, invretr, egrad_to_rgrad = map(_point, ("project", "tangent_project", "exp", "log", "transport", "pair_mean", "invretr", "egrad_to_rgrad"))

    def belongs(self, x):
        return self.call("belongs", x, returns="boolean")

    def is_tangent(self, x, u):
        return self.call("is_tangent", x, u, returns="boolean")

    def inner(self, x, u, v):
        return self.call("inner", x, u, v, returns="double")

    def norm(self, x, u):
        return self.call("norm", x, u, returns="double")

    def squared_dist(self, x, y):
        return self.call("squared_dist", x, y, returns="double")

    def dist(self, x, y):
        return self.call("dist", x, y, returns="double")

    def retr(self, x, u, step=1.0):
        return self.call("retr", x, u, F.lit(float(step)) if not isinstance(step, Column) else step, points=2)

    def interpolate(self, x, y, s):
        return self.call("interpolate", x, y, s if isinstance(s, Column) else F.lit(float(s)), points=2)


class Native(Kernels):
    """Closed forms; what a subclass doesn't write follows from the others or from the kernels."""

    native = True

    def inner(self, x, u, v):
        return dot(col(u), col(v))

    def norm(self, x, u):
        return sqrt0(self.inner(x, u, u))

    def squared_dist(self, x, y):
        return let(self.log(x, y), lambda u: self.inner(x, u, u))

    def dist(self, x, y):
        return sqrt0(self.squared_dist(x, y))

    def pair_mean(self, x, y):
        return self.interpolate(x, y, 0.5)

    def retr(self, x, u, step=1.0):
        return self.exp(x, scale(col(u), step))

    def invretr(self, x, y):
        return self.log(x, y)

    def interpolate(self, x, y, s):
        return self.exp(x, scale(self.log(x, y), s))


class FlatColumns(Native):
    def project(self, x):
        return col(x).cast(POINT)

    def belongs(self, x):
        return F.forall(col(x), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))

    def tangent_project(self, x, u):
        return col(u)

    def exp(self, x, u):
        return add(col(x), col(u))

    def log(self, x, y):
        return add(col(y), col(x), -1.0)

    def transport(self, x, y, u):
        return col(u)


class SphereColumns(Native):
    def project(self, x):
        n, eps = self.geometry.size[0], self.geometry.eps
        first = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(n)])
        return let(F.sqrt(dot(col(x), col(x))), lambda r: F.when(r <= eps, first).otherwise(F.transform(col(x), lambda v: v / r)))

    def belongs(self, x):
        return F.abs(F.sqrt(dot(col(x), col(x))) - 1) <= self.geometry.atol

    def tangent_project(self, x, u):
        return let(dot(col(x), col(u)), lambda c: add(col(u), col(x), -c))

    def exp(self, x, u):
        return self.project(let(dot(col(u), col(u)), lambda s: add(scale(col(x), cos_of(s)), col(u), sinc_of(s))))

    def _away(self, x, y, body):
        """body(cosine, y - cosine x, its squared length)"""
        return let(dot(col(x), col(y)), lambda c: let(add(col(y), col(x), -c), lambda a: let(dot(a, a), lambda s2: body(c, a, s2))))

    def log(self, x, y):
        lost = lambda a: F.transform(a, lambda v: F.lit(float("nan")))
        return self._away(x, y, lambda c, a, s2: F.when((c < 0) & (F.sqrt(s2) <= 64 * ULP), lost(a)).otherwise(scale(a, angle_over_sine(c, s2))))

    def dist(self, x, y):
        return F.acos(clip(dot(col(x), col(y)), -1.0, 1.0))

    def squared_dist(self, x, y):
        return F.pow(self.dist(x, y), 2)

    def transport(self, x, y, u):
        def moved(c, a, s2):
            f = F.when((c < 0) & (F.sqrt(s2) <= 64 * ULP), float("nan")).otherwise(dot(col(y), col(u)) / (1 + c))
            return let(f, lambda k: add(col(u), add(col(x), col(y)), -k))

        return self._away(x, y, moved)

    def chordal_dist(self, x, y):
        return let(add(col(x), col(y), -1.0), lambda d: F.sqrt(dot(d, d)))


class SimplexColumns(Native):
    def project(self, x):
        floor = max(self.geometry.eps, 32 * ULP)
        return let(F.transform(col(x), lambda v: F.greatest(v, F.lit(floor))), lambda p: let(total(p), lambda s: F.transform(p, lambda v: v / s)))

    def belongs(self, x):
        return (F.array_min(col(x)) > 0) & (F.abs(total(col(x)) - 1) <= self.geometry.atol)

    def tangent_project(self, x, u):
        return let(total(col(u)), lambda s: add(col(u), col(x), -s))

    def inner(self, x, u, v):
        return total(F.zip_with(F.zip_with(col(u), col(v), lambda a, b: a * b), col(x), lambda a, p: a / p))

    def _roots(self, x):
        return F.transform(col(x), F.sqrt)

    def dist(self, x, y):
        return 2 * F.acos(clip(dot(self._roots(x), self._roots(y)), -1.0, 1.0))

    def squared_dist(self, x, y):
        return F.pow(self.dist(x, y), 2)

    def log(self, x, y):
        def body(a, b):
            return let(dot(a, b), lambda c: let(add(b, a, -c), lambda d: let(angle_over_sine(c, dot(d, d)), lambda f: F.zip_with(a, d, lambda p, q: 2 * f * p * q))))

        return self.tangent_project(x, let(self._roots(x), lambda a: let(self._roots(y), lambda b: body(a, b))))

    def exp(self, x, u):
        def body(r, s):
            z = F.zip_with(F.zip_with(col(u), r, lambda a, b: a / (2 * b)), r, lambda v, p: cos_of(s) * p + sinc_of(s) * v)
            square = lambda z: let(dot(z, z), lambda t: F.transform(z, lambda v: v * v / t))
            return let(z, lambda z: F.when(F.exists(z, lambda v: v <= 0), F.transform(z, lambda v: F.lit(float("nan")))).otherwise(square(z)))

        return let(self._roots(col(x)), lambda r: let(0.25 * self.inner(x, u, u), lambda s: body(r, s)))

    def retr(self, x, u, step=1.0):
        return self.project(add(col(x), col(u), step))


class BallColumns(Native):
    def project(self, x):
        most = 1 - self.geometry.margin
        return let(F.sqrt(dot(col(x), col(x))), lambda r: F.when(r > most, F.transform(col(x), lambda v: v * most / r)).otherwise(col(x)))

    def belongs(self, x):
        return dot(col(x), col(x)) < 1

    def tangent_project(self, x, u):
        return col(u)

    def conformal_factor(self, x):
        return 2 / (1 - dot(col(x), col(x)))

    def mobius_add(self, x, y):
        x, y = col(x), col(y)

        def body(s):
            bottom = 1 + 2 * s["xy"] + s["x2"] * s["y2"]
            return F.zip_with(x, y, lambda a, b: ((1 + 2 * s["xy"] + s["y2"]) * a + (1 - s["x2"]) * b) / bottom)

        return let(F.struct(dot(x, y).alias("xy"), dot(x, x).alias("x2"), dot(y, y).alias("y2")), body)

    def inner(self, x, u, v):
        return F.pow(self.conformal_factor(x), 2) * dot(col(u), col(v))

    def dist(self, x, y):
        x, y = col(x), col(y)
        d = add(x, y, -1.0)
        return F.acosh(1 + 2 * dot(d, d) / ((1 - dot(x, x)) * (1 - dot(y, y))))

    def squared_dist(self, x, y):
        return F.pow(self.dist(x, y), 2)

    def exp(self, x, u):
        half = scale(col(u), 0.5 * self.conformal_factor(x))
        return self.project(let(let(half, lambda h: scale(h, tanhc_of(dot(h, h)))), lambda z: self.mobius_add(x, z)))

    def log(self, x, y):
        return let(self.mobius_add(scale(col(x), -1.0), y), lambda z: scale(z, 2 / self.conformal_factor(x) * atanhc_of(dot(z, z))))


class HyperboloidColumns(Native):
    def lorentz(self, u, v):
        u, v = col(u), col(v)
        return dot(u, v) - 2 * F.get(u, 0) * F.get(v, 0)

    def project(self, x):
        space = F.slice(col(x), 2, self.geometry.size[0] - 1)
        return let(space, lambda s: F.concat(F.array(F.sqrt(1 + dot(s, s))), s))

    def belongs(self, x):
        return (F.get(col(x), 0) > 0) & (F.abs(self.lorentz(x, x) + 1) <= self.geometry.atol + 32 * ULP * dot(col(x), col(x)))

    def tangent_project(self, x, u):
        return let(self.lorentz(x, u), lambda c: add(col(u), col(x), c))

    def inner(self, x, u, v):
        return self.lorentz(u, v)

    def _alpha(self, x, y):
        return clip(-self.lorentz(x, y), 1.0, float("inf"))

    def dist(self, x, y):
        return F.acosh(self._alpha(x, y))

    def squared_dist(self, x, y):
        return F.pow(self.dist(x, y), 2)

    def exp(self, x, u):
        return self.project(let(F.greatest(self.lorentz(u, u), F.lit(0.0)), lambda s: add(scale(col(x), cosh_of(s)), col(u), sinhc_of(s))))

    def log(self, x, y):
        f = lambda a: F.when(a - 1 <= _CUT, 1 - (a - 1) / 3).otherwise(F.acosh(a) / F.sqrt(a * a - 1))
        return self.tangent_project(x, let(self._alpha(x, y), lambda a: scale(add(col(y), col(x), -a), f(a))))

    def transport(self, x, y, u):
        f = self.lorentz(y, u) / (1 - self.lorentz(x, y))
        return self.tangent_project(y, let(f, lambda k: add(col(u), add(col(x), col(y)), k)))

    def to_poincare(self, x):
        x = col(x)
        return F.transform(F.slice(x, 2, self.geometry.size[0] - 1), lambda v: v / (1 + F.get(x, 0)))


class TorusColumns(FlatColumns):
    def project(self, x):
        return F.transform(col(x), wrap)

    def belongs(self, x):
        a = self.geometry.atol
        return F.forall(col(x), lambda v: (v >= -math.pi - a) & (v < math.pi + a))

    def exp(self, x, u):
        return F.zip_with(col(x), col(u), lambda a, b: wrap(a + b))

    def log(self, x, y):
        return F.zip_with(col(y), col(x), lambda a, b: wrap(a - b))


_NATIVE = {"euclidean": FlatColumns, "sphere": SphereColumns, "sphere_extrinsic": SphereColumns, "simplex": SimplexColumns, "poincare": BallColumns, "hyperboloid": HyperboloidColumns, "torus": TorusColumns}


def columns(geometry: Geometry) -> Kernels:
    """The column operations of a geometry."""
    return _NATIVE.get(geometry.name, Kernels)(geometry)


def _sql_function(geometry: Geometry, op: str, returns: str):
    @F.pandas_udf(returns)
    def run(*c: pd.Series) -> pd.Series:
        got = getattr(geometry, op)(*(np.stack(x.to_numpy()).astype(float).reshape(-1, *geometry.shape) for x in c))
        return pd.Series(list(got.reshape(len(got), -1)) if returns == POINT else got)

    return run


def register_sql(spark, geometry: Geometry, prefix: str) -> None:
    """The kernels as SQL functions over points that aren't null: prefix_dist(x, y), prefix_exp(x, u) and so on."""
    reachable(spark)
    for op, returns in (("dist", "double"), ("squared_dist", "double"), ("exp", POINT), ("log", POINT), ("project", POINT), ("belongs", "boolean"), ("pair_mean", POINT)):
        spark.udf.register(f"{prefix}_{op}", _sql_function(geometry, op, returns))
