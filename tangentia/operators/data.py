"""From raw columns to validated points: representations, checks, repair, and the geometry in column metadata."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import Geometry, PoincareBall, Product, from_spec
from tangentia.functions.base import expm, orthonormal, signed_columns, skew, sym, t
from tangentia.functions.columns import POINT, add, columns, dot, let, scale, total
from tangentia.functions.matrices import by_eigen, scaled
from tangentia.functions.vectors import hyperspherical
from tangentia.session import reachable

#: The levels of checking, from weak to strong.
LEVELS = ("shape", "finite", "belongs")
KEY = "geometry"
_ADAPTERS: dict[tuple[type, str], Callable] = {}


def stamped(c: Column, name: str, geometry: Geometry) -> Column:
    """The column under a name, with its geometry in the metadata."""
    return c.alias(name, metadata={KEY: json.dumps(geometry.spec())})


def geometry_of(df: DataFrame, name: str) -> Geometry:
    spec = df.schema[name].metadata.get(KEY)
    if spec is None:
        raise ValueError(f"column {name} carries no geometry; adapt it with as_points")
    return from_spec(json.loads(spec))


def bound(df: DataFrame, name: str, geometry: Geometry) -> None:
    """Raise if the column is stamped with another geometry."""
    if df.schema[name].metadata.get(KEY) and geometry_of(df, name) != geometry:
        raise ValueError(f"column {name} holds points of {geometry_of(df, name)!r}, not of {geometry!r}")


def register_adapter(kind: type, representation: str, adapter: Callable[[Geometry, Column], Column], overwrite: bool = False) -> None:
    """A further representation for a class of geometries and its subclasses; it precedes the built-in ones."""
    if not representation or representation == "canonical":
        raise ValueError("a representation has a name other than canonical")
    if (kind, representation) in _ADAPTERS and not overwrite:
        raise ValueError(f"{kind.__name__} has an adapter for {representation}")
    _ADAPTERS[kind, representation] = adapter


def _kernel(f: Callable[[np.ndarray], np.ndarray], c: Column) -> Column:
    """A batched kernel over flat arrays; null stays null."""
    reachable()

    @F.pandas_udf(POINT)
    def run(s: pd.Series) -> pd.Series:
        live = s.notna().to_numpy()
        out = np.full(len(s), None, object)
        if live.any():
            got = f(np.stack(s[live].to_numpy()).astype(float))
            for i, value in zip(np.flatnonzero(live), got.reshape(len(got), -1)):
                out[i] = value
        return pd.Series(out, dtype=object)

    return run(c)


def rotation_of_vector(w: np.ndarray) -> np.ndarray:
    """Rodrigues' rotation of axis-angle vectors."""
    k = np.zeros((*w.shape[:-1], 3, 3))
    k[..., 2, 1], k[..., 0, 2], k[..., 1, 0] = w[..., 0], w[..., 1], w[..., 2]
    return expm(k - t(k))


def rotation_of_quaternion(q: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(q, axis=-1, keepdims=True)
    if (size == 0).any():
        raise ValueError("a quaternion of size zero")
    w, x, y, z = np.moveaxis(q / size, -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def converted(geometry: Geometry, c: Column, representation: str) -> Column:
    """The canonical point of a representation, as a flat array of doubles; unknown ones raise at once."""
    for kind in type(geometry).__mro__:
        if (kind, representation) in _ADAPTERS:
            return _ADAPTERS[kind, representation](geometry, c)
    name, size = geometry.name, geometry.size
    c = c.cast(POINT)
    square = lambda a: a.reshape(-1, *geometry.shape)
    if representation in ("canonical", "point_sequence"):
        return c
    if name in ("sphere", "sphere_extrinsic") and representation in ("hyperspherical", "angles"):
        return _kernel(hyperspherical, c)
    if name == "torus" and representation in ("unit_circle", "circle_pairs"):
        return F.transform(F.sequence(F.lit(0), F.lit(size[0] - 1)), lambda i: F.atan2(F.get(c, 2 * i + 1), F.get(c, 2 * i)))
    if name == "hyperboloid" and representation in ("poincare", "poincare_ball"):
        inside = columns(PoincareBall(size[0] - 1, atol=geometry.atol)).project(c)
        return let(inside, lambda p: let(dot(p, p), lambda r: F.concat(F.array((1 + r) / (1 - r)), F.transform(p, lambda v: 2 * v / (1 - r)))))
    if name == "poincare" and representation == "hyperboloid":
        return F.transform(F.slice(c, 2, size[0]), lambda v: v / (1 + F.get(c, 0)))
    if name == "simplex" and representation in ("positive", "positive_weights"):
        bad = F.exists(c, lambda v: v < 0) | (total(c) <= 0)
        return F.when(bad, F.raise_error(F.lit("weights are not negative and have a positive sum")).cast(POINT)).otherwise(let(total(c), lambda s: F.transform(c, lambda v: v / s)))
    if name == "simplex" and representation == "logits":
        return let(F.transform(c, lambda v: F.exp(v - F.array_max(c))), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))
    if name in ("grassmann", "grassmann_projection") and representation in ("basis", "spanning_basis"):
        return _kernel(lambda a: signed_columns(orthonormal(square(a))), c)
    if name == "generalized_grassmann" and representation in ("basis", "spanning_basis"):
        return _kernel(lambda a: geometry.project(square(a)), c)
    if "grassmann" in name and representation == "projector":
        n, k = size

        def frame(a):
            x = signed_columns(np.linalg.eigh(sym(a.reshape(-1, n, n)))[1][..., ::-1][..., :k])
            return geometry.project(x) if name == "generalized_grassmann" else x

        return _kernel(frame, c)
    if name.startswith("spd_") and representation in ("cholesky", "cholesky_factor"):
        return _kernel(lambda a: square(a) @ t(square(a)), c)
    if name.startswith("spd_") and representation in ("log", "log_matrix"):
        return _kernel(lambda a: sym(by_eigen(np.exp, square(a))), c)
    if name.startswith("correlation_") and representation in ("cholesky", "cholesky_factor"):
        return _kernel(lambda a: scaled(square(a) @ t(square(a)), geometry.eps), c)
    if name.startswith("correlation_") and representation == "covariance":
        return _kernel(lambda a: scaled(square(a), geometry.eps), c)
    if name == "special_orthogonal" and size == (2,) and representation == "angle":
        a = F.get(c, 0)
        return F.array(F.cos(a), -F.sin(a), F.sin(a), F.cos(a))
    if name == "special_orthogonal" and size == (3,) and representation in ("axis_angle", "rotation_vector"):
        return _kernel(rotation_of_vector, c)
    if name == "special_orthogonal" and size == (3,) and representation == "quaternion":
        return _kernel(rotation_of_quaternion, c)
    if name == "special_euclidean" and representation in ("components", "rotation_translation"):
        n = size[0]
        return _kernel(lambda a: geometry.from_components(a[:, : n * n].reshape(-1, n, n), a[:, n * n :]), c)
    if name == "special_euclidean" and size[0] in (2, 3) and representation == "twist":
        n = size[0]

        def motion(a):
            m = a.shape[1] - n
            w = np.zeros((len(a), n, n))
            if n == 2:
                w[:, 1, 0] = a[:, 0]
            else:
                w[:, 2, 1], w[:, 0, 2], w[:, 1, 0] = a[:, 0], a[:, 1], a[:, 2]
            return geometry.group_exp(geometry.tangent_from_components(2 * skew(w), a[:, m:]))

        return _kernel(motion, c)
    if name == "kendall" and representation in ("landmarks", "raw_landmarks"):
        return _kernel(lambda a: geometry.project(square(a)), c)
    if name == "fixed_rank" and representation in ("svd", "svd_factors"):
        m, n, k = size
        cut = (m * k, m * k + k)
        return _kernel(lambda a: (a[:, : cut[0]].reshape(-1, m, k) * a[:, None, cut[0] : cut[1]]) @ a[:, cut[1] :].reshape(-1, k, n), c)
    if name in ("rank_k_psd", "rank_k_psd_bures_wasserstein", "elliptope", "spectrahedron") and representation in ("factor", "low_rank_factor"):

        def product(a):
            y = a.reshape(-1, *size)
            return geometry.project(y @ t(y)) if name in ("elliptope", "spectrahedron") else y @ t(y)

        return _kernel(product, c)
    raise ValueError(f"{geometry!r} has no representation {representation!r}")


def _flat(df: DataFrame, c: Column, name: str) -> Column:
    """A column of arrays, or of arrays of arrays row by row, as one flat array."""
    kind = df.schema[name].dataType.simpleString()
    return F.flatten(c.cast("array<array<double>>")) if kind.startswith("array<array") else c


def _product(df: DataFrame, geometry: Product, name: str, representation) -> Column:
    leaf = {}
    for path, g in geometry.parts:
        own = representation if isinstance(representation, str) else representation.get(path, "canonical")
        leaf[path] = converted(g, F.col(f"{name}.{path}"), own)
    return F.concat(*(leaf[path] for path, _ in geometry.parts))


def check_points(df: DataFrame, name: str, geometry: Geometry, check: str = "belongs") -> DataFrame:
    """One row: valid, level, n_samples, invalid, nulls, messages. Never raises on data; one aggregate."""
    if check not in LEVELS:
        raise ValueError(f"check is one of {LEVELS}")
    c, level = F.col(name), LEVELS.index(check)
    shaped = c.isNotNull() & (F.size(c) == geometry.length)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = shaped if level == 0 else shaped & finite
    if level == 2:
        safe = F.when(ok, c)
        ok = ok & F.coalesce(columns(geometry).belongs(safe), F.lit(False))
    bad = df.agg(F.count("*").alias("n_samples"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"), F.count_if(c.isNull()).alias("nulls"))
    valid = (F.col("invalid") == 0) & (F.col("n_samples") > 0)
    message = F.when(F.col("n_samples") == 0, "no samples").when(F.col("invalid") > 0, F.format_string("%d of %d rows fail the check", "invalid", "n_samples")).otherwise("")
    return bad.select(valid.alias("valid"), F.lit(check).alias("level"), "n_samples", "invalid", "nulls", message.alias("message"))


def as_points(df: DataFrame, name: str, geometry: Geometry, representation="canonical", check: str = "belongs", repair: bool = False, out: str | None = None) -> DataFrame:
    """df with the column as canonical points (flat arrays of doubles, stamped with the geometry).

    representation: a name, or for products a dict by leaf. check: shape, finite or
    belongs; "lazy" checks membership row by row when the plan runs, "none" not at all.
    With repair, all points are projected if one doesn't belong, and checked again.
    """
    point = _product(df, geometry, name, representation) if isinstance(geometry, Product) and df.schema[name].dataType.typeName() == "struct" else converted(geometry, _flat(df, F.col(name), name), representation)
    out = out or name
    if check == "lazy":
        point = F.when(columns(geometry).belongs(point), point).otherwise(F.raise_error(F.lit(f"{name} holds a value that is no point of {geometry!r}")).cast(POINT))
    rows = df.withColumn(out, stamped(point, out, geometry))
    if check in ("none", "lazy"):
        return rows
    report = check_points(rows, out, geometry, check).first()
    if report["valid"] or not report["n_samples"]:
        return rows
    if repair and check_points(rows, out, geometry, "finite").first()["valid"]:
        rows = rows.withColumn(out, stamped(columns(geometry).project(F.col(out)), out, geometry))
        report = check_points(rows, out, geometry, check).first()
        if report["valid"]:
            return rows
    raise ValueError(f"{name}: {report['message']}")


def random_points(spark, geometry: Geometry, n: int, seed: int, id_col: str = "id", out: str = "point") -> DataFrame:
    """n random points; each row's draw depends on the seed and its id alone, not on the partitioning."""
    reachable(spark)

    @F.pandas_udf(POINT)
    def draw(ids: pd.Series) -> pd.Series:
        return pd.Series([geometry.random_point(np.random.default_rng([seed, int(i)]), 1).ravel() for i in ids])

    return spark.range(n).withColumnRenamed("id", id_col).withColumn(out, stamped(draw(F.col(id_col)), out, geometry))


def random_tangents(df: DataFrame, name: str, seed: int, scale: float = 1.0, normalize: bool = False, id_col: str = "id", out: str = "tangent") -> DataFrame:
    geometry = geometry_of(df, name)
    reachable(df.sparkSession)

    @F.pandas_udf(POINT)
    def draw(ids: pd.Series, points: pd.Series) -> pd.Series:
        return pd.Series([geometry.random_tangent(np.random.default_rng([seed, int(i)]), np.asarray(p, float).reshape(1, *geometry.shape), scale, normalize).ravel() for i, p in zip(ids, points)])

    return df.withColumn(out, draw(F.col(id_col), F.col(name)))


def angle_of(part: Column, period: float) -> Column:
    """A cyclic quantity as an angle in [-pi, pi)."""
    return part / period * 2 * math.pi - math.pi


__all__ = ["LEVELS", "add", "angle_of", "as_points", "bound", "check_points", "converted", "geometry_of", "random_points", "random_tangents", "register_adapter", "scale", "stamped"]
