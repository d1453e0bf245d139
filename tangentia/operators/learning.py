"""Metric learning, barycentric coding and dictionaries, semi-supervised prediction."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import Geometry
from tangentia.functions.base import sym
from tangentia.functions.columns import columns
from tangentia.functions.matrices import by_eigen
from tangentia.operators.local import CAP, gathered, local_points, median_bandwidth, returned
from tangentia.operators.inference import local_mean
from tangentia.operators.clustering import equal_points
from tangentia.operators.pairs import HELD, distances, median_distance, nearest_neighbors, pairwise_distances, stacked
from tangentia.session import cut, reachable

# Metric learning


def embedding_column(geometry: Geometry, point: str) -> Column:
    """The vector that metric learning reads: the point itself, its embedding, or for products the parts'."""
    if geometry.name in ("euclidean", "sphere_extrinsic"):
        return F.col(point)
    if not hasattr(geometry, "embed"):
        raise ValueError(f"{geometry!r} has no embedding; give one as a column function")
    return columns(geometry).call("embed", point)


@dataclass
class LearnedMetric:
    """metric = L L^T; rows map to values @ L, in which the metric is the flat one."""

    metric: np.ndarray
    factor: np.ndarray
    embedding: Callable[[str], Column]

    def transform(self, df: DataFrame, point: str = "point", out: str = "features") -> DataFrame:
        z = self.embedding(point)
        rows = [F.aggregate(F.zip_with("_z", F.array(*[F.lit(float(v)) for v in col]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for col in self.factor.T]
        return df.withColumn("_z", z).withColumn(out, F.array(*rows)).drop("_z")


def pair_scatters(df: DataFrame, z: Column, label: str) -> tuple[np.ndarray, np.ndarray]:
    """(similar, dissimilar) sums over pairs i < j of (z_i - z_j)(z_i - z_j)^T, by moments of each class: one aggregate."""
    d = df.select(z.alias("z")).first()
    d = len(d["z"])
    f = lambda i: F.get("z", F.lit(i))
    got = df.select(z.alias("z"), F.col(label).alias("l")).groupBy("l").agg(F.count("*").alias("n"), F.array(*[F.sum(f(i)) for i in range(d)]).alias("a"), F.array(*[F.sum(f(i) * f(j)) for i in range(d) for j in range(d)]).alias("b")).collect()
    spread = lambda n, a, b: n * b - np.outer(a, a)
    parts = [(r["n"], np.array(r["a"]), np.array(r["b"]).reshape(d, d)) for r in got]
    similar = sum(spread(*p) for p in parts)
    return similar, spread(*(sum(p[i] for p in parts) for i in range(3))) - similar


def riemannian_metric_learning(geometry: Geometry, df: DataFrame, label: str, regularization: float = 0.1, balance: float = 0.5, embedding: Callable[[str], Column] | None = None, eigenvalue_floor: float = 1e-10, point: str = "point") -> LearnedMetric:
    """exp(-balance log S + (1 - balance) log D) of the regularised mean scatters of similar and dissimilar pairs."""
    if not 0 <= balance <= 1 or regularization < 0:
        raise ValueError("balance lies in [0, 1] and regularization isn't negative")
    embedding = embedding or (lambda p: embedding_column(geometry, p))
    s, d = pair_scatters(df, embedding(point), label)
    counts = [r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()]
    same = sum(n * (n - 1) / 2 for n in counts)
    other = sum(counts) * (sum(counts) - 1) / 2 - same
    eye = regularization * np.eye(len(s))
    logs = [by_eigen(np.log, m / max(k, 1) + eye, eigenvalue_floor) for m, k in ((s, same), (d, other))]
    metric = sym(by_eigen(np.exp, -balance * logs[0] + (1 - balance) * logs[1]))
    return LearnedMetric(metric, np.linalg.cholesky(metric), embedding)


# Coding and dictionaries

#: Rows that are coded together.
CODED = 4096


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest vectors (rows) of nonnegative entries with sum 1."""
    s = -np.sort(-v, axis=-1)
    excess = (np.cumsum(s, -1) - 1) / np.arange(1, v.shape[-1] + 1)
    k = (s > excess).sum(-1)
    return np.maximum(v - np.take_along_axis(excess, k[..., None] - 1, -1), 0)


def barycentric_codes(geometry: Geometry, x: np.ndarray, atoms: np.ndarray, ridge: float, maxiter: int, tol: float) -> np.ndarray:
    """Rows: simplex weights w that minimise ||sum w log_x(atom)||^2 + ridge ||w||^2, by projected gradient."""
    out = np.empty((len(x), len(atoms)))
    for at in range(0, len(x), CODED):
        p = x[at : at + CODED]
        u = geometry.log(p[:, None], atoms[None])
        gram = np.stack([geometry.inner(p[:, None], u, u[:, k : k + 1]) for k in range(len(atoms))], -1)
        q = sym(gram) + ridge * np.eye(len(atoms))
        # A row whose logarithms aren't finite raises, as its eigenvalues do.
        step = 1 / np.maximum(np.linalg.eigvalsh(q)[:, -1], 1e-12)
        w = np.full((len(p), len(atoms)), 1 / len(atoms))
        y, m, live = w.copy(), 1.0, np.arange(len(p))
        for _ in range(maxiter):
            new = onto_simplex(y - step[live, None] * (q[live] @ y[..., None])[..., 0])
            m2 = (1 + math.sqrt(1 + 4 * m * m)) / 2
            old = w[live]
            y, m = new + (m - 1) / m2 * (new - old), m2
            w[live] = new
            more = np.abs(new - old).max(1) > tol
            if not more.any():
                break
            y, live = y[more], live[more]
        out[at : at + CODED] = w
    return out


def geodesic_barycentric_coding(geometry: Geometry, df: DataFrame, atoms, ridge: float = 1e-6, maxiter: int = 2000, tol: float = 1e-9, reconstruction_maxiter: int = 100, point: str = "point") -> DataFrame:
    """df with code (simplex weights of the broadcast atoms) and reconstruction (their weighted mean); row by row."""
    geometry.require("exp", "log")
    a = np.asarray(atoms, float).reshape(-1, *geometry.shape)
    reachable(df.sparkSession)

    @F.pandas_udf("code array<double>, reconstruction array<double>")
    def coded(s: pd.Series) -> pd.DataFrame:
        w = barycentric_codes(geometry, stacked(geometry, s), a, ridge, maxiter, tol)
        r = [local_mean(geometry, a, c, maxiter=reconstruction_maxiter).ravel() for c in w]
        return pd.DataFrame({"code": list(w), "reconstruction": r})

    return df.withColumn("_c", coded(F.col(point))).withColumns({"code": F.col("_c.code"), "reconstruction": F.col("_c.reconstruction")}).drop("_c")


@dataclass
class Dictionary:
    atoms: np.ndarray
    objective: float
    history: list[float]
    converged: bool


def manifold_dictionary_learning(geometry: Geometry, df: DataFrame, n_atoms: int, seed: int = 0, initial_atoms=None, ridge: float = 1e-6, maxiter: int = 20, tol: float = 1e-5, point: str = "point", id_col: str = "id", cap: int | None = None) -> Dictionary:
    """Alternate codes and atoms; an atom moves along the mean of weighted residuals, halved until the objective doesn't rise.

    The driver holds the points, and of each a few rows as long as the atoms; nothing grows with pairs of rows.
    """
    _, x = local_points(geometry, df, point, id_col, cap)
    rng = np.random.default_rng(seed)
    atoms = x[rng.choice(len(x), n_atoms, replace=False)] if initial_atoms is None else np.asarray(initial_atoms, float).reshape(-1, *geometry.shape)

    def value(atoms, w):
        u = geometry.log(x[:, None], atoms[None])
        r = (u * w.reshape(*w.shape, *(1,) * geometry.axes)).sum(1)
        return float(geometry.inner(x, r, r).mean() + ridge * (w * w).sum(1).mean()), r

    w = barycentric_codes(geometry, x, atoms, ridge, 500, 1e-8)
    now, r = value(atoms, w)
    history, done = [now], False
    for _ in range(maxiter):
        step = 1.0
        while step > 0.1:
            moved = []
            for k in range(len(atoms)):
                back = geometry.transport(x, np.broadcast_to(atoms[k], x.shape), r)
                pull = -(back.reshape(len(x), -1) * w[:, k, None]).sum(0) / max((w[:, k] ** 2).sum(), 1e-9)
                moved.append(geometry.exp(atoms[k][None], step * geometry.tangent_project(atoms[k][None], pull.reshape(1, *geometry.shape)))[0])
            new = np.stack(moved)
            after, _ = value(new, w)
            if np.isfinite(after) and after <= now + 1e-10:
                atoms = new
                break
            step /= 2
        codes = barycentric_codes(geometry, x, atoms, ridge, 500, 1e-8)
        fresh, r2 = value(atoms, codes)
        if fresh <= now + 1e-10:
            w, r = codes, r2
        else:
            fresh, r = value(atoms, w)
        history.append(fresh)
        if abs(now - fresh) <= tol * max(1, now):
            now, done = fresh, True
            break
        now = fresh
    return Dictionary(atoms, now, history, done)


# Semi-supervised


def affinity_edges(geometry: Geometry, df: DataFrame, bandwidth: float | None = None, n_neighbors: int | None = None, point: str = "point", id_col: str = "id") -> tuple[DataFrame, float]:
    """((i, j, w) with w = exp(-d^2 / (2 h^2)), h): all pairs, or those of whom one is among the other's nearest; none to itself."""
    if n_neighbors is None:
        d = pairwise_distances(geometry, df, point=point, id_col=id_col).filter("i <> j")
    else:
        near = nearest_neighbors(geometry, df, n_neighbors=n_neighbors, point=point, id_col=id_col).select(F.col("query_id").alias("i"), F.col("neighbor_id").alias("j"), "distance")
        d = near.unionAll(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")).groupBy("i", "j").agg(F.min("distance").alias("distance"))
    d = cut(d)
    if bandwidth is None:
        bandwidth = median_distance(geometry, df, point, id_col) or 1.0
    return d.select("i", "j", F.exp(-F.pow("distance", 2) / (2 * bandwidth**2)).alias("w")), bandwidth


def label_propagation(geometry: Geometry, df: DataFrame, label: str, unlabeled=-1, bandwidth: float | None = None, n_neighbors: int | None = None, alpha: float = 0.95, maxiter: int = 1000, tol: float = 1e-7, point: str = "point", id_col: str = "id", every: int = 5) -> DataFrame:
    """df with prediction and probability (map by class): D^-1/2 W D^-1/2 diffusion, labelled rows clamped each step.

    A step is one join of the edges with the scores; the lineage is cut every few steps.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    edges, _ = affinity_edges(geometry, df, bandwidth, n_neighbors, point, id_col)
    deg = edges.groupBy("i").agg(F.sum("w").alias("d"))
    s = edges.join(deg, "i").join(deg.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
    s = cut(s.select("i", "j", (F.col("w") / F.sqrt(F.greatest(F.col("d") * F.col("e"), F.lit(1e-300)))).alias("w")))
    known = F.col(label).isNotNull() & (F.col(label) != F.lit(unlabeled))
    classes = [r[0] for r in df.filter(known).select(label).distinct().orderBy(label).collect()]
    if not classes:
        raise ValueError("no labelled row")
    one = F.array(*[F.when(F.col(label) == F.lit(c), 1.0).otherwise(0.0) for c in classes])
    zero = F.array(*[F.lit(0.0) for _ in classes])
    start = df.select(F.col(id_col).alias("i"), F.when(known, one).alias("y"))
    now = cut(start.withColumn("f", F.coalesce("y", zero)))
    k = len(classes)
    for it in range(maxiter):
        flow = s.join(now.select(F.col("i").alias("j"), "f"), "j").groupBy("i").agg(F.array(*[F.sum(F.col("w") * F.get("f", F.lit(c))) for c in range(k)]).alias("g"))
        mixed = F.zip_with(F.coalesce("g", zero), F.coalesce("y", zero), lambda g, y: alpha * g + (1 - alpha) * y)
        new = now.join(flow, "i", "left").select("i", "y", F.coalesce("y", mixed).alias("n"), "f")
        if it % every == every - 1 or it == maxiter - 1:
            new = cut(new)
            moved = new.agg(F.max(F.array_max(F.zip_with("n", "f", lambda a, b: F.abs(a - b))))).first()[0]
            if moved <= tol:
                now = new.select("i", "y", F.col("n").alias("f"))
                break
        now = new.select("i", "y", F.col("n").alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, b: a + b)
    share = F.when(total > 0, F.transform("f", lambda v: v / total)).otherwise(F.array(*[F.lit(1.0 / k) for _ in classes]))
    names = F.array(*[F.lit(c) for c in classes])
    out = now.select(F.col("i").alias(id_col), share.alias("p")).withColumn("prediction", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    return df.join(out.select(id_col, "prediction", F.map_from_arrays(names, "p").alias("probability")), id_col)


def _weighted_median(d: np.ndarray, many: np.ndarray) -> float:
    """The median of the positive distances between rows, of which many lie at each point; 1 without any."""
    a, b = np.triu_indices(len(d), 1)
    v, n = d[a, b], many[a] * many[b]
    v, n = v[v > 0], n[v > 0]
    if not len(v):
        return 1.0
    order = np.argsort(v)
    upto = np.cumsum(n[order])
    return float(sum(v[order[np.searchsorted(upto, r, side="right")]] for r in ((upto[-1] - 1) // 2, upto[-1] // 2)) / 2)


def _regularized_by_points(geometry: Geometry, df: DataFrame, x: np.ndarray, y: np.ndarray, bandwidth: float | None, a: float, b: float, point: str, id_col: str) -> np.ndarray:
    """The solution with weights between all rows, by the sums of f over equal points.

    f = (J y + b T) / c, with T = W S, S the sums of f, and c = J + a + b W n: a system as large as the different
    points. Up to CAP of them it is solved as a matrix, more by conjugate gradients whose
    products take some rows of W at a time.
    """
    first, which, many = equal_points(x)
    z, m = x[first], len(first)
    small = m <= CAP
    d = distances(geometry, z, z) if small else None
    h = bandwidth or (_weighted_median(d, many) if small else median_distance(geometry, df, point, id_col) or 1.0)

    def weights(k: int, upto: int) -> np.ndarray:
        part = d[k:upto] if small else distances(geometry, z[k:upto], z)
        w = np.exp(-(part**2) / (2 * h * h))
        w[np.arange(len(w)), np.arange(k, k + len(w))] = 1
        return w

    step = m if small else max(1, HELD // m)
    whole = weights(0, m) if small else None
    product = lambda v: whole @ v if small else np.concatenate([weights(k, min(k + step, m)) @ v for k in range(0, m, step)])
    known = ~np.isnan(y)
    c = known + a + b * product(many.astype(float))[which]
    ready = np.where(known, y, 0) / c
    r, q = np.bincount(which, ready, m), np.bincount(which, 1 / c, m)
    if small:
        s = np.linalg.solve(np.eye(m) - b * q[:, None] * whole, r)
    else:
        s, left = np.zeros(m), r / q
        way, size, goal = left * q, float(left @ (left * q)), 1e-24 * float(r @ (r / q))
        for _ in range(10 * m):
            if size <= goal:
                break
            moved = way / q - b * product(way)
            at = size / float(way @ moved)
            s, left = s + at * way, left - at * moved
            size, before = float(left @ (left * q)), size
            way = left * q + size / before * way
    return ready + b * product(s)[which] / c


def manifold_regularized_regression(geometry: Geometry, df: DataFrame, target: str, bandwidth: float | None = None, n_neighbors: int | None = None, ambient_regularization: float = 1e-3, intrinsic_regularization: float = 1.0, point: str = "point", id_col: str = "id", cap: int | None = None) -> DataFrame:
    """(id, prediction): solves (J + a I + b L) f = y; rows with a NaN or null target are unlabelled.

    A graph of nearest neighbours is dense, and takes CAP rows where no cap is given.
    """
    rows = gathered(df, [point, target], id_col, CAP if cap is None and n_neighbors is not None else cap)
    x, y = stacked(geometry, [r[1] for r in rows]), np.array([math.nan if r[2] is None else float(r[2]) for r in rows])
    labelled = ~np.isnan(y)
    if not labelled.any():
        raise ValueError("no labelled row")
    if n_neighbors is None:
        f = _regularized_by_points(geometry, df, x, y, bandwidth, ambient_regularization, intrinsic_regularization, point, id_col)
        return returned(df, [r[0] for r in rows], id_col, prediction=f)
    d = distances(geometry, x, x)
    np.fill_diagonal(d, 0)
    h = bandwidth or median_bandwidth(d)
    w = np.exp(-(d**2) / (2 * h * h))
    np.fill_diagonal(w, 0)
    near = np.zeros_like(w, bool)
    order = np.argsort(d + np.where(np.eye(len(d), dtype=bool), np.inf, 0), 1, kind="stable")[:, :n_neighbors]
    near[np.arange(len(d))[:, None], order] = True
    w = np.where(near | near.T, w, 0)
    lap = np.diag(w.sum(1)) - w
    f = np.linalg.solve(np.diag(labelled.astype(float)) + ambient_regularization * np.eye(len(w)) + intrinsic_regularization * lap, np.where(labelled, y, 0))
    return returned(df, [r[0] for r in rows], id_col, prediction=f)


__all__ = ["affinity_edges", "geodesic_barycentric_coding", "label_propagation", "manifold_dictionary_learning", "manifold_regularized_regression", "onto_simplex", "riemannian_metric_learning"]
