"""Prediction from manifold-valued predictors, and of manifold-valued responses."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import Geometry
from tangentia.operators.local import gathered, local_points
from tangentia.operators.location import frechet_mean, frechet_means, hash_uniform
from tangentia.operators.pairs import block_sums, distances, nearest_neighbors, stacked
from tangentia.session import appended, reachable, summed_arrays

#: Distances up to this are hits: an angle between equal points has as much by rounding.
HIT = 1e-6


def _applied(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], point: str, geometry: Geometry, returns: str, out: str) -> DataFrame:
    """df with a column of f over batches of points; what f holds is broadcast in its closure."""
    return appended(df, lambda b: {out: list(f(stacked(geometry, b[point]))) if len(b) else []}, f"{out} {returns}")


def _predicted(df: DataFrame, classes: list) -> DataFrame:
    """prediction: the class of the largest probability, the first of equal ones."""
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn("prediction", F.element_at(names, F.array_position("probability", F.array_max("probability")).cast("int")))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class NearestCentroid:
    """One Frechet mean per class; probabilities softmax(-d^2 / scale), scale the median positive d^2 of the scored rows."""

    geometry: Geometry
    classes: list
    centers: np.ndarray
    point: str = "point"

    def transform(self, df: DataFrame) -> DataFrame:
        g, c = self.geometry, self.centers
        rows = _applied(df, lambda x: distances(g, x, c, squared=True), self.point, g, "array<double>", "_d2")
        scale = rows.select(F.explode("_d2").alias("d")).filter("d > 0").agg(F.percentile("d", 0.5)).first()[0] or 1.0
        e = F.transform("_d2", lambda d: F.exp(-(d - F.array_min("_d2")) / scale))
        return _predicted(rows.withColumn("probability", F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))).drop("_d2"), self.classes)


def nearest_centroid_classifier(geometry: Geometry, df: DataFrame, label: str, point: str = "point", weight: str | None = None, maxiter: int = 200, tol: float = 1e-7) -> NearestCentroid:
    means = frechet_means(geometry, df, point, label, weight, maxiter=maxiter, tol=tol)
    classes = sorted(means)
    return NearestCentroid(geometry, classes, np.stack([means[c].point for c in classes]), point)


@dataclass
class NeighborVotes:
    """k nearest training rows; votes uniform or by inverse distance, exact hits taking all."""

    geometry: Geometry
    train: DataFrame
    label: str
    n_neighbors: int
    weights: str
    point: str
    id_col: str

    def transform(self, df: DataFrame) -> DataFrame:
        near = nearest_neighbors(self.geometry, self.train, df, self.n_neighbors, False, self.point, self.id_col)
        near = near.join(self.train.select(F.col(self.id_col).alias("neighbor_id"), F.col(self.label).alias("_l")), "neighbor_id")
        hit = (F.col("distance") <= HIT).cast("double")
        vote = F.lit(1.0) if self.weights == "uniform" else F.when(F.col("_hits") > 0, hit).otherwise(1 / F.col("distance"))
        hits = near.groupBy("query_id").agg(F.sum(hit).alias("_hits"))
        votes = near.join(hits, "query_id").groupBy("query_id", "_l").agg(F.sum(vote).alias("v"))
        best = votes.groupBy("query_id").agg(F.min_by("_l", F.struct(-F.col("v"), F.col("_l"))).alias("prediction"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", F.col("v"))))).alias("_v"), F.sum("v").alias("_s"))
        best = best.select(F.col("query_id").alias(self.id_col), "prediction", F.transform_values("_v", lambda k, v: v / F.col("_s")).alias("probability"))
        return df.join(best, self.id_col)


def knn_classifier(geometry: Geometry, df: DataFrame, label: str, n_neighbors: int = 5, weights: str = "uniform", point: str = "point", id_col: str = "id") -> NeighborVotes:
    if weights not in ("uniform", "distance"):
        raise ValueError("weights is uniform or distance")
    geometry.require("dist")
    return NeighborVotes(geometry, df, label, n_neighbors, weights, point, id_col)


@dataclass
class TangentFeatures:
    """Inner products of logarithms at a base with a metric-orthonormal basis."""

    geometry: Geometry
    base: np.ndarray
    basis: np.ndarray
    eigenvalues: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        u = self.geometry.log(self.base[None], x)
        return np.stack([self.geometry.inner(self.base[None], u, b[None]) for b in self.basis], -1) if len(self.basis) else np.zeros((len(x), 0))

    def transform(self, df: DataFrame, point: str = "point", out: str = "features") -> DataFrame:
        return _applied(df, self.of, point, self.geometry, "array<double>", out)


def metric_basis(geometry: Geometry, base: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the tangent space at a point, for its metric."""
    n = geometry.length
    e = geometry.tangent_project(np.broadcast_to(base, (n, *geometry.shape)), np.eye(n).reshape(n, *geometry.shape))
    gram = np.stack([geometry.inner(base[None], e, v[None]) for v in e], -1)
    w, v = np.linalg.eigh(0.5 * (gram + gram.T))
    keep = w > 1e-9 * max(w.max(), 1e-300)
    return np.einsum("ij,i...->j...", v[:, keep] / np.sqrt(w[keep]), e)


def tangent_scatter(geometry: Geometry, df: DataFrame, base: np.ndarray, point: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(second moments of logarithms in an orthonormal basis, the basis, rows): one aggregate, of d x d sums."""
    basis = metric_basis(geometry, base)
    d = len(basis)
    rows = TangentFeatures(geometry, base, basis, np.ones(d)).transform(df.select(point), point, "f")
    sums = rows.mapInPandas(lambda parts: (pd.DataFrame({"s": [(np.stack(p["f"]).T @ np.stack(p["f"])).ravel()], "n": [len(p)]}) for p in parts if len(p)), "s array<double>, n long")
    # The number of rows goes along as the last entry.
    total = summed_arrays(sums.select(F.concat("s", F.array(F.col("n").cast("double"))).alias("s")), None, "s")[0]
    return total[:-1].reshape(d, d), basis, int(total[-1])


def fit_tangent_feature_map(geometry: Geometry, df: DataFrame, point: str = "point", base_point=None, n_components: int | None = None, rank_tolerance: float = 1e-8) -> TangentFeatures:
    """Principal directions of the uncentred logarithms at the mean (or a base point), those above the rank tolerance."""
    base = frechet_mean(geometry, df, point).point if base_point is None else np.asarray(base_point, float).reshape(geometry.shape)
    s, basis, n = tangent_scatter(geometry, df, base, point)
    w, v = np.linalg.eigh(s)
    w, v = w[::-1], v[:, ::-1]
    top = max(w[0], 1.0) if len(w) else 1.0
    keep = np.flatnonzero(w > max(rank_tolerance * top, np.finfo(float).eps * n * top))[:n_components]
    b = np.einsum("ij,i...->j...", v[:, keep], basis)
    flat = b.reshape(len(b), geometry.length)
    sign = np.sign(flat[np.arange(len(b)), np.abs(flat).argmax(1)]) if len(b) else np.ones(0)
    return TangentFeatures(geometry, base, b * sign.reshape((-1,) + (1,) * geometry.axes), w[keep])


@dataclass
class TangentClassifier:
    """Class scores from tangent features."""

    features: TangentFeatures
    classes: list
    score: Callable[[np.ndarray], np.ndarray]
    point: str

    def transform(self, df: DataFrame) -> DataFrame:
        f, score = self.features, self.score
        return _predicted(_applied(df, lambda x: softmax(score(f.of(x))), self.point, f.geometry, "array<double>", "probability"), self.classes)


def _class_moments(df: DataFrame, features: TangentFeatures, label: str, point: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, counts, sums, second moments) of the features by class; one aggregate."""
    d = len(features.basis)
    rows = features.transform(df.select(point, label), point, "f")

    def run(parts):
        for p in parts:
            for label_, own in p.groupby("l", sort=False):
                z = np.stack(own["f"]).reshape(len(own), d)
                yield pd.DataFrame({"l": [label_], "s": [np.concatenate([[len(own)], z.sum(0), (z.T @ z).ravel()])]})

    kind = df.schema[label].dataType.simpleString()
    got = summed_arrays(rows.select("f", F.col(label).alias("l")).mapInPandas(run, f"l {kind}, s array<double>"), "l", "s")
    classes = sorted(got)
    values = np.stack([got[c] for c in classes])
    return classes, values[:, 0], values[:, 1 : 1 + d], values[:, 1 + d :].reshape(len(classes), d, d)


def tangent_space_discriminant_analysis(geometry: Geometry, df: DataFrame, label: str, method: str = "lda", point: str = "point", base_point=None, n_components: int | None = None, regularization: float = 1e-4, priors: list[float] | None = None) -> TangentClassifier:
    """LDA with a pooled covariance or QDA with one per class, each with a ridge, on tangent features."""
    if method not in ("lda", "qda"):
        raise ValueError("method is lda or qda")
    features = fit_tangent_feature_map(geometry, df, point, base_point, n_components)
    classes, n, s1, s2 = _class_moments(df, features, label, point)
    mean = s1 / n[:, None]
    scatter = s2 - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    ridge = regularization * np.eye(mean.shape[1])
    cov = np.broadcast_to(scatter.sum(0) / max(n.sum() - len(n), 1), scatter.shape) + ridge if method == "lda" else scatter / np.maximum(n - 1, 1)[:, None, None] + ridge
    prior = np.log(n / n.sum() if priors is None else np.asarray(priors, float) / np.sum(priors))
    inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def score(f):
        z = f[:, None] - mean[None]
        return prior - 0.5 * logdet - 0.5 * np.einsum("nci,cij,ncj->nc", z, inverse, z)

    return TangentClassifier(features, classes, score, point)


def tangent_space_logistic_regression(geometry: Geometry, df: DataFrame, label: str, point: str = "point", base_point=None, n_components: int | None = None, regularization: float = 1e-3, maxiter: int = 100, tol: float = 1e-7) -> TangentClassifier:
    """Multinomial logistic regression with an L2 penalty on standardised tangent features.

    Newton steps of the mean loss; each is one distributed sum of gradients and curvatures.
    """
    features = fit_tangent_feature_map(geometry, df, point, base_point, n_components)
    classes, n, s1, s2 = _class_moments(df, features, label, point)
    total, d, k = n.sum(), s1.shape[1], len(classes)
    mu = s1.sum(0) / total
    sd = np.maximum(np.sqrt(np.maximum(np.diagonal(s2.sum(0)) / total - mu * mu, 0)), 1e-8)
    code = {c: i for i, c in enumerate(classes)}
    rows = features.transform(df.select(point, label), point, "f").select("f", F.col(label).alias("l"))
    w = np.zeros((d + 1, k))
    penalty = np.repeat(np.r_[np.full(d, regularization), 1e-9], k)
    m = (d + 1) * k

    def sums(w):
        def run(parts):
            for p in parts:
                if not len(p):
                    continue
                z = np.column_stack([(np.stack(p["f"]).reshape(len(p), d) - mu) / sd, np.ones(len(p))])
                y = np.eye(k)[[code[c] for c in p["l"]]]
                q = softmax(z @ w)
                loss = -np.log(np.maximum((q * y).sum(1), 1e-300)).sum()
                h = np.einsum("ni,nj,na,nab->iajb", z, z, q, np.eye(k)[None] - q[:, None, :])
                yield pd.DataFrame({"g": [(z.T @ (q - y)).ravel()], "h": [h.ravel()], "c": [loss]})

        got = rows.mapInPandas(run, "g array<double>, h array<double>, c double").collect()
        return sum(np.array(r["g"]) for r in got) / total, sum(np.array(r["h"]).reshape(m, m) for r in got) / total, sum(r["c"] for r in got) / total

    g, h, c = sums(w)
    for _ in range(maxiter):
        g, h = g + penalty * w.ravel(), h + np.diag(penalty + 1e-9)
        if np.linalg.norm(g) <= tol:
            break
        step, a, before = np.linalg.solve(h, g).reshape(w.shape), 1.0, c + 0.5 * (penalty * w.ravel() ** 2).sum()
        while True:
            new = w - a * step
            g, h, c = sums(new)
            if c + 0.5 * (penalty * new.ravel() ** 2).sum() <= before or a < 1e-4:
                break
            a /= 2
        w = new
    return TangentClassifier(features, classes, lambda f: np.column_stack([(f - mu) / sd, np.ones(len(f))]) @ w, point)


def gaussian(d: np.ndarray, bandwidth: float) -> np.ndarray:
    z = d / bandwidth
    return np.exp(-0.5 * z * z)


@dataclass
class KernelRegression:
    """Weighted averages of the training targets; where no weight is left, the nearest one's."""

    geometry: Geometry
    train: DataFrame
    target: str
    bandwidth: float
    kernel: Callable[[np.ndarray, float], np.ndarray]
    point: str
    id_col: str

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        kernel, width = self.kernel, self.bandwidth

        def part(d, x, y):
            t, k, near = y["t"].to_numpy(float), np.maximum(kernel(d, width), 0), d.argmin(1)
            return {"n": k @ t, "d": k.sum(1), "least": d.min(1), "j": y["j"].to_numpy()[near], "t": t[near]}

        kind = self.train.schema[self.id_col].dataType.simpleString()
        got = block_sums(self.geometry, df, self.train, part, f"n double, d double, least double, j {kind}, t double", [F.col(self.target).cast("double").alias("t")], self.point, self.id_col)
        sums = got.groupBy("i").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min_by("t", F.struct("least", "j")).alias("near"))
        value = F.when(F.col("d") > 1e-15, F.col("n") / F.col("d")).otherwise(F.col("near"))
        return df.join(sums.select(F.col("i").alias(self.id_col), value.alias(out)), self.id_col)


def kernel_regression(geometry: Geometry, df: DataFrame, target: str, bandwidth: float, kernel=gaussian, point: str = "point", id_col: str = "id") -> KernelRegression:
    if bandwidth <= 0:
        raise ValueError("the bandwidth is positive")
    geometry.require("dist")
    return KernelRegression(geometry, df, target, bandwidth, kernel, point, id_col)


def select_kernel_bandwidth(geometry: Geometry, df: DataFrame, target: str, bandwidths: list[float], n_folds: int = 5, seed: int = 0, kernel=gaussian, point: str = "point", id_col: str = "id") -> tuple[KernelRegression, DataFrame]:
    """(model of the best bandwidth, scores of (bandwidth, mse)): folds by a hash of the id, one distance join for all."""
    folded = df.withColumn("_fold", F.floor(hash_uniform(seed, id_col) * n_folds).cast("int"))
    widths = [float(b) for b in bandwidths]
    folds = [F.col("_fold"), F.col(target).cast("double").alias("t")]

    def part(d, x, y):
        t, other = y["t"].to_numpy(float), x["f"].to_numpy()[:, None] != y["_fold"].to_numpy()
        open_ = np.where(other, d, np.inf)
        near, k = open_.argmin(1), [np.where(other, np.maximum(kernel(d, b), 0), 0) for b in widths]
        return {"n": [list(r) for r in np.stack([v @ t for v in k], 1)], "d": [list(r) for r in np.stack([v.sum(1) for v in k], 1)], "least": open_.min(1), "j": y["j"].to_numpy()[near], "t": t[near]}

    kind = df.schema[id_col].dataType.simpleString()
    sums = block_sums(geometry, folded, folded, part, f"n array<double>, d array<double>, least double, j {kind}, t double", folds, point, id_col, left=[F.col("_fold").alias("f")])
    each = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1)))).groupBy("i", "b").agg(F.sum(F.get("n", "b")).alias("n"), F.sum(F.get("d", "b")).alias("d"), F.min_by("t", F.struct("least", "j")).alias("near"))
    truth = folded.select(F.col(id_col).alias("i"), F.col(target).cast("double").alias("yi"), F.col("_fold").alias("fi"))
    fit = each.join(truth, "i").withColumn("bandwidth", F.get(F.array(*map(F.lit, widths)), "b"))
    err = F.pow(F.col("yi") - F.when(F.col("d") > 1e-15, F.col("n") / F.col("d")).otherwise(F.col("near")), 2)
    scores = fit.groupBy("bandwidth", "fi").agg(F.avg(err).alias("e")).groupBy("bandwidth").agg(F.avg("e").alias("mse"))
    got = {r["bandwidth"]: r["mse"] for r in scores.collect()}
    best = min(bandwidths, key=lambda b: got[float(b)])
    return kernel_regression(geometry, df, target, float(best), kernel, point, id_col), scores


# Manifold-valued responses


@dataclass
class GeodesicRegression:
    geometry: Geometry
    intercept: np.ndarray
    slope: np.ndarray
    center: float
    objective: float
    iterations: int
    converged: bool

    def transform(self, df: DataFrame, predictor: str, out: str = "prediction") -> DataFrame:
        g, p, v, c = self.geometry, self.intercept, self.slope, self.center
        reachable(df.sparkSession)

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            x = s.to_numpy(float) - c
            y = g.exp(p[None], x.reshape((-1,) + (1,) * g.axes) * v[None])
            return pd.Series(list(y.reshape(len(x), -1)))

        return df.withColumn(out, run(F.col(predictor).cast("double")))


def geodesic_regression(geometry: Geometry, df: DataFrame, predictor: str, response: str = "point", weight: str | None = None, initial_point=None, maxiter: int = 200, tol: float = 1e-7) -> GeodesicRegression:
    """Y(t) = exp_p((t - mean t) v): the slope is profiled in the tangent space at each p, and p moves along the mean residual.

    A step is one aggregate of residuals transported to p by the ratio of geodesics (exact in flat
    spaces, first order elsewhere), halved where the cost doesn't fall.
    """
    from tangentia.operators.location import normalized_weights

    geometry.require("exp", "log", "dist")
    rows = normalized_weights(df, weight).select(F.col(predictor).cast("double").alias("t"), F.col(response).alias("y"), "_w")
    stats = rows.agg(F.sum(F.col("_w") * F.col("t")).alias("m"), F.sum(F.col("_w") * F.col("t") * F.col("t")).alias("s")).first()
    center, var = stats["m"], stats["s"] - stats["m"] ** 2
    if var <= 1e-15:
        raise ValueError("the predictor doesn't vary")
    p = frechet_mean(geometry, df, response, weight).point if initial_point is None else np.asarray(initial_point, float).reshape(geometry.shape)
    reachable(df.sparkSession)

    def at(p: np.ndarray, v: np.ndarray | None):
        def run(parts):
            for b in parts:
                if not len(b):
                    continue
                x, w = b["t"].to_numpy(float) - center, b["_w"].to_numpy(float)
                y = stacked(geometry, b["y"])
                wide = (-1,) + (1,) * geometry.axes
                u = geometry.log(p[None], y)
                if v is None:
                    a, s, c = u, u * x.reshape(wide), 0.0
                else:
                    f = geometry.exp(p[None], x.reshape(wide) * v[None])
                    r = geometry.transport(f, np.broadcast_to(p, f.shape), geometry.log(f, y))
                    a, s, c = r, r * x.reshape(wide), float((w * geometry.squared_dist(f, y)).sum())
                k = w.reshape(wide)
                yield pd.DataFrame({"a": [(a * k).sum(0).ravel()], "s": [(s * k).sum(0).ravel()], "c": [c]})

        got = rows.mapInPandas(run, "a array<double>, s array<double>, c double").collect()
        return *(sum(np.array(r[n]) for r in got).reshape(geometry.shape) for n in ("a", "s")), sum(r["c"] for r in got)

    v = geometry.tangent_project(p[None], (at(p, None)[1] / var)[None])[0]
    a, s, cost = at(p, v)
    step, it = 1.0, 0
    for it in range(maxiter):
        grad = math.hypot(float(geometry.norm(p[None], geometry.tangent_project(p[None], a[None]))[0]), float(geometry.norm(p[None], geometry.tangent_project(p[None], s[None]))[0]) / math.sqrt(var))
        if grad <= max(tol, 1e-10):
            return GeodesicRegression(geometry, p, v, center, cost, it, True)
        while step > 1e-8:
            q = geometry.exp(p[None], step * geometry.tangent_project(p[None], a[None]))[0]
            v2 = geometry.transport(p[None], q[None], v[None] + step * geometry.tangent_project(p[None], s[None]) / var)[0]
            new = at(q, v2)
            if new[2] <= cost * (1 + 1e-14):
                break
            step /= 2
        else:
            break
        p, v, (a, s, cost), step = q, v2, new, min(1.0, 2 * step)
    return GeodesicRegression(geometry, p, v, center, cost, it, False)


@dataclass
class LocalPolynomial:
    """Weighted means of the responses with kernel (degree 0) or signed local-linear weights (degree 1)."""

    geometry: Geometry
    t: np.ndarray
    y: np.ndarray
    bandwidth: float
    degree: int
    kernel: Callable
    maxiter: int
    tol: float

    def weights(self, q: float) -> np.ndarray:
        x = self.t - q
        k = np.maximum(self.kernel(np.abs(x), self.bandwidth), 0)
        if k.sum() <= 1e-15:
            out = np.zeros(len(x))
            out[int(np.abs(x).argmin())] = 1
            return out
        if self.degree == 1:
            s0, s1, s2 = k.sum(), (k * x).sum(), (k * x * x).sum()
            det = s0 * s2 - s1 * s1
            if det > 1e-12 * s0 * max(s2, 1e-300):
                w = k * (s2 - s1 * x)
                return w / w.sum()
        return k / k.sum()

    def at(self, q: float) -> np.ndarray:
        g, w = self.geometry, self.weights(q)
        p = self.y[int(np.abs(w).argmax())]
        for _ in range(self.maxiter):
            u = (g.log(p[None], self.y).reshape(len(w), -1) * w[:, None]).sum(0).reshape(g.shape)
            p = g.exp(p[None], u[None])[0]
            if float(g.norm(p[None], g.tangent_project(p[None], u[None]))[0]) <= self.tol:
                break
        return p

    def transform(self, df: DataFrame, predictor: str, out: str = "prediction") -> DataFrame:
        reachable(df.sparkSession)
        at = self.at

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            known = {q: at(q).ravel() for q in map(float, s.unique())}
            return s.map(lambda q: known[q] if q in known else at(float(q)).ravel())

        return df.withColumn(out, run(F.col(predictor).cast("double")))


def local_polynomial_regression(geometry: Geometry, df: DataFrame, predictor: str, bandwidth: float, response: str = "point", id_col: str = "id", degree: int = 1, kernel=gaussian, maxiter: int = 100, tol: float = 1e-6, cap: int | None = None) -> LocalPolynomial:
    """All rows are sent to where predictions are made: a number and a point each; a value of the predictor is fitted once a batch."""
    if degree not in (0, 1):
        raise ValueError("the degree is 0 or 1")
    geometry.require("exp", "log")
    rows = gathered(df, [predictor, response], id_col, cap)
    return LocalPolynomial(geometry, np.array([float(r[1]) for r in rows]), stacked(geometry, [r[2] for r in rows]), bandwidth, degree, kernel, maxiter, tol)


__all__ = ["fit_tangent_feature_map", "geodesic_regression", "kernel_regression", "knn_classifier", "local_points", "local_polynomial_regression", "nearest_centroid_classifier", "select_kernel_bandwidth", "tangent_space_discriminant_analysis", "tangent_space_logistic_regression"]
