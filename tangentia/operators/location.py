"""Intrinsic aggregates: means, medians, balls, robust and streaming locations, depth, ranks, bootstrap, coresets.

Each iteration is one distributed aggregate: executors sum weighted logarithms at the
current point of each group, and only the sums come back. Where a geometry is flat in a
chart, the mean is one native aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import Geometry
from tangentia.functions.columns import columns
from tangentia.operators.data import bound
from tangentia.operators.pairs import distances, stacked
from tangentia.session import cut, reachable, summed_arrays

#: Groups whose points the driver may hold.
MOST_GROUPS = 100_000
#: Rows that start an iteration where no point is given; the medoid of these.
START_ROWS = 256
#: Arrays of more entries are summed by position, not by one expression an entry.
WIDE = 16
#: Tuning constants of the M-estimators and the scale of the median of residuals.
TUNING = {"huber": 1.345, "cauchy": 2.385, "tukey": 4.685}
MAD = 0.67448975
#: Numbers of packed points and weights that the driver holds; more stay with the executors.
HELD = 1 << 22
#: Rows of a batch that the driver holds.
BLOCK = 1 << 16
#: Rows around the border of a trimming that the driver puts in order.
BORDER = 1 << 16
#: Turns of trimming before longer steps, and how many times the way to the mean a step is at most.
PLAIN, LONGEST = 5, 1000.0
#: Replicates that one row of the bootstrap's table draws for.
DRAWS = 64


@dataclass
class Location:
    """A point with how it was found."""

    point: np.ndarray
    objective: float
    iterations: int
    converged: bool
    reason: str
    gradient_norm: float = math.nan
    radius: float = math.nan
    diagnostics: dict = field(default_factory=dict)


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A uniform draw in (0, 1) that depends on the seed and the keys alone."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normalized_weights(df: DataFrame, weight: str | None) -> DataFrame:
    """df with `_w`, not negative and of sum 1; bad weights raise. One aggregate."""
    if weight is None:
        n = df.count()
        if not n:
            raise ValueError("no samples")
        return df.withColumn("_w", F.lit(1.0 / n))
    w = F.col(weight)
    r = df.agg(F.sum(w).alias("s"), F.count_if(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))).alias("bad")).first()
    if r["bad"] or not r["s"]:
        raise ValueError("weights are finite, not negative, and have a positive sum")
    return df.withColumn("_w", w / r["s"])


def _batch_moments(geometry: Geometry, base: np.ndarray, x: np.ndarray, w: np.ndarray, factor=None, rho=None) -> tuple[np.ndarray, float, float]:
    u = geometry.log(base[None], x)
    d2 = np.maximum(geometry.inner(base[None], u, u), 0) if geometry.name != "sphere" else geometry.squared_dist(base[None], x)
    d = np.sqrt(d2)
    f = w if factor is None else w * factor(d)
    u = np.where((f > 0).reshape((-1,) + (1,) * geometry.axes), u, 0)
    return (u.reshape(len(x), -1) * f[:, None]).sum(0), float(f.sum()), float((w * (d2 if rho is None else rho(d))).sum())


class Packed:
    """Points and `_w` of the rows of positive weight in batches, for iterations without groups.

    Up to HELD numbers the driver holds them, and an iteration is no job; more are a row a batch in the
    checkpoint folder, and an iteration is one job without a shuffle. With `order`, batches and rows lie in its order.
    """

    def __init__(self, geometry: Geometry, df: DataFrame, point: str, order: str | None = None):
        reachable(df.sparkSession)
        self.geometry = geometry
        few = df.count() * (geometry.length + 1) <= HELD
        rows = df.filter("_w > 0")
        rows = (rows if order is None else rows.orderBy(order, point)).select(F.col(point).alias("x"), F.col("_w").alias("w"))

        def pack(parts):
            part = TaskContext.get().partitionId()
            for i, b in enumerate(parts):
                if len(b):
                    yield pd.DataFrame({"s": [(part << 32) + i], "x": [stacked(geometry, b["x"]).tobytes()], "w": [b["w"].to_numpy(float).tobytes()]})

        packed = rows.mapInPandas(pack, "s long, x binary, w binary")
        self.df = None if few else cut(packed)
        if few:
            got = packed.collect()
            x, w = (np.frombuffer(b"".join(r[k] for r in got)) for k in ("x", "w"))
            x = x.reshape(-1, *geometry.shape)
            self.held = [(i, x[i : i + BLOCK], w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)]

    def each(self, f: Callable, fold: Callable) -> list:
        """fold of what f(number, points, weights) gives for the batches of a task, by task."""
        if self.df is None:
            return [fold([f(*b) for b in self.held])] if self.held else []

        def run(parts):
            got = None
            for pdf in parts:
                for s, x, w in zip(pdf["s"], pdf["x"], pdf["w"]):
                    one = f(int(s), np.frombuffer(x).reshape(-1, *shape), np.frombuffer(w))
                    got = one if got is None else fold([got, one])
            if got is not None:
                yield pd.DataFrame({"n": [got.shape[-1]], "r": [np.ascontiguousarray(got, float).tobytes()]})

        shape = self.geometry.shape
        return [np.frombuffer(r["r"]).reshape(-1, r["n"]) for r in self.df.mapInPandas(run, "n int, r binary").collect()]

    def total(self, f: Callable) -> np.ndarray:
        """The sum of f over the batches."""
        got = self.each(f, lambda a: np.sum(a, axis=0))
        if not got:
            raise ValueError("no samples")
        return np.sum([g.ravel() for g in got], axis=0)

    def moments(self, base: np.ndarray, factor=None, rho=None, weights: Callable | None = None) -> tuple[np.ndarray, float, float]:
        """_batch_moments of all rows; weights(number, points, weights) replaces those of a batch."""
        geometry, n = self.geometry, self.geometry.length

        def own(s, x, w):
            if weights is not None:
                w = weights(s, x, w)
                x, w = x[w > 0], w[w > 0]
            u, f, c = _batch_moments(geometry, base, x, w, factor, rho)
            return np.concatenate([u, [f, c]])

        got = self.total(own)
        return got[:n].reshape(geometry.shape), float(got[n]), float(got[n + 1])

    def _border(self, base: np.ndarray, target: Callable[[float], float], counted: bool = False) -> tuple[np.ndarray, float, float]:
        """((distance, number of the batch, mass) of rows, the mass before them, the target): in these rows the mass by distance from base reaches target(whole mass).

        Masses by the leading bits of the distances narrow the border, until its rows are few or all equally
        far; the latter are one a batch. counted: every row has a mass of 1.
        """
        geometry, begin, shift, before, want = self.geometry, 0, 64, 0.0, None
        far = lambda x: np.abs(geometry.dist(base[None], x))
        while want is None or least > BORDER and shift > 0:
            low, last = begin, shift
            shift = max(shift - 12, 0)

            def masses(s, x, w, low=low, last=last, shift=shift):
                k = far(x).view(np.uint64)
                here = slice(None) if last == 64 else k >> np.uint64(last) == np.uint64(low >> last)
                at = ((k[here] >> np.uint64(shift)) & np.uint64((1 << (last - shift)) - 1)).astype(int)
                n = np.bincount(at, minlength=1 << (last - shift))
                return np.concatenate([n if counted else np.bincount(at, w[here], 1 << (last - shift)), n])

            mass, count = self.total(masses).reshape(2, -1)
            want = target(mass.sum()) if want is None else want
            upto = before + np.cumsum(mass)
            reached = (upto >= want - 1e-15) & (count > 0)
            at = int(reached.argmax()) if reached.any() else int(np.flatnonzero(count)[-1])
            before, begin, least = float(upto[at] - mass[at]), begin + (at << shift), count[at]
        low, last = np.uint64(begin >> shift), np.uint64(shift)

        def border(s, x, w):
            d = far(x)
            at = np.flatnonzero(d.view(np.uint64) >> last == low)
            d, w = d[at], np.ones(len(at)) if counted else w[at]
            if shift == 0 and len(at):
                d, w = d[:1], w.sum()[None]
            return np.stack([d, np.full(len(d), float(s)), w], 1)

        rows = np.concatenate(self.each(border, np.concatenate))
        # Batches of a task are in order, and those of one distance stay so.
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))], before, want

    def median_distance(self, base: np.ndarray) -> float:
        """The median of the rows' distances from base, which their weights don't change."""
        middle = []
        for k in (lambda n: (n + 1) // 2, lambda n: n // 2 + 1):
            rows, before, want = self._border(base, k, counted=True)
            middle.append(rows[int((before + np.cumsum(rows[:, 2]) < want).sum()), 0])
        return float(sum(middle) / 2)

    def nearest(self, base: np.ndarray, keep: float) -> Callable:
        """Weights of the first `keep` of the mass by distance from base, then in the order of rows; the row on the border counts in part."""
        geometry = self.geometry
        rows, before, target = self._border(base, lambda whole: keep * whole)
        upto = before + np.cumsum(rows[:, 2])
        at = min(int((upto < target - 1e-15).sum()), len(rows) - 1)
        limit, number = rows[at, 0], int(rows[at, 1])
        group = (rows[:, 0] == limit) & (rows[:, 1] == number)
        room = target - float(upto[group][0] - rows[group][0, 2])

        def weights(s, x, w):
            d = np.abs(geometry.dist(base[None], x))
            out = np.where(d < limit, w, 0.0)
            tie = d == limit
            if s < number:
                out[tie] = w[tie]
            elif s == number:
                out[tie] = np.clip(room - (np.cumsum(w[tie]) - w[tie]), 0, w[tie])
            return out

        return weights


def moments(geometry: Geometry, df: DataFrame | Packed, bases: dict, point: str, group: str | None, factor: Callable[[np.ndarray], np.ndarray] | None = None, rho: Callable[[np.ndarray], np.ndarray] | None = None) -> dict:
    """By group: (sum of f w log, sum of f w, sum of w rho) at the group's base.

    f = factor(distances), 1 by default; rho = squared distances by default. df has `_w`, or is Packed.
    """
    if isinstance(df, Packed):
        return {0: df.moments(bases[0], factor, rho)}
    reachable(df.sparkSession)
    key = F.lit(0) if group is None else F.col(group)
    kind = "int" if group is None else df.schema[group].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(bases)

    def run(parts):
        for pdf in parts:
            rows = []
            for g, own in pdf.groupby("g", sort=False):
                if g in sent.value:
                    rows.append((g, *_batch_moments(geometry, sent.value[g], stacked(geometry, own["x"]), own["w"].to_numpy(float), factor, rho)))
            if rows:
                yield pd.DataFrame(rows, columns=["g", "u", "f", "c"])

    rows = df.select(key.alias("g"), F.col(point).alias("x"), F.col("_w").alias("w")).filter("w > 0")
    parts = rows.mapInPandas(run, f"g {kind}, u array<double>, f double, c double")
    return _summed(geometry, parts)


def _summed(geometry: Geometry, parts: DataFrame) -> dict:
    n = geometry.length
    if n > WIDE:
        got = summed_arrays(parts.select("g", F.concat("u", F.array("f", "c")).alias("s")), "g", "s")
        return {g: (s[:n].reshape(geometry.shape), s[n], s[n + 1]) for g, s in got.items()}
    sums = parts.groupBy("g").agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(n)]).alias("u"), F.sum("f").alias("f"), F.sum("c").alias("c"))
    return {r["g"]: (np.array(r["u"], float).reshape(geometry.shape), r["f"], r["c"]) for r in sums.collect()}


def start_points(geometry: Geometry, df: DataFrame, point: str, group: str | None, power: int = 2) -> dict:
    """By group: the medoid of the START_ROWS rows with the least hash."""
    rows = None
    if group is not None:
        # One row of each of START_ROWS parts of a group, so that no task gathers a group.
        h = F.xxhash64(point)
        part = df.filter("_w > 0").select(F.col(group).alias("g"), F.pmod(h, F.lit(START_ROWS)).alias("p"), h.alias("h"), F.col(point).alias("x"), "_w")
        few = part.groupBy("g", "p").agg(F.min_by(F.struct("x", "_w"), F.col("h")).alias("r"))
        rows = few.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(F.col("r.x").alias("x"), F.col("r._w").alias("w")))).alias("x"))
    if rows is None:
        few = df.filter("_w > 0").select(F.xxhash64(point).alias("h"), F.col(point).alias("x"), "_w").orderBy("h").limit(START_ROWS).collect()
        if not few:
            raise ValueError("no samples")
        x, w = stacked(geometry, [r["x"] for r in few]), np.array([r["_w"] for r in few])
        return {0: x[int((distances(geometry, x, x) ** power @ w).argmin())]}
    out = {}
    for r in rows.limit(MOST_GROUPS + 1).toLocalIterator():
        x = stacked(geometry, [e["x"] for e in r["x"]])
        out[r["g"]] = x[int((distances(geometry, x, x) ** power @ np.array([e["w"] for e in r["x"]])).argmin())]
    if len(out) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return out


def _chart_mean(geometry: Geometry, df: DataFrame, point: str, group: str | None) -> dict | None:
    """Closed-form means of geometries that are flat in a chart, by one native aggregate over chart coordinates."""
    into = {"euclidean": None, "spd_log_euclidean": ("logm", "expm"), "correlation_ecm": ("chart", "chart_inverse"), "correlation_lec": ("chart", "chart_inverse")}
    if geometry.name not in into:
        return None
    ops = into[geometry.name]
    z = F.col(point) if ops is None else columns(geometry).call(ops[0], point)
    key = F.lit(0).alias("g") if group is None else F.col(group).alias("g")
    sums = df.select(key, z.alias("z"), "_w").groupBy("g").agg(F.array(*[F.sum(F.get("z", F.lit(i)) * F.col("_w")) / F.sum("_w") for i in range(geometry.length)]).alias("z"))
    back = (lambda a: a) if ops is None else getattr(geometry, ops[1])
    return {r["g"]: back(np.array(r["z"], float).reshape(1, *geometry.shape))[0] for r in sums.collect()}


def frechet_means(geometry: Geometry, df: DataFrame, point: str = "point", group: str | None = None, weight: str | None = None, initial: dict | None = None, maxiter: int = 200, tol: float = 1e-7, measure: Callable[[dict], dict] | None = None, rows: Packed | None = None) -> dict[object, Location]:
    """By group (0 without one): argmin of the weighted squared distances.

    measure: what moments gives at the groups' points, where df's own rows don't tell; needs `initial`.
    rows: the rows of df, where they are packed already.

    Steps along the mean logarithm, of a length by Barzilai and Borwein's rule, halved where the
    cost doesn't fall. tol is raised to the root of the machine precision. Groups number MOST_GROUPS at most.
    """
    geometry.require("exp", "log", "dist")
    bound(df, point, geometry)
    df = normalized_weights(df, weight) if measure is None else df
    closed = _chart_mean(geometry, df, point, group) if initial is None else None
    if closed is not None:
        m = moments(geometry, df, closed, point, group)
        return {g: Location(p, float(m[g][2] / m[g][1]), 0, True, "closed form", _norm(geometry, p, m[g][0] / m[g][1])) for g, p in closed.items()}
    tol = max(tol, math.sqrt(np.finfo(float).eps))
    at = {g: geometry.project(np.asarray(p, float)[None])[0] for g, p in initial.items()} if initial else start_points(geometry, df, point, group)
    if measure is None:
        rows = df if group is not None else rows or Packed(geometry, df, point)
        measure = lambda live: moments(geometry, rows, live, point, group)
    out, step, last = {}, dict.fromkeys(at, 1.0), {}
    for it in range(maxiter + 1):
        live = {g: p for g, p in at.items() if g not in out}
        if not live:
            break
        for g, (u, f, c) in measure(live).items():
            u, c = u / f, float(c / f)
            size = _norm(geometry, at[g], u)
            if g in last and c > last[g][1] * (1 + 1e-12) + 1e-300:
                step[g] *= 0.5
                at[g], u = last[g][0], last[g][2]
                if step[g] < 1e-6:
                    out[g] = Location(at[g], last[g][1], it, False, "no descent", _norm(geometry, at[g], u))
                    continue
            elif size <= tol or not np.isfinite(size):
                out[g] = Location(at[g], c, it, bool(np.isfinite(size)), "gradient tolerance" if np.isfinite(size) else "logarithm undefined", size)
                continue
            elif it == maxiter:
                out[g] = Location(at[g], c, it, False, "iteration limit", size)
                continue
            else:
                if g in last:
                    step[g] = _spectral_step(geometry, last[g][0], at[g], step[g], last[g][2], u)
                last[g] = (at[g], c, u)
            at[g] = geometry.exp(at[g][None], step[g] * u[None])[0]
    for g, p in at.items():
        out.setdefault(g, Location(p, math.nan, maxiter, False, "iteration limit"))
    return out


def _spectral_step(geometry: Geometry, old: np.ndarray, new: np.ndarray, step: float, u: np.ndarray, v: np.ndarray) -> float:
    """The step length that fits the change of the mean logarithm from u at old to v at new; within [0.2, 5]."""
    moved = geometry.transport(old[None], new[None], u[None])
    inner = lambda a, b: float(geometry.inner(new[None], a, b)[0])
    bend = inner(moved, moved - v[None])
    length = step * inner(moved, moved) / bend if bend > 0 else 1.0
    return float(min(max(length, 0.2), 5.0)) if np.isfinite(length) else 1.0


def _norm(geometry: Geometry, p: np.ndarray, u: np.ndarray) -> float:
    return float(geometry.norm(p[None], u[None])[0])


def frechet_mean(geometry: Geometry, df: DataFrame, point: str = "point", weight: str | None = None, initial_point=None, maxiter: int = 200, tol: float = 1e-7) -> Location:
    return frechet_means(geometry, df, point, None, weight, None if initial_point is None else {0: np.asarray(initial_point, float).reshape(geometry.shape)}, maxiter, tol)[0]


def frechet_medians(geometry: Geometry, df: DataFrame, point: str = "point", group: str | None = None, weight: str | None = None, initial: dict | None = None, smoothing: float = 1e-8, maxiter: int = 200, tol: float = 1e-7, rows: Packed | None = None) -> dict[object, Location]:
    """By group: argmin of the weighted distances, by Weiszfeld's weights w / max(d, smoothing)."""
    geometry.require("exp", "log", "dist")
    df = normalized_weights(df, weight)
    rows = df if group is not None else rows or Packed(geometry, df, point)
    at = initial or {g: m.point for g, m in frechet_means(geometry, df, point, group, weight, maxiter=100, tol=max(tol, 1e-6), rows=None if group is not None else rows).items()}
    out = {}
    for it in range(maxiter + 1):
        live = {g: p for g, p in at.items() if g not in out}
        if not live:
            break
        for g, (u, f, c) in moments(geometry, rows, live, point, group, lambda d: 1 / np.maximum(d, smoothing), lambda d: d).items():
            size = _norm(geometry, at[g], u / f)
            if size <= tol or it == maxiter:
                out[g] = Location(at[g], float(c), it, size <= tol, "direction tolerance" if size <= tol else "iteration limit", size)
            else:
                at[g] = geometry.exp(at[g][None], (u / f)[None])[0]
    return out


def frechet_median(geometry: Geometry, df: DataFrame, point: str = "point", weight: str | None = None, **more) -> Location:
    return frechet_medians(geometry, df, point, None, weight, **more)[0]


def _farthest(geometry: Geometry, df: DataFrame, point: str, id_col: str, base: np.ndarray) -> tuple[float, object, np.ndarray]:
    b = F.array(*[F.lit(float(v)) for v in base.ravel()])
    r = df.withColumn("_d", columns(geometry).dist(b, F.col(point))).orderBy(F.desc("_d"), id_col).select("_d", F.col(id_col).alias("id"), F.col(point).alias("x")).first()
    return r["_d"], r["id"], np.array(r["x"], float).reshape(geometry.shape)


def minimum_enclosing_ball(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", initial_point=None, maxiter: int = 500, tol: float = 1e-7) -> Location:
    """Centre and radius: steps of 1 / (k + 1) towards the farthest row, from the row of the smallest id."""
    geometry.require("exp", "log", "dist")
    if initial_point is None:
        at = np.array(df.orderBy(id_col).select(point).first()[0], float).reshape(geometry.shape)
    else:
        at = geometry.project(np.asarray(initial_point, float).reshape(1, *geometry.shape))[0]
    before, best = math.inf, None
    for it in range(maxiter):
        r, _, far = _farthest(geometry, df, point, id_col, at)
        if best is None or r < best.radius:
            best = Location(at, r, it, False, "iteration limit", radius=r)
        if it >= 2 and abs(before - r) <= tol * max(1, r):
            best.converged, best.reason = True, "radius tolerance"
            break
        before = r
        at = geometry.exp(at[None], geometry.log(at[None], far[None]) / (it + 2))[0]
    return best


def robust_factor(loss: str, scale: float) -> tuple[Callable, Callable]:
    """(weight of a residual, its loss times scale squared) of huber, cauchy or tukey."""
    k = TUNING[loss]

    def weight(d):
        z = d / scale
        if loss == "huber":
            return np.where(z <= k, 1.0, k / np.maximum(z, 1e-300))
        if loss == "cauchy":
            return 1 / (1 + (z / k) ** 2)
        return np.where(z < k, (1 - (z / k) ** 2) ** 2, 0.0)

    def rho(d):
        z = d / scale
        if loss == "huber":
            v = np.where(z <= k, z * z / 2, k * z - k * k / 2)
        elif loss == "cauchy":
            v = k * k / 2 * np.log1p((z / k) ** 2)
        else:
            v = k * k / 6 * np.where(z < k, 1 - (1 - (z / k) ** 2) ** 3, 1.0)
        return v * scale * scale

    return weight, rho


def _distance_column(geometry: Geometry, df: DataFrame, point: str, base: np.ndarray, name: str = "_d") -> DataFrame:
    b = F.array(*[F.lit(float(v)) for v in np.ravel(base)])
    return df.withColumn(name, columns(geometry).dist(b, F.col(point)))


def geodesic_m_estimator(geometry: Geometry, df: DataFrame, point: str = "point", loss: str = "huber", scale: float | None = None, weight: str | None = None, initial_point=None, maxiter: int = 100, tol: float = 1e-6) -> Location:
    """Iteratively reweighted mean; the scale is the median residual at the start / 0.67448975 and stays."""
    if loss not in TUNING:
        raise ValueError(f"loss is one of {sorted(TUNING)}")
    df = normalized_weights(df, weight)
    rows = Packed(geometry, df, point)
    at = frechet_median(geometry, df, point, weight, tol=tol, rows=rows).point if initial_point is None else np.asarray(initial_point, float).reshape(geometry.shape)
    if scale is None:
        middle = rows.median_distance(at) if weight is None else _distance_column(geometry, df, point, at).agg(F.percentile("_d", 0.5)).first()[0]
        scale = max(middle / MAD, 1e-8)
    f, rho = robust_factor(loss, scale)
    c = math.nan
    for it in range(maxiter):
        u, mass, c = rows.moments(at, f, rho)
        if mass <= 0:
            return Location(at, c, it, False, "all weights vanish", diagnostics={"scale": scale})
        moved = geometry.exp(at[None], (u / mass)[None])[0]
        gap = float(geometry.dist(at[None], moved[None])[0])
        at = moved
        if gap <= tol:
            return Location(at, c, it + 1, True, "movement tolerance", diagnostics={"scale": scale})
    return Location(at, c, maxiter, False, "iteration limit", diagnostics={"scale": scale})


def trimmed_frechet_mean(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", trim_fraction: float = 0.1, weight: str | None = None, initial_point=None, maxiter: int = 100, tol: float = 1e-6) -> Location:
    """Mean of the nearest 1 - trim_fraction of the mass, in turn with the trimming; the row on the border counts in part.

    Where rows are spread evenly the means move little; after PLAIN turns they are passed by steps of Barzilai and Borwein's
    length, and a step after which the nearest rows lie no nearer than about the mean is taken back.
    """
    if not 0 <= trim_fraction < 1:
        raise ValueError("trim_fraction lies in [0, 1)")
    df = normalized_weights(df, weight)
    rows = Packed(geometry, df, point, id_col)
    at = frechet_median(geometry, df, point, weight, tol=tol, rows=rows).point if initial_point is None else np.asarray(initial_point, float).reshape(geometry.shape)
    step, last, safe = 1.0, None, None
    for it in range(maxiter):
        kept = rows.nearest(at, 1 - trim_fraction)
        if safe is not None:
            _, mass, cost = rows.moments(at, weights=kept)
            if cost / mass > safe.objective * (1 + 1e-12):
                at, step, last, safe = safe.point, 1.0, None, None
                continue
        m = frechet_means(geometry, df, point, initial={0: at}, tol=tol, measure=lambda live, kept=kept: {g: rows.moments(p, weights=kept) for g, p in live.items()})[0]
        gap = float(geometry.dist(at[None], m.point[None])[0])
        if gap <= tol:
            return Location(m.point, m.objective, it + 1, True, "movement tolerance", m.gradient_norm)
        if it < PLAIN:
            at = m.point
            continue
        u = geometry.log(at[None], m.point[None])[0]
        if last is not None:
            step = _longer_step(geometry, last[0], at, step, last[1], u)
        last, safe = (at, u), m
        at = geometry.exp(at[None], step * u[None])[0]
    return Location(m.point, m.objective, maxiter, False, "iteration limit", m.gradient_norm)


def _longer_step(geometry: Geometry, old: np.ndarray, new: np.ndarray, step: float, u: np.ndarray, v: np.ndarray) -> float:
    """How far to go along v at new, where going step along u led from old; from 1 to LONGEST."""
    moved = geometry.transport(old[None], new[None], u[None])
    inner = lambda a, b: float(geometry.inner(new[None], a, b)[0])
    bend = inner(moved, moved - v[None])
    length = step * inner(moved, moved) / bend if bend > 0 else 2 * step
    return float(min(max(length, 1.0), LONGEST)) if np.isfinite(length) else 1.0


def geodesic_spatial_depth(geometry: Geometry, points: DataFrame, reference: DataFrame, point: str = "point", id_col: str = "id", weight: str | None = None) -> DataFrame:
    """(id, depth): 1 - the length of the weighted mean of unit logarithms towards the reference, clipped to [0, 1]."""
    from tangentia.operators.pairs import _sides

    geometry.require("log", "dist")
    reachable(points.sparkSession)
    ref = normalized_weights(reference, weight)
    a, b = _sides(points, ref, id_col, id_col, point, point, 1024)
    b = b.join(ref.select(F.col(id_col).alias("j"), F.col("_w").alias("w")), "j")
    kind = points.schema[id_col].dataType.simpleString()

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q, w = stacked(geometry, x["x"]), stacked(geometry, y["y"]), y["w"].to_numpy(float)
        rows = []
        for i, one in zip(x["i"], p):
            u = geometry.log(one[None], q)
            d = geometry.norm(one[None], u)
            f = np.where(d > 1e-12, w / np.maximum(d, 1e-300), 0)
            rows.append((i, (u.reshape(len(q), -1) * f[:, None]).sum(0), one.ravel()))
        return pd.DataFrame(rows, columns=["i", "u", "x"])

    sums = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(meet, f"i {kind}, u array<double>, x array<double>")
    n = geometry.length
    mean = sums.groupBy("i").agg(F.array(*[F.sum(F.get("u", F.lit(k))) for k in range(n)]).alias("u"), F.first("x").alias("x"))
    depth = 1 - columns(geometry).norm(F.col("x"), F.col("u"))
    return mean.select(F.col("i").alias(id_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), depth)).alias("depth"))


def metric_distance_ranks(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", center=None, weight: str | None = None) -> DataFrame:
    """df with `score` (the distance to the centre, the median by default) and `rank`: the midrank / n.

    Scores that agree to 9 digits are ties. One count per different score is put in order, by ranges, not the rows.
    """
    c = frechet_median(geometry, df, point, weight).point if center is None else np.asarray(center, float)
    rows = _distance_column(geometry, df, point, c, "score").withColumn("_tie", F.round("score", 9))
    counts = rows.groupBy("_tie").agg(F.count("*").cast("double").alias("_n"))
    ranked, total = running_sums(counts, "_tie", "_n")
    ranks = ranked.select("_tie", ((F.col("_before") + 0.5 * (F.col("_n") + 1)) / total).alias("rank"))
    return rows.join(ranks, "_tie").drop("_tie")


def running_sums(df: DataFrame, order: str, value: str) -> tuple[DataFrame, float]:
    """(df with `_before`: the sum of a column over the rows before in order, the whole sum). Rows are dealt by ranges of the order, of which only the sums meet."""
    from pyspark.sql import Window as W

    parts = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sums = {r["_p"]: r["s"] for r in parts.groupBy("_p").agg(F.sum(value).alias("s")).collect()}
    before, total = {}, 0.0
    for p in sorted(sums):
        before[p], total = total, total + sums[p]
    own = F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    if not before:
        return parts.withColumn("_before", F.lit(0.0)).drop("_p"), 0.0
    starts = df.sparkSession.createDataFrame(list(before.items()), "_p int, _start double")
    return parts.join(F.broadcast(starts), "_p").withColumn("_before", own + F.col("_start")).drop("_p", "_start"), total


def streaming_fold(geometry: Geometry, points: np.ndarray, weights: np.ndarray, start: np.ndarray | None = None, mass: float = 0.0) -> tuple[np.ndarray | None, float]:
    """The inductive mean: each point of positive weight moves it by w / (mass so far with w)."""
    at = start if mass > 0 else None
    for x, w in zip(points, weights):
        if w <= 0:
            continue
        mass += w
        at = x if at is None else geometry.exp(at[None], (w / mass) * geometry.log(at[None], x[None]))[0]
    return at, mass


def streaming_frechet_mean(geometry: Geometry, df: DataFrame, point: str = "point", order: str = "id", weight: str | None = None, initial_point=None, initial_weight: float = 0.0) -> Location:
    """One pass over the rows. A start point counts only with a positive initial_weight, on the scale where all rows weigh 1.

    Rows are dealt by ranges of the order; each task folds its own in order, and the tasks' means, with
    their weights, are folded in the order of the ranges. In flat geometries that is the fold of
    all rows; in curved ones it differs from it as folds in two orders do. frechet_mean minimises the cost.
    """
    if initial_weight < 0 or (initial_weight > 0 and initial_point is None):
        raise ValueError("initial_weight is not negative and needs an initial_point")
    df = normalized_weights(df, weight)
    reachable(df.sparkSession)

    def fold(parts):
        at, mass, rows, least = None, 0.0, 0, None
        for pdf in parts:
            at, mass = streaming_fold(geometry, stacked(geometry, pdf["x"]), pdf["w"].to_numpy(float), at, mass)
            rows, least = rows + len(pdf), pdf["p"].iloc[0] if len(pdf) else least
        if at is not None:
            yield pd.DataFrame({"p": [least], "x": [at.ravel()], "w": [mass], "n": [rows]})

    dealt = df.select(F.col(order).alias("o"), F.col(point).alias("x"), F.col("_w").alias("w")).repartitionByRange("o").sortWithinPartitions("o")
    dealt = dealt.select(F.spark_partition_id().alias("p"), "x", "w")
    found = sorted(dealt.mapInPandas(fold, "p int, x array<double>, w double, n long").collect(), key=lambda r: r["p"])
    at = None if initial_point is None else np.asarray(initial_point, float).reshape(geometry.shape)
    at, mass = streaming_fold(geometry, stacked(geometry, [r["x"] for r in found]), [r["w"] for r in found], at, initial_weight)
    return Location(at, math.nan, sum(r["n"] for r in found), True, "one pass", diagnostics={"mass": mass})


#: Rows whose batches one task takes one after another; the tasks' results are averaged after each epoch.
TASK_ROWS = 65_536


def minibatch_epoch(df: DataFrame, seed: int, epoch: int, n: int, point: str, id_col: str, task, fields: str) -> list:
    """Rows of task(points, weights, number of the task) over df (with `_w`), dealt anew by the epoch and put in an order of hashes; one job."""
    reachable(df.sparkSession)
    tasks = max(1, math.ceil(n / TASK_ROWS))
    u = hash_uniform(seed + epoch, id_col)
    dealt = df.filter("_w > 0").select(F.floor(u * tasks).cast("int").alias("t"), u.alias("u"), F.col(point).alias("x"), F.col("_w").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", kind="stable")
        return pd.DataFrame(task(pdf["x"], pdf["w"].to_numpy(float)))

    return dealt.groupBy("t").applyInPandas(run, fields).collect()


def minibatch_frechet_mean(geometry: Geometry, df: DataFrame, seed: int, point: str = "point", id_col: str = "id", batch_size: int = 32, epochs: int = 10, weight: str | None = None, initial_point=None, learning_rate: float = 1.0, decay: float = 0.1, tol: float = 1e-6) -> Location:
    """Steps of learning_rate / (1 + decay k) by hash-dealt batches; an epoch deals anew and is one job.

    Up to TASK_ROWS rows are one task, which takes its batches one after another. Of more
    rows every task does so from the epoch's start, and the means they reach are averaged by their weights.
    """
    df = normalized_weights(df, weight)
    n = df.count()
    at = start_points(geometry, df, point, None)[0] if initial_point is None else np.asarray(initial_point, float).reshape(geometry.shape)
    k = 0
    for e in range(epochs):
        begin, done = at, k

        def task(x, w, begin=begin, done=done):
            x, here, most, k = stacked(geometry, x), begin, 0.0, done
            for i in range(0, len(x), batch_size):
                u = geometry.log(here[None], x[i : i + batch_size])
                own = w[i : i + batch_size]
                step = (learning_rate / (1 + decay * k)) * (u * own.reshape((-1,) + (1,) * geometry.axes)).sum(0) / own.sum()
                moved = geometry.exp(here[None], step[None])[0]
                most, here, k = max(most, float(geometry.dist(here[None], moved[None])[0])), moved, k + 1
            return {"x": [here.ravel()], "w": [w.sum()], "most": [most], "k": [k - done]}

        got = minibatch_epoch(df, seed, e, n, point, id_col, task, "x array<double>, w double, most double, k long")
        w = np.array([r["w"] for r in got])
        u = geometry.log(begin[None], stacked(geometry, [r["x"] for r in got]))
        at = geometry.exp(begin[None], (u * (w / w.sum()).reshape((-1,) + (1,) * geometry.axes)).sum(0)[None])[0]
        k += max(r["k"] for r in got)
        if max(r["most"] for r in got) <= tol:
            return Location(at, math.nan, e + 1, True, "movement tolerance")
    return Location(at, math.nan, epochs, False, "epoch limit")


def bootstrap_frechet_mean(geometry: Geometry, df: DataFrame, seed: int, point: str = "point", id_col: str = "id", n_bootstrap: int = 999, confidence_level: float = 0.95, weight: str | None = None, maxiter: int = 100, tol: float = 1e-6) -> tuple[Location, DataFrame]:
    """(estimate with radius, replicates of (replicate, point, distance)).

    Replicates weigh rows by Poisson counts of their mean n * weight, drawn from a hash of seed,
    replicate and id; all replicates iterate together, and a row draws for DRAWS of them at once.
    """
    df = normalized_weights(df, weight)
    n = df.count()
    mean = frechet_mean(geometry, df, point, weight, maxiter=maxiter, tol=tol)
    drawn = F.transform(F.sequence(F.col("r"), F.least(F.col("r") + DRAWS, F.lit(n_bootstrap)) - 1), lambda r: hash_uniform(seed, r, id_col))
    reps = df.filter("_w > 0").select(F.col(id_col), F.col(point).alias("x"), (F.col("_w") * n).alias("lam"), F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1), F.lit(DRAWS))).alias("r"))
    reps = reps.select("x", "lam", "r", drawn.alias("u"))
    reachable(df.sparkSession)

    def measure(bases: dict) -> dict:
        sent = df.sparkSession.sparkContext.broadcast(bases)

        def run(parts):
            for pdf in parts:
                rows = []
                for first, own in pdf.groupby("r", sort=False):
                    u, x, p = np.stack(own["u"].to_numpy()), stacked(geometry, own["x"]), np.exp(-own["lam"].to_numpy(float))
                    # The Poisson counts: how many cumulated probabilities lie below the draw.
                    k, upto, lam = np.zeros(u.shape), p.copy(), own["lam"].to_numpy(float)
                    for i in range(1, 25):
                        above = u > upto[:, None]
                        if not above.any():
                            break
                        k += above
                        p = p * lam / i
                        upto = upto + p
                    for r in range(u.shape[1]):
                        live = k[:, r] > 0
                        if first + r in sent.value and live.any():
                            rows.append((first + r, *_batch_moments(geometry, sent.value[first + r], x[live], k[live, r])))
                if rows:
                    yield pd.DataFrame(rows, columns=["g", "u", "f", "c"])

        return _summed(geometry, reps.mapInPandas(run, "g int, u array<double>, f double, c double"))

    got = frechet_means(geometry, df, point, None, None, {r: mean.point for r in range(n_bootstrap)}, maxiter, tol, measure)
    rows = [(int(r), m.point.ravel().tolist(), float(geometry.dist(mean.point[None], m.point[None])[0])) for r, m in sorted(got.items())]
    mean.radius = float(np.quantile([r[2] for r in rows], confidence_level))
    return mean, df.sparkSession.createDataFrame(rows, "replicate int, point array<double>, distance double")


def lightweight_coreset(geometry: Geometry, df: DataFrame, size: int, seed: int, point: str = "point", id_col: str = "id", weight: str | None = None) -> DataFrame:
    """`size` systematic draws: (id, point, weight of sum 1) with sensitivities half w and half w d^2 / sum.

    Rows lie in an order of hashes, each as long as its sensitivity; the draws are equally far apart
    along them, from a random start. A row is drawn as often as draws fall on it.
    """
    df = normalized_weights(df, weight)
    m = frechet_mean(geometry, df, point, weight)
    rows = _distance_column(geometry, df, point, m.point).withColumn("_c", F.col("_w") * F.pow("_d", 2))
    s = rows.agg(F.sum("_c")).first()[0] or 0.0
    share = 0.5 * F.col("_w") + (0.5 * F.col("_c") / s if s > 0 else 0.5 * F.col("_w"))
    rows, total = running_sums(rows.withColumn("_s", share).filter("_s > 0").withColumn("_u", hash_uniform(seed, id_col)), "_u", "_s")
    begin = float(np.random.default_rng(seed).random())
    upto = lambda c: F.ceil(c / total * size - begin)
    times = F.least(upto(F.col("_before") + F.col("_s")), F.lit(size)) - F.least(upto(F.col("_before")), F.lit(size))
    drawn = cut(rows.select(F.col(id_col), F.col(point), (times * F.col("_w") / (size * F.col("_s"))).alias("weight")).filter(times > 0))
    whole = drawn.agg(F.sum("weight")).first()[0]
    return drawn.withColumn("weight", F.col("weight") / whole)


def extrinsic_mean(geometry: Geometry, df: DataFrame, point: str = "point", group: str | None = None) -> DataFrame:
    """(group, mean): the normalised mean vector of sphere points, or the circular means of angles; one native aggregate."""
    by = [F.col(group)] if group else []
    n = geometry.length
    if geometry.name == "torus":
        mean = F.array(*[F.atan2(F.avg(F.sin(F.get(point, F.lit(i)))), F.avg(F.cos(F.get(point, F.lit(i))))) for i in range(n)])
        return df.groupBy(*by).agg(mean.alias("mean"))
    if not geometry.name.startswith("sphere"):
        raise ValueError("extrinsic means are of spheres and tori")
    sums = df.groupBy(*by).agg(F.array(*[F.avg(F.get(point, F.lit(i))) for i in range(n)]).alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v))
    mean = F.transform("m", lambda v: F.when(size > geometry.eps, v / size).otherwise(float("nan")))
    return sums.select(*by, mean.alias("mean"))

