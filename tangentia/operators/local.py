"""Dense work on a bounded number of rows."""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.functions import Geometry
from tangentia.operators.pairs import BINS, GATHERED, HELD, distances, plain_distances, stacked
from tangentia.session import reachable

#: Rows that dense operators take; a matrix of all distances has 200 MB then.
CAP = 5000
#: Different points up to which operators that can do without it work on a matrix of all distances.
DENSE = 2000
#: Entries of a matrix of distances that the driver holds (400 MB); of larger ones the blocks are made again each time.
MATRIX = 50_000_000


#: Rows that the first block of eigenvectors comes of.
STARTS = 150
#: Entries of products that tasks sum up, at most.
WIDE_SUMS = 4_000_000


class TooManyRows(ValueError):
    """A dense operator got more rows than it takes."""


def gathered(df: DataFrame, columns: list[str], id_col: str = "id", cap: int | None = CAP) -> list:
    """All rows in the order of their ids; more than the cap, if there is one, raise, none are dropped."""
    rows = df.select(id_col, *columns)
    rows = (rows if cap is None else rows.limit(cap + 1)).collect()
    if cap is not None and len(rows) > cap:
        raise TooManyRows(f"this operator is dense and takes {cap} rows at most; cluster or draw a coreset first, or raise the cap")
    if not rows:
        raise ValueError("no samples")
    return sorted(rows, key=lambda r: r[0])


def local_points(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", cap: int | None = CAP) -> tuple[list, np.ndarray]:
    rows = gathered(df, [point], id_col, cap)
    return [r[0] for r in rows], stacked(geometry, [r[1] for r in rows])


def local_distances(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", cap: int = CAP) -> tuple[list, np.ndarray, np.ndarray]:
    geometry.require("dist")
    ids, x = local_points(geometry, df, point, id_col, cap)
    d = distances(geometry, x, x)
    d = 0.5 * (d + d.T)
    np.fill_diagonal(d, 0)
    return ids, x, d


def equal_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each different point, in the order of rows; which of them each row is; rows of each)."""
    _, first, which, many = np.unique(x.reshape(len(x), -1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    return first[order], place[which.ravel()], many[order]


def distance_blocks(geometry: Geometry, x: np.ndarray):
    """(first row, distances of some rows to all), symmetric and 0 on the diagonal."""
    step = max(1, HELD // max(1, len(x)))
    for at in range(0, len(x), step):
        own = x[at : at + step]
        d = 0.5 * (distances(geometry, own, x) + distances(geometry, x, own).T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = 0
        yield at, d


def symmetric_distances(geometry: Geometry, x: np.ndarray) -> np.ndarray:
    """The matrix of all distances, filled by blocks, so that no second one is held."""
    out = np.empty((len(x), len(x)))
    for at, d in distance_blocks(geometry, x):
        out[at : at + len(d)] = d
    return out


def returned(df: DataFrame, ids: list, id_col: str, **columns) -> DataFrame:
    """A table of ids and results, by the type of each first value."""
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", list: "array<double>"}
    names, values = list(columns), [[_plain(v) for v in c] for c in columns.values()]
    kind = ", ".join(f"`{n}` {kinds[type(v[0])]}" for n, v in zip(names, values))
    return df.sparkSession.createDataFrame([(i, *r) for i, r in zip(ids, zip(*values))], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {kind}")


def _plain(v):
    if isinstance(v, np.ndarray):
        return v.ravel().astype(float).tolist()
    return v.item() if isinstance(v, np.generic) else v


def median_bandwidth(d: np.ndarray) -> float:
    """The median of the positive distances between different rows."""
    upper = d[np.triu_indices(len(d), 1)]
    upper = upper[upper > 0]
    return float(np.median(upper)) if len(upper) else 1.0


class Blocks:
    """A symmetric matrix as blocks of rows; rows(a, b, c): those from a to b, of the columns from c.

    The driver holds up to MATRIX entries. Of larger ones the executors make the blocks again for each pass, and hand on
    what becomes of them.
    """

    def __init__(self, size: int, rows, spark: SparkSession, held: int = HELD):
        self.size, self.rows, self.spark, self.held = size, rows, spark, None
        self.step = max(1, held // max(1, size))
        if size * size <= MATRIX:
            self.held = np.empty((size, size))
            for at in range(0, size, self.step):
                self.held[at : at + self.step] = rows(at, min(at + self.step, size), 0)

    @classmethod
    def of(cls, geometry: Geometry, x: np.ndarray, spark: SparkSession) -> Blocks:
        if len(x) ** 2 > MATRIX:
            return cls(len(x), lambda a, b, c: _zeroed(plain_distances(geometry, x[a:b], x[c:]), a - c), spark)
        return cls(len(x), lambda a, b, c: _zeroed(0.5 * (distances(geometry, x[a:b], x[c:]) + distances(geometry, x[c:], x[a:b]).T), a - c), spark)

    def __iter__(self):
        for at in range(0, self.size, self.step):
            yield at, self.rows(at, min(at + self.step, self.size), 0) if self.held is None else self.held[at : at + self.step]

    def each(self, f, fold=None, upper: bool = False) -> list:
        """f(block, first row) in the order of rows, or what fold(one, other) makes of them, task by task.

        upper: of a block the columns from its first row.
        """
        size, step, rows = self.size, self.step, self.rows
        if self.held is not None:
            got = [f(d[:, at:] if upper else d, at) for at, d in self]
            for g in got[1:] if fold else ():
                got[0] = fold(got[0], g)
            return got[:1] if fold else got
        reachable(self.spark)
        count = math.ceil(size / step)

        def run(parts):
            for pdf in parts:
                one = None
                for k in pdf["id"]:
                    at = int(k) * step
                    got = f(rows(at, min(at + step, size), at if upper else 0), at)
                    if fold is None:
                        yield pd.DataFrame({"at": [at], "r": [pickle.dumps(got)]})
                    else:
                        one = got if one is None else fold(one, got)
                if one is not None:
                    yield pd.DataFrame({"at": [int(pdf["id"].iloc[0])], "r": [pickle.dumps(one)]})

        # The blocks of a task lie all over the matrix, so that the tasks of an upper half are alike.
        tasks = min(count, (2 if fold and upper else 8) * self.spark.sparkContext.defaultParallelism)
        deal = self.spark.range(0, count, 1, tasks) if not upper else self.spark.createDataFrame(pd.DataFrame({"id": np.argsort(np.arange(count) % tasks, kind="stable")})).repartitionByRange(tasks, F.pmod("id", F.lit(tasks)))
        return [pickle.loads(r["r"]) for r in sorted(deal.mapInPandas(run, "at long, r binary").collect(), key=lambda r: r["at"])]

    def times(self, f, y: np.ndarray) -> np.ndarray:
        """f of the matrix times y; f takes blocks and their first rows."""
        return np.concatenate(self.each(lambda d, at: f(d, at) @ y))

    def symmetric_times(self, f, y: np.ndarray) -> np.ndarray:
        """times, of f that leaves the matrix symmetric and takes blocks alone; executors make each entry once."""
        if self.held is not None or self.size * y.shape[1] > WIDE_SUMS:
            return self.times(lambda d, _: f(d), y)
        size = self.size

        def both(d, at):
            a, n = f(d), len(d)
            out = np.zeros((size, y.shape[1]))
            out[at : at + n] = a @ y[at:]
            out[at + n :] += a[:, n:].T @ y[at : at + n]
            return out

        return reduce(_added, self.each(both, _added, True))


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def _zeroed(d: np.ndarray, at: int) -> np.ndarray:
    """d, with 0 where a row meets itself: the first in column at."""
    d[np.arange(len(d)), np.arange(at, at + len(d))] = 0
    return d


def weighted_bandwidth(blocks: Blocks, many: np.ndarray) -> float:
    """median_bandwidth of all rows, of which many[a] are at the different point a: exact, from counts by bins."""
    if blocks.held is not None and blocks.size <= DENSE and (many == 1).all():
        return median_bandwidth(blocks.held)
    many = many.astype(float)
    equal = bool((many == 1).all())

    def upper(d, at):
        """Distances of a block's rows to later ones, and how many pairs of rows each stands for."""
        keep = np.arange(d.shape[1]) > np.arange(len(d))[:, None]
        keep &= d > 0
        d = d[keep]
        return d, None if equal else (many[at : at + keep.shape[0], None] * many[at:])[keep]

    def counted(low, high):
        """Masses below low and above high; masses and entries by bins."""

        def f(d, at):
            d, w = upper(d, at)
            d -= low
            d *= BINS / (high - low)
            np.clip(d, -1, BINS, out=d)
            d += 1
            k = d.astype(np.int64)
            n = np.bincount(k, minlength=BINS + 2).astype(float)
            return n, n if equal else np.bincount(k, w, BINS + 2)

        entries, mass = blocks.each(f, lambda a, b: (a[0] + b[0], a[1] + b[1]), True), None
        entries, mass = (np.sum([e[k] for e in entries], axis=0) for k in range(2))
        return entries, mass

    low, high = 0.0, max(4 * float(blocks.rows(0, 1, 0).max()), 1e-300)
    while True:
        entries, mass = counted(low, high)
        total = mass.sum()
        if not total:
            return 1.0
        ranks, upto = ((total - 1) // 2, total // 2), np.cumsum(mass)
        first, last = (int(np.searchsorted(upto, r, side="right")) for r in ranks)
        if last > BINS:
            low, high = (low if first <= BINS else high), high * 16
            continue
        # A bin more on each side makes up for the rounding of bins' borders.
        first, last = max(first - 2, 0), min(last + 1, BINS)
        before, width = high - low, (high - low) / BINS
        few = entries[first + 1 : last + 1].sum() <= GATHERED
        low, high = low + first * width, high if last == BINS else low + last * width
        if few or high - low > before / 4 or high - low <= 1e-9 * high:
            break

    def taken(d, at):
        d, w = upper(d, at)
        inside = (d >= low) & (d < high)
        return d[inside], np.ones(int(inside.sum())) if equal else w[inside], float((d < low).sum() if equal else w[d < low].sum())

    found = blocks.each(taken, lambda a, b: (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), a[2] + b[2]), True)
    d, w, below = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), sum(x[2] for x in found)
    order = np.argsort(d, kind="stable")
    ends = below + np.cumsum(w[order])
    return float(sum(d[order][int(np.searchsorted(ends, r, side="right"))] for r in ranks) / 2)


def top_eigenpairs(times, n: int, k: int, seed: int = 0, tol: float = 1e-11, maxiter: int = 400, more: int = 6, begin: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their vectors, of a symmetric operator: block Lanczos, fully orthogonal, restarted.

    begin: the first block and its image. A step is one product with a block of k + more vectors; at the end the residuals are at most tol of the largest value.
    """
    width = min(k + more, n)
    q, image = begin or (np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0], None)
    width = q.shape[1]
    basis, images = np.empty((n, 0)), np.empty((n, 0))
    for _ in range(maxiter):
        image = times(q) if image is None else image
        basis, images = np.hstack([basis, q]), np.hstack([images, image])
        h = basis.T @ images
        w, c = np.linalg.eigh(0.5 * (h + h.T))
        w, c = w[::-1], c[:, ::-1]
        v, av = basis @ c[:, :k], images @ c[:, :k]
        scale = max(float(np.abs(w).max()), 1e-300)
        if np.linalg.norm(av - v * w[:k], axis=0).max() <= tol * scale or basis.shape[1] == n:
            return w[:k], v
        if basis.shape[1] + width > max(20 * width if more == 6 else 8 * width, 160):
            keep = min(2 * width, basis.shape[1])
            basis, images = basis @ c[:, :keep], images @ c[:, :keep]
        q, image = image, None
        for _ in range(2):
            q = q - basis @ (basis.T @ q)
            size = np.linalg.norm(q, axis=0)
            q = np.linalg.qr(np.where(size > 1e-13 * scale, q / np.maximum(size, 1e-300), np.random.default_rng(seed + basis.shape[1]).normal(size=q.shape)))[0]
        room = n - basis.shape[1]
        if room < q.shape[1]:
            q = np.linalg.qr(np.hstack([basis, np.random.default_rng(seed).normal(size=(n, room))]))[0][:, basis.shape[1] :]
    raise ValueError("eigenvectors didn't converge")


def more_vectors(blocks: Blocks) -> int:
    """Further vectors of a step: more of them need fewer steps, where a step makes the matrix again."""
    return 6 if blocks.held is not None else 30


def centred_eigenpairs(blocks: Blocks, f, many: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray | None]:
    """(k largest eigenvalues, the vectors at the different points, row means, mean, all eigenvalues or None) of the doubly
    centred matrix f(distances) of all rows, of which many[a] are at the point a.

    Vectors that tell equal points apart have the eigenvalue 0, so the different points with weights are enough.
    """
    root, share = np.sqrt(many), many / many.sum()
    if blocks.size <= DENSE:
        rows = blocks.times(lambda d, _: f(d), share)
        mean = float(share @ rows)
        gram = np.concatenate(blocks.each(lambda d, _: f(d))) - rows - rows[:, None] + mean
        w, y = np.linalg.eigh(0.5 * (gram + gram.T) * root[:, None] * root)
        w, y = w[::-1], y[:, ::-1]
        every, w, y = w, w[:k], y[:, :k]
    else:
        # The first block comes of some rows, and the row means with its product.
        more = more_vectors(blocks)
        some = np.sort(np.random.default_rng(0).choice(blocks.size, min(blocks.size, STARTS), replace=False))
        near = np.concatenate([f(blocks.rows(int(a), int(a) + 1, 0)) for a in some]) if blocks.held is None else f(blocks.held[some])
        own, vectors = np.linalg.eigh(near[:, some])
        q = np.linalg.qr(root[:, None] * (near.T @ vectors[:, np.argsort(-np.abs(own))[: min(k + more, len(some))]]))[0]
        t = root[:, None] * q
        got = blocks.symmetric_times(f, np.hstack([share[:, None], t]))
        rows = got[:, 0]
        mean = float(share @ rows)
        centred = lambda t, kt: root[:, None] * (kt - rows[:, None] * t.sum(0) - rows @ t + mean * t.sum(0))

        def times(y):
            t = root[:, None] * y
            return centred(t, blocks.symmetric_times(f, t))

        every, (w, y) = None, top_eigenpairs(times, blocks.size, k, more=more, begin=(q, centred(t, got[:, 1:])))
    return w, y / root[:, None], rows, mean, every


def rows_weight(df: DataFrame, weight: str | None):
    return F.lit(1.0) if weight is None else F.col(weight)
