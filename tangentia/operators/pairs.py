"""Distance joins, nearest neighbours, medoids and interpolation.

The two sides meet in blocks: each side is dealt into blocks by its id, and one task holds
one block of each, so that memory is bounded whatever the tables' sizes, and a block of
distances is one call of the batched kernels.

Joins by radius and nearest neighbours of metric distances meet in cells: a row of the right side lies
in the cell of its nearest pivot, and a row of the left side visits only cells that
the triangle inequality leaves open. If x lies in the cell of p, and y is within r of x,
then d(y, p) <= r + d(x, p) <= r + d(x, q) <= 2 r + d(y, q) for all pivots q, and d(y, p) is at most
r more than the cell's radius. Cells of many rows are dealt into blocks. Where neighbours would visit
more than a share of all pairs, as among points spread over many dimensions, no cells are made: all
blocks meet, in larger blocks, so that fewer copies of a row are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import Geometry
from tangentia.functions.columns import columns
from tangentia.operators.data import bound, stamped
from tangentia.session import cut, reachable

#: Rows of a block.
BLOCK = 2048
#: Rows of a block where all blocks meet, at most, and what part of the rows it is where that is less.
WIDE_BLOCK, BLOCKS = 16_384, 8
#: Distances of a block that are held at once.
HELD = 2_000_000
#: Neighbours meet in cells where these leave open one pair in so many.
SPARED = 4
#: Rows that a batch of visits has at most.
VISITS = 10_000
#: Bins of a histogram of distances, and distances of a bin that the driver takes.
BINS, GATHERED = 1 << 16, 1_000_000
#: Pivots at most; tables of up to a block have one.
PIVOTS = 256
#: Geometries whose distances keep the triangle inequality.
METRIC = frozenset("euclidean sphere simplex poincare hyperboloid torus spd_log_euclidean spd_affine_invariant spd_bures_wasserstein correlation_ecm correlation_lec special_orthogonal grassmann".split())
#: What rounding may take from an inequality.
SLACK = 1e-7


def stacked(geometry: Geometry, points) -> np.ndarray:
    """Points of a pandas or Python sequence as a batch."""
    return np.stack([np.asarray(p, float) for p in points]).reshape(-1, *geometry.shape) if len(points) else np.empty((0, *geometry.shape))


def distances(geometry: Geometry, x: np.ndarray, y: np.ndarray, squared: bool = False) -> np.ndarray:
    """All distances between two batches."""
    if geometry.name in ("sphere", "sphere_extrinsic"):
        d = np.arccos(np.clip(x @ y.T, -1, 1))
        return d * d if squared else d
    if geometry.name == "euclidean":
        a, b = x.reshape(len(x), -1), y.reshape(len(y), -1)
        d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0) if a.shape[1] > 8 else ((a[:, None] - b[None]) ** 2).sum(-1)
        return d2 if squared else np.sqrt(d2)
    if geometry.name == "simplex":
        d = 2 * np.arccos(np.clip(np.sqrt(x) @ np.sqrt(y).T, -1, 1))
        return d * d if squared else d
    step = max(1, 200_000 // max(1, len(y) * geometry.length))
    parts = [geometry.squared_dist(x[i : i + step, None], y[None]) for i in range(0, len(x), step)]
    d2 = np.maximum(np.concatenate(parts), 0) if parts else np.empty((0, len(y)))
    return d2 if squared else np.sqrt(d2)


def plain_distances(geometry: Geometry, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """distances, to rounding, by closed forms of few passes where there are some: for work on all pairs of large tables."""
    if geometry.name not in ("euclidean", "torus", "poincare") or geometry.length > 8:
        return distances(geometry, x, y)
    a, b = x.reshape(len(x), -1), y.reshape(len(y), -1)
    out, gap = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    step = max(1, 50_000 // max(1, len(b)))
    both = np.concatenate([a, b])
    turns = np.ptp(both, axis=0) > np.pi if geometry.name == "torus" and len(both) else np.zeros(a.shape[1], bool)
    for at in range(0, len(a), step):
        own, o, g = a[at : at + step], out[at : at + step], gap[at : at + step]
        for k in range(a.shape[1]):
            np.subtract(own[:, k, None], b[:, k], out=g)
            if turns[k]:
                np.abs(g, out=g)
                np.minimum(g, np.abs(2 * np.pi - g), out=g)
            np.multiply(g, g, out=g)
            o += g
        if geometry.name == "poincare":
            o *= 1 / (1 - (own * own).sum(1))[:, None]
            o *= 1 / (1 - (b * b).sum(1))
        if geometry.name == "poincare":
            # Twice the inverse hyperbolic sine of the root.
            np.sqrt(o + 1, out=g)
            g += 1
            np.divide(o, g, out=g)
            np.sqrt(o, out=o)
            o += g
            # numpy's log1p is several times slower than its log, and needed where o is small alone.
            near = o < 0.01
            small = np.log1p(o[near])
            o += 1
            np.log(o, out=o)
            o[near] = small
            o *= 2
        else:
            np.sqrt(o, out=o)
    return out


def _sides(left: DataFrame, right: DataFrame, lid: str, rid: str, point: str, other: str, block: int) -> tuple[DataFrame, DataFrame]:
    n, m = (max(1, math.ceil(df.count() / block)) for df in (left, right))
    a = left.select(F.col(lid).alias("i"), F.col(point).alias("x"), F.pmod(F.xxhash64(lid), F.lit(n)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("b"))
    b = right.select(F.col(rid).alias("j"), F.col(other).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("a"), F.pmod(F.xxhash64(rid), F.lit(m)).alias("b"))
    return a, b


def _ids(left: DataFrame, right: DataFrame, lid: str, rid: str) -> str:
    return f"i {left.schema[lid].dataType.simpleString()}, j {right.schema[rid].dataType.simpleString()}, distance double"


def pairwise_distances(geometry: Geometry, df: DataFrame, other: DataFrame | None = None, point: str = "point", id_col: str = "id", squared: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, distance) of all rows of df with all of other, or of itself (both directions and i = j included)."""
    geometry.require("dist")
    right = df if other is None else other
    for side in (df, right):
        bound(side, point, geometry)
    reachable(df.sparkSession)
    a, b = _sides(df, right, id_col, id_col, point, point, block)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = distances(geometry, stacked(geometry, x["x"]), stacked(geometry, y["y"]), squared)
        return pd.DataFrame({"i": np.repeat(x["i"].to_numpy(), len(y)), "j": np.tile(y["j"].to_numpy(), len(x)), "distance": d.ravel()})

    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(meet, _ids(df, right, id_col, id_col))


def pairs_once(geometries: dict[str, tuple[Geometry, str]], df: DataFrame, id_col: str = "id", block: int = BLOCK // 2) -> DataFrame:
    """(i, j, a distance for each name) of all rows i < j; geometries: by name, a geometry and the column of its points.

    All distances of two rows are taken where they meet, once, so that no table of pairs is shuffled or joined.
    """
    for name, (geometry, point) in geometries.items():
        geometry.require("dist")
        bound(df, point, geometry)
    reachable(df.sparkSession)
    n = max(1, math.ceil(df.count() / block))
    own, to = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda i, x, a, b: df.select(F.col(id_col).alias(i), *[F.col(p).alias(f"{x}{k}") for k, (_, p) in enumerate(geometries.values())], a.alias("a"), b.alias("b")).filter("a <= b")
    left, right = side("i", "x", own, to), side("j", "y", to, own)

    def meet(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j = x["i"].to_numpy(), y["j"].to_numpy()
        keep = i[:, None] < j[None] if key[0] == key[1] else np.ones((len(i), len(j)), bool)
        a, b = np.nonzero(keep)
        flip = i[a] > j[b]
        out = {"i": np.where(flip, j[b], i[a]), "j": np.where(flip, i[a], j[b])}
        for k, (name, (geometry, _)) in enumerate(geometries.items()):
            out[name] = distances(geometry, stacked(geometry, x[f"x{k}"]), stacked(geometry, y[f"y{k}"]))[keep]
        return pd.DataFrame(out)

    kind = df.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"`{name}` double" for name in geometries)
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, f"i {kind}, j {kind}, {fields}")


def _pivots(geometry: Geometry, df: DataFrame, point: str, id_col: str, n: int, block: int) -> np.ndarray | None:
    """Rows with the least hash of their id as pivots; None where cells are of no use."""
    k = min(PIVOTS, 2 * math.ceil(n / block))
    if geometry.name not in METRIC or n <= block:
        return None
    return stacked(geometry, [r[0] for r in df.select(point).orderBy(F.xxhash64(id_col), id_col).limit(k).collect()])


def _celled(geometry: Geometry, df: DataFrame, pivots: np.ndarray, point: str, id_col: str) -> DataFrame:
    """(j, y, cell, d) of the rows with their nearest pivot."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts):
        for pdf in parts:
            d = distances(geometry, stacked(geometry, pdf["y"]), pivots)
            yield pdf.assign(cell=d.argmin(1).astype(np.int32), d=d.min(1))

    return df.select(F.col(id_col).alias("j"), F.col(point).alias("y")).mapInPandas(run, f"j {kind}, y array<double>, cell int, d double")


def _visiting(geometry: Geometry, df: DataFrame, pivots: np.ndarray, far: dict, point: str, id_col: str, reach: str | float, skip: str | None = None, sizes: dict | None = None) -> DataFrame:
    """(i, x, cell) of the cells that rows within `reach` (a number, or a column) may lie in; far: radius of each cell that has rows.

    skip: a column of cells that are visited already. sizes: rows of each cell; then (n), the pairs that are left, by batch.
    """
    kind = df.schema[id_col].dataType.simpleString()
    radius = np.array([far.get(c, -np.inf) for c in range(len(pivots))])
    many = np.array([(sizes or {}).get(c, 0) for c in range(len(pivots))])
    columns_ = [F.col(id_col).alias("i"), F.col(point).alias("x"), (F.col(reach) if isinstance(reach, str) else F.lit(float(reach))).alias("r"), (F.col(skip) if skip else F.lit(-1)).cast("int").alias("s")]

    def run(parts):
        for pdf in parts:
            d, r = distances(geometry, stacked(geometry, pdf["x"]), pivots), pdf["r"].to_numpy(float)[:, None]
            with np.errstate(invalid="ignore"):
                open_ = (d <= d.min(1, keepdims=True) + 2 * r + SLACK) & (d <= radius + r + SLACK)
            open_ &= np.arange(len(pivots)) != pdf["s"].to_numpy()[:, None]
            if sizes is not None:
                yield pd.DataFrame({"n": [int((open_ @ many).sum())]})
                continue
            row, cell = np.nonzero(open_)
            for k in range(0, len(row), VISITS):
                r, c = row[k : k + VISITS], cell[k : k + VISITS]
                yield pd.DataFrame({"i": pdf["i"].to_numpy()[r], "x": pdf["x"].to_numpy()[r], "cell": c.astype(np.int32)})

    return df.select(*columns_).mapInPandas(run, f"i {kind}, x array<double>, cell int" if sizes is None else "n long")


def _in_cells(left: DataFrame, right: DataFrame, block: int):
    """Both sides, grouped by cell and block; left: i, x, cell, right: j, y, cell."""
    size = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = cut(size(left, "m").join(size(right, "n"), "cell"))
    deal = lambda df, own, other, k, many: (
        df.join(F.broadcast(blocks), "cell").withColumn(own, F.pmod(F.xxhash64(k), F.col(many))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n" if many == "m" else "m").cast("long") - 1))).drop("m", "n")
    )
    return deal(left, "a", "b", "i", "m").groupBy("cell", "a", "b"), deal(right, "b", "a", "j", "n").groupBy("cell", "a", "b")


def distance_join(geometry: Geometry, df: DataFrame, other: DataFrame, radius: float, point: str = "point", id_col: str = "id", block: int = BLOCK) -> DataFrame:
    """(i, j, distance) of the pairs within the radius."""
    geometry.require("dist")
    reachable(df.sparkSession)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = distances(geometry, stacked(geometry, x["x"]), stacked(geometry, y["y"]))
        i, j = np.nonzero(d <= radius)
        return pd.DataFrame({"i": x["i"].to_numpy()[i], "j": y["j"].to_numpy()[j], "distance": d[i, j]})

    pivots = _pivots(geometry, other, point, id_col, other.count(), block)
    if pivots is None:
        a, b = _sides(df, other, id_col, id_col, point, point, block)
        a, b = a.groupBy("a", "b"), b.groupBy("a", "b")
    else:
        right = cut(_celled(geometry, other, pivots, point, id_col))
        far = {r["cell"]: r["d"] for r in right.groupBy("cell").agg(F.max("d").alias("d")).collect()}
        a, b = _in_cells(cut(_visiting(geometry, df, pivots, far, point, id_col, radius)), right.drop("d"), block)
    return a.cogroup(b).applyInPandas(meet, _ids(df, other, id_col, id_col))


def nearest_of(geometry: Geometry, x: np.ndarray, y: np.ndarray, k: int, same: Callable[[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y, of equally near ones the first; same(from, to): pairs to leave out.

    The least of every 64 columns bound the k-th distance from above; only what is within the bound is put in
    order. On spheres the bound is one of inner products, and only their angles are taken that may be among the k.
    """
    k, step, groups = min(k, len(y)), max(1, HELD // max(1, len(y))), len(y) // 64
    angles = geometry.name in ("sphere", "sphere_extrinsic")
    out = []
    for at in range(0, len(x), step):
        key = -(x[at : at + step] @ y.T) if angles else distances(geometry, x[at : at + step], y)
        if same is not None:
            key[same(at, at + len(key))] = np.inf
        least = key[:, : groups * 64].reshape(len(key), groups, 64).min(2) if groups >= k else key
        bound_ = np.partition(least, k - 1, axis=1)[:, k - 1] + (1e-12 if angles else 0)
        odd = np.isnan(bound_)
        row, col = np.nonzero((key <= bound_[:, None]) | odd[:, None])
        d = key[row, col]
        if angles:
            d = np.where(np.isinf(d), np.inf, np.arccos(np.clip(-d, -1, 1)))
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[first] + at, col[first], d[first]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def median_distance(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", block: int | None = None) -> float | None:
    """The exact median of the positive distances between different rows; None without any.

    Counts by bins tell the bin of the middle, which is cut into bins again until the driver can take its
    different distances. Each pass meets every two rows once.
    """
    geometry.require("dist")
    reachable(df.sparkSession)
    n = df.count()
    blocks = max(1, math.ceil(n / (block or wide_block(n))))
    rows = cut(df.select(F.col(id_col).alias("i"), F.col(point).alias("x"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("o")))
    to = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("i", "x", F.col("o").alias("a"), to.alias("b")).filter("a <= b")
    right = rows.select("i", "x", to.alias("a"), F.col("o").alias("b")).filter("a <= b")

    def passed(low: float, high: float, take: bool) -> DataFrame:
        def meet(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            x, y = x.sort_values("i", kind="stable"), y.sort_values("i", kind="stable")
            p, q = stacked(geometry, x["x"]), stacked(geometry, y["x"])
            counts, found, below, step = np.zeros(BINS + 2, np.int64), [], 0, max(1, HELD // max(1, len(q)))
            for at in range(0, len(p), step):
                d = distances(geometry, p[at : at + step], q)
                d = d[np.arange(len(q)) > np.arange(at, at + len(d))[:, None]] if key[0] == key[1] else d.ravel()
                d = d[d > 0]
                if take:
                    below += int((d < low).sum())
                    found.append(d[(d >= low) & (d < high)])
                else:
                    counts[0] += (d < low).sum()
                    inside = d[(d >= low) & (d < high)]
                    counts[-1] += (d >= high).sum()
                    counts[1:-1] += np.bincount(np.minimum(((inside - low) * (BINS / (high - low))).astype(np.int64), BINS - 1), minlength=BINS)
            if take:
                v = np.concatenate([[-1.0], *found])
                return pd.DataFrame({"v": v, "n": np.where(v < 0, below, 1)})
            full = np.flatnonzero(counts)
            return pd.DataFrame({"v": full.astype(float), "n": counts[full]})

        met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
        return met.applyInPandas(meet, "v double, n long")

    low, high = 0.0, 4.0
    while True:
        got = {int(r["v"]): r["n"] for r in passed(low, high, False).groupBy("v").agg(F.sum("n").alias("n")).collect()}
        total = sum(got.values())
        if not total:
            return None
        counts = np.array([got.get(k, 0) for k in range(BINS + 2)])
        upto = np.cumsum(counts)
        first, last = (int(np.searchsorted(upto, r, side="right")) for r in ((total - 1) // 2, total // 2))
        if last > BINS:
            low, high = (low, high * 16) if first <= BINS else (high, high * 16)
            continue
        # A bin more on each side makes up for the rounding of bins' borders.
        edges = np.append(low + np.arange(BINS) * ((high - low) / BINS), high)
        before, low, high = high - low, float(edges[max(first - 2, 0)]), float(edges[min(last + 1, BINS)])
        if counts[max(first - 1, 1) : last + 2].sum() <= GATHERED or high - low > before / 4 or high - low <= 1e-9 * high:
            break
    rows = passed(low, high, True)
    below = rows.filter("v < 0").agg(F.sum("n")).first()[0]
    own = rows.filter("v >= 0").groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect()
    values, ends = [r["v"] for r in own], below + np.cumsum([r["n"] for r in own])
    return sum(values[int(np.searchsorted(ends, r, side="right"))] for r in ((total - 1) // 2, total // 2)) / 2


def wide_block(n: int) -> int:
    """Rows of a block where all blocks of n rows meet."""
    return min(WIDE_BLOCK, max(BLOCK, math.ceil(n / BLOCKS)))


def nearest_neighbors(geometry: Geometry, df: DataFrame, queries: DataFrame | None = None, n_neighbors: int = 5, exclude_self: bool = True, point: str = "point", id_col: str = "id", block: int = BLOCK) -> DataFrame:
    """(query_id, rank from 1, neighbor_id, distance): the nearest rows of df, of equally near ones the smaller id.

    Without queries, df's own rows ask, and by default don't find themselves. A query
    first meets the rows of its own cell; the last of the n_neighbors best there bounds how far
    it looks in others. Each block hands on its n_neighbors best alone, so the final choice
    sees n_neighbors rows per query and block.
    """
    geometry.require("dist")
    own = queries is None
    asked = df if own else queries
    bound(df, point, geometry)
    if n_neighbors < 1:
        raise ValueError("n_neighbors is 1 at least")
    reachable(df.sparkSession)
    skip = own and exclude_self

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("j", kind="stable")
        i, j = x["i"].to_numpy(), y["j"].to_numpy()
        row, col, d = nearest_of(geometry, stacked(geometry, x["x"]), stacked(geometry, y["y"]), n_neighbors, (lambda a, b: i[a:b, None] == j[None]) if skip else None)
        out = pd.DataFrame({"i": i[row], "j": j[col], "distance": d})
        return out[out["i"] != out["j"]] if skip else out

    met = lambda a, b: a.cogroup(b).applyInPandas(meet, _ids(asked, df, id_col, id_col))
    n, found = df.count(), None
    pivots = _pivots(geometry, df, point, id_col, n, block)
    if pivots is not None:
        right = cut(_celled(geometry, df, pivots, point, id_col))
        cells = right.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()
        far, sizes = {r["cell"]: r["d"] for r in cells}, {r["cell"]: r["n"] for r in cells}
        right = right.drop("d")
        left = cut(_celled(geometry, asked, pivots, point, id_col).select(F.col("j").alias("i"), F.col("y").alias("x"), "cell"))
        near = cut(met(*_in_cells(left, right, block)))
        last = F.array_sort(F.collect_list("distance"))
        reach = near.groupBy("i").agg(last.alias("d")).select("i", F.get("d", F.lit(n_neighbors - 1)).alias("reach"))
        rest = left.join(reach, "i", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        pairs = _visiting(geometry, rest, pivots, far, "x", "i", "reach", "cell", sizes).agg(F.sum("n")).first()[0] or 0
        if pairs * SPARED <= n * left.count():
            found = near.unionAll(met(*_in_cells(cut(_visiting(geometry, rest, pivots, far, "x", "i", "reach", "cell")), right, block)))
    if found is None:
        a, b = _sides(asked, df, id_col, id_col, point, point, block if n <= block else max(block, wide_block(n)))
        found = met(a.groupBy("a", "b"), b.groupBy("a", "b"))
    best = found.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "j"))), 1, n_neighbors).alias("best"))
    return best.select(F.col("i").alias("query_id"), F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.j").alias("neighbor_id"), F.col("b.distance").alias("distance"))


def block_sums(geometry: Geometry, df: DataFrame, other: DataFrame, sums, fields: str, more: list[Column] = (), point: str = "point", id_col: str = "id", block: int = BLOCK, left: list[Column] = ()) -> DataFrame:
    """(i, fields) by block of `other`, of sums(distances, i's frame, j's frame), a dict of columns; distances never leave the blocks.

    more, left: columns of `other` that the frame of j has besides j and y, and of df that that of i has.
    """
    reachable(df.sparkSession)
    a, b = _sides(df, other, id_col, id_col, point, point, block)
    if more:
        b = b.join(other.select(F.col(id_col).alias("j"), *more), "j")
    if left:
        a = a.join(df.select(F.col(id_col).alias("i"), *left), "i")
    kind = df.schema[id_col].dataType.simpleString()

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("j", kind="stable")
        return pd.DataFrame({"i": x["i"].to_numpy(), **sums(plain_distances(geometry, stacked(geometry, x["x"]), stacked(geometry, y["y"])), x, y)})

    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(meet, f"i {kind}, {fields}")


def geodesic_interpolation(geometry: Geometry, df: DataFrame, x: str, y: str, times: list[float], out: str = "point") -> DataFrame:
    """A row for each time: column t, and the point at t on the geodesic from x to y."""
    geometry.require("exp", "log")
    rows = df.withColumn("t", F.explode(F.array(*[F.lit(float(s)) for s in times])))
    return rows.withColumn(out, stamped(columns(geometry).interpolate(x, y, F.col("t")), out, geometry))


def tangent_space_map(source: Geometry, target: Geometry, df: DataFrame, point: str, source_base, target_base, transform, out: str = "mapped") -> DataFrame:
    """exp at the target's base of transform(log at the source's base); transform: Column -> Column."""
    source.require("log")
    target.require("exp")
    a, b = (F.array(*[F.lit(float(v)) for v in np.ravel(p)]) for p in (source_base, target_base))
    moved = columns(target).tangent_project(b, transform(columns(source).log(a, F.col(point))))
    return df.withColumn(out, stamped(columns(target).exp(b, moved), out, target))


def medoid(geometry: Geometry, df: DataFrame, point: str = "point", id_col: str = "id", weight: Column | None = None, squared: bool = True) -> dict:
    """The row with the least weighted sum of (squared) distances to all, of equal ones the smallest id: id and cost."""
    geometry.require("dist")
    bound(df, point, geometry)
    part = block_sums(geometry, df, df, lambda d, x, y: {"cost": (d * d if squared else d) @ y["w"].to_numpy(float)}, "cost double", [(weight if weight is not None else F.lit(1.0)).alias("w")], point, id_col)
    r = part.groupBy("i").agg(F.sum("cost").alias("cost")).orderBy("cost", "i").first()
    return {"id": r["i"], "cost": r["cost"]}
