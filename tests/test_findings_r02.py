"""Findings of round 2: each of these failed before its change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangentia.functions import *  # noqa: F403
from tangentia.operators import clustering as C
from tangentia.operators import data as D
from tangentia.operators import embedding as E
from tangentia.operators import learning as L
from tangentia.operators import local as Lo
from tangentia.operators import location as Loc
from tangentia.operators import pairs as P
from tangentia.operators import prediction as Pr
from tangentia.operators import transport as T
from tangentia.plans import catalogue, closed_forms


def rows(spark, points, geometry, **more):
    kind = {int: "long", float: "double"}
    names, columns_ = list(more), list(more.values())
    schema = "id long, point array<double>" + "".join(f", {n} {kind[type(c[0])]}" for n, c in zip(names, columns_))
    df = spark.createDataFrame([(i, np.ravel(p).astype(float).tolist(), *r) for i, (p, *r) in enumerate(zip(points, *columns_))], schema)
    return df.withColumn("point", D.stamped(F.col("point"), "point", geometry))


@pytest.mark.parametrize("m", [Stiefel(2, 1), StiefelEuclidean(2, 1), GeneralizedStiefel(2, 1), Stiefel(4, 2)], ids=repr)
def test_frames_shoot_in_batches(m, monkeypatch):
    """a batch needs as many exponentials as its longest pair, and a row that isn't finite spoils no other."""
    rng = np.random.default_rng(4)
    x = m.random_point(rng, 400)
    y = m.exp(x, m.random_tangent(rng, x, 0.8, True))
    want = [m.log(p, q) for p, q in zip(x[:20], y[:20])]
    inside = getattr(m, "plain", m)
    calls, exp = [], type(inside).exp
    monkeypatch.setattr(type(inside), "exp", lambda self, p, u: calls.append(1) or exp(self, p, u))
    x[30] = np.nan
    got = m.log(x, y)
    assert len(calls) < 250 and np.allclose(got[:20], want, atol=1e-8)
    assert np.isnan(got[30]).all() and np.isnan(got).any((1, 2)).sum() == 1
    x, y, got = (np.delete(v, 30, 0) for v in (x, y, got))
    assert np.allclose(m.exp(x, got), y, atol=1e-7)


@pytest.mark.parametrize("m, n", [(Sphere(24), 900), (Torus(2), 700)], ids=repr)
def test_neighbours_of_spread_points_make_no_visits(spark, monkeypatch, m, n):
    """points of many dimensions visited every cell with a copy of each row; now all blocks meet."""
    x = m.random_point(np.random.default_rng(6), n)
    x = np.concatenate([x, x[:60]])
    df, dealt = rows(spark, x, m), []
    visiting = P._visiting
    monkeypatch.setattr(P, "_visiting", lambda *a: dealt.append(len(a) == 9) or visiting(*a))
    got = [(r[0], r[2]) for r in P.nearest_neighbors(m, df, n_neighbors=4, block=100).orderBy("query_id", "rank").collect()]
    d = P.distances(m, x, x)
    np.fill_diagonal(d, np.inf)
    assert got == [(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:4]]
    assert dealt == ([True] if m.name == "sphere" else [True, False])


def test_nearest_of_a_block():
    """The bound by columns keeps ties in the order of rows, pairs left out, and points that aren't finite."""
    rng = np.random.default_rng(7)
    for m in (Sphere(3), Euclidean(2)):
        y = m.random_point(rng, 500)
        y[200:400] = y[:200]
        y[450] = np.nan
        x = y[::7]
        d = P.distances(m, x, y)
        i, j, v = P.nearest_of(m, x, y, 6)
        want = np.argsort(d, axis=1, kind="stable")[:, :6]
        assert np.array_equal(j.reshape(-1, 6), want) and np.array_equal(i, np.repeat(np.arange(len(x)), 6))
        assert np.allclose(v, np.take_along_axis(d, want, 1).ravel(), atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("gathered", [5, 1_000_000])
def test_median_of_distances(spark, monkeypatch, gathered):
    """the median comes of counts by bins, not of a table of all distances."""
    monkeypatch.setattr(P, "GATHERED", gathered)
    monkeypatch.setattr(P, "pairwise_distances", None)
    rng = np.random.default_rng(8)
    for m, x in ((Sphere(5), Sphere(5).random_point(rng, 300)), (Euclidean(1), rng.integers(0, 900, (250, 1)).astype(float)), (Euclidean(1), np.ones((3, 1)))):
        d = P.distances(m, x, x)[np.triu_indices(len(x), 1)]
        got = P.median_distance(m, rows(spark, x, m), block=60)
        assert got is None if not (d > 0).any() else got == pytest.approx(np.median(d[d > 0]), abs=1e-12)


def test_dictionary_takes_more_than_five_thousand_rows(spark):
    """F8"""
    m = PoincareBall(2)
    x = np.random.default_rng(9).uniform(-0.6, 0.6, (5200, 2))
    d = L.manifold_dictionary_learning(m, rows(spark, x, m), 3, seed=2, maxiter=2)
    assert d.atoms.shape == (3, 2) and all(b <= a + 1e-9 for a, b in zip(d.history, d.history[1:]))


def test_local_lines_take_more_than_five_thousand_rows(spark):
    """F12, F13"""
    rng = np.random.default_rng(10)
    t, y = rng.integers(0, 25, 5200).astype(float), rng.normal(size=5200)
    s = rows(spark, y[:, None], Euclidean(1), t=t.tolist())
    got = {r["t"]: r["prediction"][0] for r in Pr.local_polynomial_regression(Euclidean(1), s, "t", 4.0).transform(s.dropDuplicates(["t"]), "t").collect()}
    for q, v in got.items():
        k = np.exp(-0.5 * ((t - q) / 4) ** 2)
        assert v == pytest.approx(np.polyval(np.polyfit(t - q, y, 1, w=np.sqrt(k)), 0.0), abs=1e-8)
    assert len(got) == 25


def test_complete_streams_stay_off_the_driver(spark, sf):
    """sessions are as many as events; they come as files, and no table in memory holds them."""
    before = {t.name for t in spark.catalog.listTables()}
    out = closed_forms.QUERIES["streamed_sessions"](spark, sf)
    assert out.inputFiles() and not {t.name for t in spark.catalog.listTables()} - before
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_pairs_meet_once(spark, monkeypatch):
    """distances of several geometries come from one meeting of the rows, without a join of tables of pairs."""
    rng = np.random.default_rng(12)
    x, m = rng.uniform(-0.6, 0.6, (90, 2)), PoincareBall(2)
    df = rows(spark, x, m).withColumn("flat", D.stamped(F.col("point"), "flat", Euclidean(2)))
    out = P.pairs_once({"curved": (m, "point"), "flat": (Euclidean(2), "flat")}, df, block=20)
    got = {(r["i"], r["j"]): (r["curved"], r["flat"]) for r in out.collect()}
    assert set(got) == {(i, j) for i in range(90) for j in range(i + 1, 90)} and out.count() == len(got)
    curved, flat = P.distances(m, x, x), P.distances(Euclidean(2), x, x)
    assert all(v == pytest.approx((curved[k], flat[k]), abs=1e-12) for k, v in got.items())
    assert "Join" not in catalogue.QUERIES["poincare_supplier_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_medoids_take_more_than_five_thousand_rows(spark):
    """F14"""
    m, x = Euclidean(1), np.random.default_rng(13).integers(0, 400, (5300, 1)).astype(float)
    k = C.kmedoids(m, rows(spark, x, m), 3)
    got = k.labels.orderBy("id").toPandas()
    assert len(got) == 5300 and k.converged
    for c, center in enumerate(k.centers):
        own = x[got["cluster"] == c]
        assert np.abs(own - own.T).sum(1).min() == pytest.approx(got["distance"][got["cluster"] == c].sum())


@pytest.mark.parametrize("cap", [10, 5000])
def test_regularized_values_take_more_than_five_thousand_rows(spark, monkeypatch, cap):
    """sums over equal points, as a matrix and by conjugate gradients, agree with the system of all rows."""
    monkeypatch.setattr(L, "CAP", cap)
    rng = np.random.default_rng(14)
    for n, many in ((120, 25), (5100, 25)):
        x, y = rng.integers(0, many, (n, 1)).astype(float), rng.normal(size=n)
        y[x[:, 0] < 6] = np.nan
        s = rows(spark, x, Euclidean(1), y=[float(v) for v in y])
        got = L.manifold_regularized_regression(Euclidean(1), s, "y").orderBy("id").toPandas()["prediction"].to_numpy()
        assert len(got) == n and np.isfinite(got).all()
        if n == 120:
            d = np.abs(x - x.T)
            h = np.median(d[np.triu_indices(n, 1)][d[np.triu_indices(n, 1)] > 0])
            w = np.exp(-(d**2) / (2 * h * h)) - np.eye(n)
            known = ~np.isnan(y)
            want = np.linalg.solve(np.diag(known + 1e-3 + w.sum(1)) - w, np.where(known, y, 0))
            assert np.allclose(got, want, atol=1e-8)


def merged_plainly(d, n_clusters, linkage):
    """Hierarchical clustering by its definition: the tree, and the labels of the cut."""
    n, clusters, tree, cutting = len(d), {i: [i] for i in range(len(d))}, [], None
    how = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    while True:
        if len(clusters) == n_clusters:
            cutting = [list(clusters[k]) for k in sorted(clusters)]
        if len(clusters) == 1:
            break
        h, a, b = min((round(float(how(d[np.ix_(clusters[a], clusters[b])])), 12), a, b) for a in clusters for b in clusters if a < b)
        tree.append((a, b, h, len(clusters[a]) + len(clusters[b])))
        clusters[n + len(tree) - 1] = clusters.pop(a) + clusters.pop(b)
    return np.array(tree), np.array([next(c for c, own in enumerate(cutting) if i in own) for i in range(n)])


@pytest.mark.parametrize("linkage, dense", [("single", 2000), ("single", 2), ("complete", 2000), ("average", 2000)])
def test_hierarchies_keep_ties_and_equal_points(spark, monkeypatch, linkage, dense):
    """Merges of different points, of equal ones first, and along a spanning tree, are those of the definition."""
    monkeypatch.setattr(C, "DENSE", dense)
    rng = np.random.default_rng(15)
    for x in (rng.integers(0, 4, (24, 2)).astype(float), rng.normal(size=(20, 2)), rng.integers(0, 30, (22, 1)).astype(float)):
        m = Euclidean(x.shape[1])
        k = C.agglomerative_clustering(m, rows(spark, x, m), 3, linkage)
        tree, label = merged_plainly(P.distances(m, x, x), 3, linkage)
        assert np.allclose(k.linkage, tree) and k.labels.orderBy("id").toPandas()["cluster"].tolist() == label.tolist()


@pytest.mark.parametrize("linkage", ["single", "average"])
def test_hierarchies_take_more_than_five_thousand_rows(spark, linkage):
    """F16, F21"""
    m, x = Euclidean(1), np.random.default_rng(16).integers(0, 300, (5300, 1)).astype(float)
    x[x > 150] += 1000
    k = C.agglomerative_clustering(m, rows(spark, x, m), 2, linkage)
    assert k.linkage.shape == (5299, 4) and np.array_equal(k.labels.orderBy("id").toPandas()["cluster"].to_numpy() == k.labels.orderBy("id").first()["cluster"], (x[:, 0] > 500) == (x[0, 0] > 500))


@pytest.mark.parametrize("dense, matrix, gathered", [(2000, 50_000_000, 1_000_000), (5, 1, 30)])
def test_kernel_components_weigh_equal_points(spark, monkeypatch, dense, matrix, gathered):
    """a matrix of the different points, and products with blocks of it, give the components of all rows."""
    for name, value in (("DENSE", dense), ("MATRIX", matrix), ("GATHERED", gathered)):
        monkeypatch.setattr(Lo, name, value)
    m, x = Euclidean(2), np.random.default_rng(17).uniform(0, 3, (40, 2))
    x = np.concatenate([x, x[:25], x[:10]])
    df = rows(spark, x, m)
    k = E.kernel_pca(m, df)
    d = P.distances(m, x, x)
    h = np.median(d[np.triu_indices(75, 1)][d[np.triu_indices(75, 1)] > 0])
    a = np.exp(-(d**2) / (2 * h * h))
    w, v = np.linalg.eigh(a - a.mean(0) - a.mean(0)[:, None] + a.mean())
    z = v[:, :-3:-1] * np.sqrt(w[:-3:-1])
    assert k.diagnostics["bandwidth"] == pytest.approx(h) and np.allclose(k.diagnostics["eigenvalues"], w[:-3:-1])
    assert np.allclose(np.abs(k.coordinates), np.abs(z), atol=1e-8) and len(k.ids) == 75
    assert np.allclose([r["coordinates"] for r in k.model.transform(df).orderBy("id").collect()], k.coordinates, atol=1e-8)


def test_kernel_components_take_more_than_five_thousand_rows(spark):
    """F24"""
    m, x = Euclidean(1), np.random.default_rng(18).integers(0, 90, (5100, 1)).astype(float)
    z = E.kernel_pca(m, rows(spark, x, m)).coordinates
    assert z.shape == (5100, 2) and np.abs(z.mean(0)).max() < 1e-8


@pytest.mark.parametrize("dense, matrix", [(2000, 50_000_000), (6, 1)])
def test_embeddings_weigh_equal_points(spark, monkeypatch, dense, matrix):
    """MDS, Isomap and Sammon of different points with weights are those of all rows."""
    for module in (Lo, E):
        monkeypatch.setattr(module, "DENSE", dense)
    monkeypatch.setattr(Lo, "MATRIX", matrix)
    m, x = Euclidean(2), np.random.default_rng(19).uniform(0, 3, (45, 2))
    x = np.concatenate([x, x[:20], x[:10]])
    df, d = rows(spark, x, m), P.distances(m, x, x)
    flat = E.classical_mds(m, df)
    assert np.allclose(P.distances(m, flat.coordinates, flat.coordinates), d, atol=1e-7) and flat.diagnostics["stress"] < 1e-7
    sammon = E.sammon_mapping(m, df)
    assert len(sammon.ids) == 75 and sammon.diagnostics["stress"] < 1e-12
    paths = np.full(d.shape, np.inf)
    for i, row in enumerate(d):
        for j in [j for j in np.argsort(row, kind="stable") if j != i][:4]:
            paths[i, j] = paths[j, i] = row[j]
    np.fill_diagonal(paths, 0)
    for k in range(75):
        paths = np.minimum(paths, paths[:, k, None] + paths[k])
    paths[np.isinf(paths)] = 2 * max(1, paths[np.isfinite(paths)].max())
    z, told = E.mds_coordinates(paths, 2)
    got = E.isomap(m, df, n_neighbors=4, mutual=False, disconnected="max_finite")
    assert np.allclose(np.abs(got.coordinates), np.abs(z), atol=1e-6) and got.diagnostics["stress"] == pytest.approx(told["stress"], abs=1e-6)


def test_embeddings_take_more_than_five_thousand_rows(spark):
    """F9, F23"""
    m, x = Euclidean(1), np.random.default_rng(20).integers(0, 40, (5100, 1)).astype(float)
    df = rows(spark, x, m)
    for e in (E.classical_mds(m, df, 1), E.sammon_mapping(m, df, 1, maxiter=5)):
        assert len(e.ids) == 5100 and np.allclose(np.abs(e.coordinates - e.coordinates[0]), np.abs(x - x[0]), atol=1e-6)
    assert len(E.isomap(m, df, disconnected="max_finite", mutual=False).ids) == 5100


@pytest.mark.parametrize("dense", [2000, 10])
def test_two_heaps_are_clusters_at_any_size(spark, monkeypatch, dense):
    """spectral clustering, mean shift and quantization take more than five thousand rows, and products with blocks find what a matrix does."""
    for module in (Lo, C):
        monkeypatch.setattr(module, "DENSE", dense)
    m, rng = Euclidean(1), np.random.default_rng(21)
    x = np.concatenate([rng.integers(0, 20, 2600), rng.integers(200, 220, 2600)]).astype(float)[:, None] / 10
    df, side = rows(spark, x, m), x[:, 0] > 10
    for k in (C.spectral_clustering(m, df, 2), C.mean_shift(m, df, 3.0, maxiter=30), C.competitive_quantization(m, df, 2, seed=3, epochs=1)):
        label = k.labels.orderBy("id").toPandas()["cluster"].to_numpy()
        assert len(label) == 5200 and np.array_equal(label == label[0], side == side[0])
    few = rows(spark, x[::100], m)
    for laplacian in ("symmetric", "random_walk", "unnormalized"):
        for affinity in ("rbf", "self_tuning"):
            label = C.spectral_clustering(m, few, 2, affinity=affinity, laplacian=laplacian, n_neighbors=20).labels.orderBy("id").toPandas()["cluster"].to_numpy()
            assert np.array_equal(label == label[0], side[::100] == side[0])


def test_transport_shares_equal_points(spark):
    """the plan of different points, dealt to their rows, moves each row's mass at the least cost."""
    m, rng = Euclidean(1), np.random.default_rng(22)
    x, y = rng.integers(0, 9, (30, 1)).astype(float), rng.integers(2, 14, (42, 1)).astype(float)
    r = T.empirical_wasserstein_distance(m, rows(spark, x, m), rows(spark, y, m))
    least = np.mean((np.sort(np.repeat(x, 42)) - np.sort(np.repeat(y, 30))) ** 2)
    assert r.converged and r.cost == pytest.approx(least) and np.allclose(r.plan.sum(1), 1 / 30) and np.allclose(r.plan.sum(0), 1 / 42)
    assert sum(q * (x[i, 0] - y[j, 0]) ** 2 for i, j, q in zip(*r.entries)) == pytest.approx(least)


def test_transport_takes_more_than_two_thousand_rows(spark):
    """F10"""
    m, rng = Euclidean(1), np.random.default_rng(23)
    x, y = rng.integers(0, 200, (2100, 1)).astype(float), rng.integers(50, 260, (2100, 1)).astype(float)
    df = rows(spark, x, m)
    r = T.empirical_wasserstein_distance(m, df, rows(spark, y, m))
    assert r.converged and r.cost == pytest.approx(np.mean((np.sort(x[:, 0]) - np.sort(y[:, 0])) ** 2)) and r.table(df).agg(F.sum("mass")).first()[0] == pytest.approx(1)


def test_bootstrap_draws_without_a_row_for_each_replicate(spark, monkeypatch):
    """replicates share rows; their means are those of the counts that each row draws by itself."""
    monkeypatch.setattr(Loc, "DRAWS", 4)
    m, x = Euclidean(2), np.random.default_rng(24).normal(size=(50, 2))
    df = rows(spark, x, m)
    got = Loc.bootstrap_frechet_mean(m, df, 5, n_bootstrap=9)[1].orderBy("replicate").collect()
    u = df.select("id", *[Loc.hash_uniform(5, F.lit(r), "id").alias(f"u{r}") for r in range(9)]).orderBy("id").toPandas()
    upto = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(24)])
    for r in range(9):
        count = (u[f"u{r}"].to_numpy()[:, None] > upto).sum(1)
        assert np.allclose(got[r]["point"], count @ x / count.sum(), atol=1e-7)


@pytest.mark.parametrize("held, border", [(1 << 22, 1 << 16), (0, 1 << 16), (0, 3), (1 << 22, 0)])
def test_trimmed_means_are_few_jobs(spark, monkeypatch, held, border):
    """each trimming took some twenty jobs; the border's ties go by id, wherever the rows lie."""
    monkeypatch.setattr(Loc, "HELD", held, raising=False)
    monkeypatch.setattr(Loc, "BORDER", border, raising=False)
    rng = np.random.default_rng(25)
    # Eighths on both sides of the start are equally far from it.
    for x, w, start in ((rng.integers(-9, 10, 90) / 8.0, rng.integers(0, 4, 90) / 4.0, 0.0), (rng.normal(0, 0.6, 80), rng.uniform(0, 1, 80), 0.3)):
        w[5] = 0.0
        df = rows(spark, x[:, None], Torus(1), w=w.tolist()).repartition(5)
        at, v = start, w / w.sum()
        for it in range(1, 101):
            order = np.argsort(np.abs(x - at), kind="stable")
            kept = np.zeros(len(x))
            kept[order] = np.clip(0.8 - (np.cumsum(v[order]) - v[order]), 0, v[order])
            before, at = at, float(kept @ x / kept.sum())
            if abs(at - before) <= 1e-6:
                break
        spark.sparkContext.setJobGroup(f"trimmed {held} {border} {start}", "")
        got = Loc.trimmed_frechet_mean(Torus(1), df, trim_fraction=0.2, weight="w", initial_point=[start])
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trimmed {held} {border} {start}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got.point[0] == pytest.approx(at, abs=1e-6) and got.iterations == it and got.converged
        assert got.objective == pytest.approx(kept @ (x - at) ** 2 / kept.sum(), abs=1e-6)
        assert jobs <= (12 if held else 14 + 14 * it)


def test_packed_rows_of_both_kinds_agree(spark, monkeypatch):
    """iterations over rows that the driver holds, in blocks, are those over rows in the checkpoint folder."""
    monkeypatch.setattr(Loc, "BLOCK", 7, raising=False)
    m, x = SpecialOrthogonal(3), SpecialOrthogonal(3).random_point(np.random.default_rng(26), 1)
    x = m.exp(np.repeat(x, 40, 0), m.random_tangent(np.random.default_rng(27), np.repeat(x, 40, 0), 0.5, True))
    df, got = rows(spark, x, m).repartition(3), []
    for held in (1 << 22, 0):
        monkeypatch.setattr(Loc, "HELD", held, raising=False)
        got.append([Loc.frechet_mean(m, df), Loc.frechet_median(m, df, tol=1e-5), Loc.trimmed_frechet_mean(m, df, tol=1e-5), Loc.geodesic_m_estimator(m, df, tol=1e-5)])
    for a, b in zip(*got):
        assert np.allclose(a.point, b.point, atol=1e-9) and a.iterations == b.iterations and a.objective == pytest.approx(b.objective)


@pytest.mark.parametrize("held, border", [(1 << 22, 1 << 16), (0, 4), (0, 0)])
def test_scales_are_medians_of_packed_rows(spark, monkeypatch, held, border):
    """the scale of an M-estimator sent all different distances to one task."""
    monkeypatch.setattr(Loc, "HELD", held, raising=False)
    monkeypatch.setattr(Loc, "BORDER", border, raising=False)
    m, at = Torus(1), np.array([0.3])
    for n in (1, 40, 41):
        x = np.round(np.random.default_rng(n).normal(0, 0.6, (n, 1)), 1)
        df = rows(spark, x, m).repartition(3)
        packed = Loc.Packed(m, df.withColumn("_w", F.lit(1 / n)), "point")
        assert packed.median_distance(at) == pytest.approx(np.median(np.abs(x - at)), abs=1e-12)
    got = Loc.geodesic_m_estimator(m, df, initial_point=at)
    assert got.diagnostics["scale"] == pytest.approx(np.median(np.abs(x - at)) / Loc.MAD, abs=1e-12)
