"""Operators over tables: adapters, joins, aggregates, learning, transport, tests, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tangentia.functions import *  # noqa: F403
from tangentia.functions.columns import columns, register_sql
from tangentia.operators import clustering as C
from tangentia.operators import data as D
from tangentia.operators import embedding as Em
from tangentia.operators import inference as I
from tangentia.operators import learning as L
from tangentia.operators import location as Lo
from tangentia.operators import pairs as P
from tangentia.operators import prediction as Pr
from tangentia.operators import transport as Tr
from tangentia.operators.local import TooManyRows
from tangentia.streaming import StreamingKMeans, keyed_frechet_mean, windowed_circular_mean


@pytest.fixture
def table(spark):
    def make(points, geometry=None, **more):
        names, columns_ = list(more), list(more.values())
        kind = {int: "long", float: "double", str: "string", type(None): "double"}
        schema = "id long, point array<double>" + "".join(f", {n} {kind[type(c[0])]}" for n, c in zip(names, columns_))
        df = spark.createDataFrame([(i, np.ravel(p).astype(float).tolist(), *r) for i, (p, *r) in enumerate(zip(points, *columns_))], schema)
        return df if geometry is None else df.withColumn("point", D.stamped(F.col("point"), "point", geometry))

    return make


NATIVE = [Euclidean(3), Sphere(4), ProbabilitySimplex(4), PoincareBall(3), Hyperboloid(4), Torus(3)]


@pytest.mark.parametrize("m", [*NATIVE, SPDLogEuclidean(2), Product({"a": Sphere(3), "b": Torus(1)})], ids=repr)
def test_columns_agree_with_kernels(spark, m):
    rng = np.random.default_rng(0)
    x = m.random_point(rng, 6)
    u = m.random_tangent(rng, x, 0.3, True)
    y = m.exp(x, u)
    s = spark.createDataFrame([(i, *(np.ravel(v).tolist() for v in row)) for i, row in enumerate(zip(x, y, u))], "id long, x array<double>, y array<double>, u array<double>")
    c = columns(m)
    points = {"exp": c.exp("x", "u"), "log": c.log("x", "y"), "project": c.project("x"), "transport": c.transport("x", "y", "u"), "pair_mean": c.pair_mean("x", "y"), "tangent_project": c.tangent_project("x", "u")}
    numbers = {"dist": c.dist("x", "y"), "squared_dist": c.squared_dist("x", "y"), "norm": c.norm("x", F.col("u"))}
    got = s.select("id", c.belongs("x").alias("belongs"), *[v.alias(k) for k, v in {**points, **numbers}.items()]).orderBy("id").toPandas()
    args = {"exp": (x, u), "log": (x, y), "project": (x,), "transport": (x, y, u), "pair_mean": (x, y), "tangent_project": (x, u), "dist": (x, y), "squared_dist": (x, y), "norm": (x, u)}
    assert got["belongs"].all()
    for k, a in args.items():
        want = getattr(m, k)(*a)
        have = np.stack(got[k]).reshape(want.shape) if k in points else got[k].to_numpy()
        assert np.allclose(have, want, atol=1e-7), k
    assert spark.createDataFrame([(None, None)], "x array<double>, y array<double>").select(c.dist("x", "y").alias("d")).first()["d"] is None


def test_sql_functions(spark, table):
    register_sql(spark, Sphere(3), "sphere")
    assert spark.sql("select sphere_dist(array(1.0D,0.0D,0.0D), array(0.0D,1.0D,0.0D)) as d").first()["d"] == pytest.approx(math.pi / 2)


@pytest.mark.parametrize("m, name, rows", [
    (Sphere(3), "hyperspherical", [[0.4, 1.2], [1, 2]]), (Torus(2), "unit_circle", [[1, 0, 0, 1], [0, -1, -1, 0]]), (Hyperboloid(3), "poincare", [[0.1, 0.2], [-0.2, 0.1]]),
    (PoincareBall(2), "hyperboloid", [[math.sqrt(3), 1, 1]]), (ProbabilitySimplex(3), "logits", [[1, 2, 3], [-1, 0, 1]]), (ProbabilitySimplex(3), "positive", [[2, 3, 5], [4, 1, 5]]),
    (SPDLogEuclidean(2), "cholesky", [[1, 0, 0.2, 1], [2, 0, 0, 0.5]]), (SPDAffineInvariant(2), "log", [[0, 1, 1, 0]]), (CorrelationECM(2), "covariance", [[2, 0.3, 0.3, 1], [1, -0.2, -0.2, 3]]),
    (CorrelationLEC(2), "cholesky", [[1, 0, 0.5, 2]]), (SpecialOrthogonal(2), "angle", [[0], [1]]), (SpecialOrthogonal(3), "quaternion", [[1, 0, 0, 0], [0.7, 0.2, 0.1, 0.3]]),
    (SpecialOrthogonal(3), "axis_angle", [[0, 0, 0], [0.1, -0.2, 0.05]]), (SpecialEuclidean(2), "twist", [[0.2, 1, 2], [-0.1, 0, 0.5]]), (SpecialEuclidean(2), "components", [[1, 0, 0, 1, 3, 4]]),
    (KendallShape(4, 2), "raw_landmarks", [list(range(8)), [5, 3, 1, 8, 2, 2, 9, 0]]), (Grassmann(3, 1), "basis", [[1, 2, 2]]), (Grassmann(3, 1), "projector", [[1, 0, 0, 0, 0, 0, 0, 0, 0]]),
    (FixedRank(2, 2, 1), "svd", [[1, 0, 3, 0.6, 0.8]]), (RankKPSD(3, 1), "factor", [[1, 2, 3]]), (Elliptope(3, 2), "factor", [[1, 2, 3, 1, 2, 0]]),
], ids=lambda v: v if isinstance(v, str) else repr(v)[:20])
def test_representations(table, m, name, rows):
    out = D.as_points(table(rows), "point", m, representation=name)
    assert D.check_points(out, "point", m).first()["valid"] and D.geometry_of(out, "point") == m


def test_checks_and_repair(spark, table, tmp_path):
    m = Sphere(2)
    bad = table([[1, 0], [2, 0], [0, 1]])
    assert D.check_points(bad, "point", m).first()["invalid"] == 1
    with pytest.raises(ValueError):
        D.as_points(bad, "point", m)
    assert D.as_points(bad, "point", m, repair=True).filter("point[0] = 1").count() == 2
    assert not D.check_points(bad.limit(0), "point", m).first()["valid"]
    assert D.check_points(table([[1, float("nan")]]), "point", m, "finite").first()["invalid"] == 1
    with pytest.raises(ValueError):
        D.as_points(bad, "point", m, representation="pixels")
    with pytest.raises(ValueError):
        P.pairwise_distances(Sphere(2), D.as_points(bad, "point", Torus(2), check="none"))
    path = str(tmp_path / "p")
    D.as_points(bad, "point", m, repair=True).write.parquet(path)
    assert D.geometry_of(spark.read.parquet(path), "point") == m
    D.register_adapter(Sphere, "twice", lambda g, c: F.transform(c, lambda v: v / 2), overwrite=True)
    assert D.as_points(table([[2, 0]]), "point", m, representation="twice").first()["point"] == [1, 0]
    nested = spark.createDataFrame([(0, ([1.0, 0.0], ([0.5], [2.0, 0.0, 0.0, 1.0])))], "id long, point struct<direction:array<double>, state:struct<_0:array<double>, _1:array<double>>>")
    p = Product({"direction": Sphere(2), "state": [Torus(1), SPDLogEuclidean(2)]})
    assert D.as_points(nested, "point", p).first()["point"] == [1, 0, 0.5, 2, 0, 0, 1]


def test_random_points_do_not_depend_on_partitions(spark):
    a = D.random_points(spark, SpecialOrthogonal(3), 12, 4).orderBy("id").collect()
    b = D.random_points(spark, SpecialOrthogonal(3), 12, 4).repartition(5).orderBy("id").collect()
    assert [r["point"] for r in a] == [r["point"] for r in b]


def test_pairs(table):
    e = Euclidean(2)
    pts = np.round(np.random.default_rng(31).normal(0, 2, (40, 2)))  # whole numbers, and so ties
    x = table(pts, e)
    true = np.linalg.norm(pts[:, None] - pts, axis=-1)
    d = {(r["i"], r["j"]): r["distance"] for r in P.pairwise_distances(e, x, block=7).collect()}
    assert len(d) == 1600 and all(v == pytest.approx(true[k]) for k, v in d.items())
    near = [(r["query_id"], r["neighbor_id"]) for r in P.nearest_neighbors(e, x, n_neighbors=4, block=7).orderBy("query_id", "rank").collect()]
    assert near == [(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (round(true[i, j], 9), j))[:4]]
    for radius in (0.0, 1.0, 2.5):
        found = [(r["i"], r["j"]) for r in P.distance_join(e, x, x, radius, block=7).collect()]
        assert len(found) == len(set(found)) and set(found) == {(i, j) for i in range(40) for j in range(40) if true[i, j] <= radius + 1e-12}
    cost = (true**2).sum(1)
    got = P.medoid(e, x)
    assert got["cost"] == pytest.approx(cost.min()) and got["id"] == int(np.flatnonzero(cost < cost.min() + 1e-9)[0])
    with pytest.raises(CapabilityError):
        P.pairwise_distances(FixedRank(2, 2, 1), x)


@pytest.mark.parametrize("m", [Sphere(3), Torus(2), Hyperboloid(3), SPDAffineInvariant(2)], ids=repr)
def test_cells_lose_nothing(table, m):
    rng = np.random.default_rng(32)
    pts, other = m.random_point(rng, 60), m.random_point(rng, 25)
    x, y = table(pts, m), table(other, m)
    true = P.distances(m, other, pts)
    radius = float(np.quantile(true, 0.15))
    got = {(r["i"], r["j"]) for r in P.distance_join(m, y, x, radius, block=8).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(true <= radius))}
    near = [(r["query_id"], r["neighbor_id"]) for r in P.nearest_neighbors(m, x, y, n_neighbors=3, block=8).orderBy("query_id", "rank").collect()]
    assert near == [(i, int(j)) for i in range(25) for j in np.argsort(true[i], kind="stable")[:3]]


def test_cells_spare_distances(table):
    pts = np.random.default_rng(33).uniform(0, 100, (2000, 1))
    x = table(pts, Euclidean(1))
    pivots = P._pivots(Euclidean(1), x, "point", "id", 2000, 100)
    cells = P._celled(Euclidean(1), x, pivots, "point", "id")
    far = {r["cell"]: r["d"] for r in cells.groupBy("cell").agg(F.max("d").alias("d")).collect()}
    visits = P._visiting(Euclidean(1), x, pivots, far, "point", "id", 0.5).count()
    assert len(pivots) == 40 and visits < 2000 * 6


def draws(seed, n, d=1, scale=1.0):
    return np.random.default_rng(seed).normal(0, scale, (n, d))


def test_locations(table):
    e, rng = Euclidean(1), np.random.default_rng(41)
    x, w = draws(42, 23, scale=3.0), rng.dirichlet(np.ones(23))
    given = table(x, e, w=w.tolist())
    assert Lo.frechet_mean(e, given, weight="w").point[0] == pytest.approx(w @ x[:, 0])
    order = np.argsort(x[:, 0])
    middle = x[order][np.searchsorted(np.cumsum(w[order]), 0.5), 0]
    cost = lambda c: w @ np.abs(x[:, 0] - c)
    assert cost(Lo.frechet_median(e, given, weight="w").point[0]) <= cost(middle) + 1e-3
    ball = Lo.minimum_enclosing_ball(e, table(x, e))
    assert np.ptp(x) / 2 <= ball.radius + 1e-9 and ball.radius <= 1.03 * np.ptp(x) / 2
    out = table(np.append(x, [[400.0], [-700.0]], 0), e)
    assert abs(Lo.trimmed_frechet_mean(e, out, trim_fraction=2 / 25).point[0] - x.mean()) < 0.05
    for loss in ("huber", "cauchy", "tukey"):
        assert abs(Lo.geodesic_m_estimator(e, out, loss=loss).point[0] - np.median(x)) < 2
    heavy = np.zeros(23)
    heavy[5] = 1
    assert Lo.trimmed_frechet_mean(e, table(x, e, w=heavy.tolist()), trim_fraction=0.3, weight="w").point[0] == pytest.approx(x[5, 0])
    center = 0.3
    far = np.abs(np.append(x[:, 0], x[0, 0]) - center)
    ranks = [((far < d).sum() + ((far == d).sum() + 1) / 2) / len(far) for d in far]
    got = {r["id"]: r["rank"] for r in Lo.metric_distance_ranks(e, table(np.append(x, x[:1], 0), e), center=[center]).collect()}
    assert [got[i] for i in range(24)] == pytest.approx(ranks)
    p = draws(43, 15, 2)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)
    depth = [1 - np.linalg.norm(unit(p - q).mean(0)) for q in p]
    cloud = table(p, Euclidean(2), w=rng.dirichlet(np.ones(15)).tolist())
    got = {r["id"]: r["depth"] for r in Lo.geodesic_spatial_depth(Euclidean(2), cloud, cloud).collect()}
    assert [got[i] for i in range(15)] == pytest.approx(depth)
    v = np.array([r["w"] for r in cloud.orderBy("id").collect()])
    assert np.allclose(Lo.streaming_frechet_mean(Euclidean(2), cloud, weight="w").point, v @ p)
    one = table(x, e, w=heavy.tolist())
    assert Lo.streaming_frechet_mean(e, one, weight="w", initial_point=[7.5]).point[0] == pytest.approx(x[5, 0])
    assert Lo.streaming_frechet_mean(e, one, weight="w", initial_point=[7.5], initial_weight=3).point[0] == pytest.approx((3 * 7.5 + x[5, 0]) / 4)
    with pytest.raises(ValueError):
        Lo.streaming_frechet_mean(e, one, initial_weight=2)
    with pytest.raises(ValueError):
        Lo.frechet_mean(e, table(x, e, w=[0.0] * 23), weight="w")
    mean, reps = Lo.bootstrap_frechet_mean(e, table(x, e), 6, n_bootstrap=17, confidence_level=0.9)
    assert mean.point[0] == pytest.approx(x.mean(), abs=1e-6) and 0 <= mean.radius < np.ptp(x) and reps.count() == 17
    by = Lo.frechet_means(Sphere(3), table(Sphere(3).random_point(rng, 30), Sphere(3), g=[k % 3 for k in range(30)], w=[float(1 + k % 2) for k in range(30)]), group="g", weight="w")
    assert set(by) == {0, 1, 2} and all(v.converged for v in by.values())
    core = Lo.lightweight_coreset(e, table(x, e), 9, 3).collect()
    assert sum(r["weight"] for r in core) == pytest.approx(1) and {round(r["point"][0], 9) for r in core} <= {round(v, 9) for v in x[:, 0].tolist()}


def test_curved_means(table, monkeypatch):
    m = Sphere(3)
    rng = np.random.default_rng(2)
    x = m.exp(np.array([1.0, 0, 0])[None], np.column_stack([np.zeros(20), rng.normal(0, 0.3, (20, 2))]))
    got = Lo.frechet_mean(m, table(x, m))
    assert got.converged and np.linalg.norm(m.log(got.point[None], x).mean(0)) < 1e-6
    by = Lo.frechet_means(m, table(x, m, g=[k % 2 for k in range(20)]), group="g")
    assert set(by) == {0, 1} and all(v.converged for v in by.values())
    s = SPDAffineInvariant(2)
    p = s.random_point(rng, 9)
    got = Lo.frechet_mean(s, table(p, s))
    assert got.converged and s.norm(got.point[None], s.log(got.point[None], p).mean(0)[None])[0] < 1e-6
    for most in (65_536, 6):
        monkeypatch.setattr(Lo, "TASK_ROWS", most)
        mini = Lo.minibatch_frechet_mean(m, table(x, m), 1, batch_size=5, epochs=5)
        assert m.dist(mini.point, Lo.frechet_mean(m, table(x, m)).point) < 0.2
    core = Lo.lightweight_coreset(m, table(x, m), 400, 3).collect()
    assert m.dist(Lo.frechet_mean(m, table([r["point"] for r in core], m, w=[r["weight"] for r in core]), weight="w").point, Lo.frechet_mean(m, table(x, m)).point) < 0.05


def clouds(seed, n=6, d=2, apart=9.0):
    """(points, labels): two clouds of n points each around centres that are `apart`."""
    x = draws(seed, 2 * n, d, 0.6)
    x[n:] += apart * np.eye(d)[-1]
    return x, [0] * n + [1] * n


def test_clusterings(table):
    pts, y = clouds(51)
    m, x = Euclidean(2), table(pts, Euclidean(2))
    found = [C.kmeans(m, x, 2, 1), C.kmeans(m, x, 2, 1, init="random", n_init=3), C.kmedoids(m, x, 2, 1), *(C.agglomerative_clustering(m, x, 2, k) for k in ("single", "complete", "average")), C.spectral_clustering(m, x, 2), C.spectral_clustering(m, x, 2, affinity="self_tuning", n_neighbors=3, laplacian="random_walk"), C.mean_shift(m, x, 2.5), C.competitive_quantization(m, x, 2, 3), C.minibatch_kmeans(m, x, 2, 1, batch_size=6)]
    for c in found:
        got = [r["cluster"] for r in c.labels.orderBy("id").collect()]
        assert all((a == b) == (u == v) for a, u in zip(got, y) for b, v in zip(got, y))
    assert C.agglomerative_clustering(m, x).linkage.shape == (11, 4)
    heights = C.agglomerative_clustering(m, x, linkage="single").linkage[:, 2]
    d = np.linalg.norm(pts[:, None] - pts, axis=-1)
    tree, rest, spanning = [0], set(range(1, 12)), []
    while rest:  # single linkage merges along a least spanning tree
        w, k = min((d[i, j], j) for i in tree for j in rest)
        spanning.append(w)
        tree.append(k)
        rest.remove(k)
    assert sorted(heights) == pytest.approx(sorted(spanning))
    with pytest.raises(ValueError):
        C.agglomerative_clustering(m, x, linkage="ward")
    with pytest.raises(TooManyRows):
        C.kmedoids(m, x, 2, cap=5)


def test_classifiers(table):
    m = Euclidean(2)
    pts, y = clouds(52, 9)
    x = table(pts, m, label=[("even", "odd")[v] for v in y])
    new, truth = clouds(53, 5)
    models = [Pr.nearest_centroid_classifier(m, x, "label"), Pr.knn_classifier(m, x, "label", 3), Pr.knn_classifier(m, x, "label", 5, "distance"), Pr.tangent_space_logistic_regression(m, x, "label"), Pr.tangent_space_discriminant_analysis(m, x, "label"), Pr.tangent_space_discriminant_analysis(m, x, "label", "qda")]
    for model in models:
        rows = model.transform(table(new, m, truth=truth)).collect()
        assert all(r["prediction"] == ("even", "odd")[r["truth"]] for r in rows)
        for p in (r["probability"] for r in rows):
            assert sum(p.values() if isinstance(p, dict) else p) == pytest.approx(1)
    same = table(np.repeat(draws(54, 1, 2), 7, 0), m, label=["p"] * 5 + ["q"] * 2)
    assert {r["prediction"] for r in Pr.tangent_space_discriminant_analysis(m, same, "label").transform(same).collect()} == {"p"}


def test_regressions(table):
    rng = np.random.default_rng(61)
    t = np.sort(rng.uniform(0, 6, 40))
    y = np.sin(t)
    x = table(t[:, None], Euclidean(1), y=y.tolist())
    model, scores = Pr.select_kernel_bandwidth(Euclidean(1), x, "y", [0.1, 0.4, 5.0], 4, 1)
    assert scores.count() == 3 and model.bandwidth != 5.0
    weights = np.exp(-0.5 * ((t[:, None] - t) / 0.4) ** 2)
    out = Pr.kernel_regression(Euclidean(1), x, "y", 0.4).transform(x).orderBy("id").collect()
    assert np.allclose([r["prediction"] for r in out], weights @ y / weights.sum(1), atol=1e-6)
    slope, start = rng.normal(size=3), rng.normal(size=3)
    line = table(start + t[:, None] * slope, Euclidean(3), t=t.tolist())
    assert np.allclose(Pr.geodesic_regression(Euclidean(3), line, "t").slope, slope, atol=2e-4)
    m = Sphere(4)
    at = m.random_point(rng, 1)
    u = m.random_tangent(rng, at, 0.2, True)
    arc = m.exp(at, (t[::4, None] - 3) * u)
    r = Pr.geodesic_regression(m, table(arc, m, t=t[::4].tolist()), "t")
    assert max(m.dist(m.exp(r.intercept[None], (t[::4] - r.center)[:, None] * r.slope[None]), arc)) < 2e-3
    s = table((start[0] + slope[0] * t)[:, None], Euclidean(1), t=t.tolist())
    for degree, gap in ((0, 0.5), (1, 2e-3)):
        got = Pr.local_polynomial_regression(Euclidean(1), s, "t", 0.6, degree=degree).transform(s, "t").orderBy("id").collect()
        assert max(abs(r["prediction"][0] - (start[0] + slope[0] * r["t"])) for r in got[4:-4]) < gap


def test_embeddings(table):
    m, rng = Euclidean(3), np.random.default_rng(71)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0][:, :2]
    u = np.sort(rng.uniform(-2, 2, 14))
    pts = np.column_stack([u, 0.3 * np.cos(u)]) @ turn.T
    x = table(pts, m)
    assert np.allclose(Em._flat(Em.classical_mds(m, x).coordinates), P.distances(m, pts, pts), atol=2e-4)
    placed, told = Em.landmark_mds(m, x, n_landmarks=6)
    z = np.array([r["coordinates"] for r in placed.orderBy("id").collect()])
    assert len(told.ids) == 6 and np.allclose(Em._flat(z), P.distances(m, pts, pts), atol=1e-6)
    p = Em.principal_geodesic_analysis(m, x)
    back = p.inverse_transform(p.transform(x).drop("point")).orderBy("id").collect()
    assert np.allclose([r["point"] for r in back], pts, atol=1e-6)
    k = Em.kernel_pca(m, x)
    again = [r["coordinates"] for r in k.model.transform(x).orderBy("id").collect()]
    assert np.allclose(again, k.coordinates, atol=1e-6)
    assert Em.isomap(m, x, n_neighbors=4).diagnostics["stress"] < 0.3
    assert Em.sammon_mapping(m, x).diagnostics["stress"] < 1e-3
    kl = Em.tsne(m, x, 1, perplexity=4, maxiter=200, learning_rate=5.0, exaggeration_iterations=40).diagnostics["history"]
    assert kl[-1] < kl[0] and Em.phate(m, x, n_neighbors=4).table(x).count() == 14
    far = table(np.concatenate([draws(72, 5, 3, 0.1), draws(73, 4, 3, 0.1) + 300]), m)
    with pytest.raises(ValueError):
        Em.isomap(m, far, n_neighbors=2)
    assert len(Em.isomap(m, far, n_neighbors=4, disconnected="largest_component").ids) == 5


def test_tests(table):
    e = Euclidean(1)
    a, b = table(draws(81, 9), e), table(draws(82, 9) + 6, e)
    for f in (I.biswas_ghosh_two_sample_test, I.energy_two_sample_test, I.kernel_mmd_two_sample_test, I.wasserstein_two_sample_test, I.paired_frechet_test):
        r = f(e, a, b, seed=5, n_permutations=79)
        assert r.pvalue <= 0.05 and f(e, a, b, seed=5, n_permutations=79).pvalue == r.pvalue
    with pytest.raises(ValueError):
        I.kernel_mmd_two_sample_test(e, a, b, 1, kernel=lambda d: d - 50)
    x, n = draws(83, 19), [5, 8, 6]
    of = np.repeat([0, 1, 2], n)
    x[of == 2] *= 4
    r = I.frechet_anova(e, table(x, e, grp=of.tolist()), "grp")
    squared = lambda v: (v - v.mean()) ** 2
    own = [squared(x[of == k, 0]) for k in range(3)]
    expected = I.fanova_statistic(np.array(n, float), np.array([v.mean() for v in own]), np.array([v.var() for v in own]), squared(x[:, 0]).mean())
    assert r.statistic == pytest.approx(expected, rel=1e-6)
    assert 0 <= I.frechet_anova(e, table(x, e, grp=of.tolist()), "grp", "permutation", 19, 1).pvalue <= 1
    z = 1.7
    assert I.gamma_tail(3, z) == pytest.approx(math.exp(-z) * (1 + z + z * z / 2)) and I.gamma_tail(0.5, z) == pytest.approx(math.erfc(math.sqrt(z)))


def line_cost(x, y, a, b):
    """Squared transport cost of weighted points of the line, by their quantiles."""
    x, y, a, b = x[np.argsort(x)], y[np.argsort(y)], a[np.argsort(x)], b[np.argsort(y)]
    q = np.unique(np.r_[np.cumsum(a), np.cumsum(b)])
    q = np.r_[0, q[q < 1 - 1e-12], 1]
    mid = 0.5 * (q[1:] + q[:-1])
    quantile = lambda v, w: v[np.minimum(np.searchsorted(np.cumsum(w), mid), len(v) - 1)]
    return (np.diff(q) * (quantile(x, a) - quantile(y, b)) ** 2).sum()


def test_transport(spark, table):
    e, rng = Euclidean(1), np.random.default_rng(91)
    x, y, a, b = draws(92, 11), draws(93, 7, scale=2.0), rng.dirichlet(np.ones(11)), rng.dirichlet(np.ones(7))
    r = Tr.empirical_wasserstein_distance(e, table(x, e, w=a.tolist()), table(y, e, w=b.tolist()), weight_x="w", weight_y="w")
    assert r.cost == pytest.approx(line_cost(x[:, 0], y[:, 0], a, b), abs=2e-5) and np.allclose(r.plan.sum(1), a) and np.allclose(r.plan.sum(0), b) and abs(r.duality_gap) < 1e-6
    for n, m in ((2, 5), (4, 4), (13, 10)):
        x, y, a, b = rng.normal(size=n), rng.normal(size=m), rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(m))
        assert Tr.wasserstein_plan((x[:, None] - y[None]) ** 2, a, b).cost == pytest.approx(line_cost(x, y, a, b), abs=2e-5)
    c = rng.random((55, 55))
    assert abs(Tr.wasserstein_plan(c, np.full(55, 1 / 55), np.full(55, 1 / 55)).duality_gap) < 1e-8
    same = draws(94, 6)
    assert Tr.sinkhorn_divergence(e, table(same, e), table(same, e), 0.7, maxiter=8) == pytest.approx(0, abs=1e-6)


def test_learning(table):
    e, rng = Euclidean(1), np.random.default_rng(101)
    ends = [-5.0, 4.0]
    x = table(rng.uniform(*ends, (13, 1)), e)
    rows = L.geodesic_barycentric_coding(e, x, [[v] for v in ends], ridge=0.0).collect()
    assert all(abs(sum(r["code"]) - 1) < 1e-9 and abs(r["reconstruction"][0] - r["point"][0]) < 2e-4 for r in rows)
    d = L.manifold_dictionary_learning(e, x, 2, initial_atoms=[[-0.5], [0.5]], maxiter=12)
    assert all(b <= a + 1e-9 for a, b in zip(d.history, d.history[1:])) and d.objective < d.history[0]
    pts, y = clouds(102, 7, 1)
    hidden = [v if k % 3 == 0 else -1 for k, v in enumerate(y)]
    got = L.label_propagation(e, table(pts, e, y=hidden), "y", bandwidth=1.5, n_neighbors=3, maxiter=80).orderBy("id").collect()
    assert [r["prediction"] for r in got] == y
    t = np.sort(rng.uniform(0, 3, 21))
    target = [float(3 - v) if k % 2 == 0 else float("nan") for k, v in enumerate(t)]
    f = L.manifold_regularized_regression(e, table(t[:, None], e, y=target), "y", 0.5, 4, 1e-4, 0.1).orderBy("id").collect()
    assert np.mean([(r["prediction"] - (3 - v)) ** 2 for r, v in list(zip(f, t))[1::2]]) < 0.15
    pts, y = clouds(103, 8)
    lm = L.riemannian_metric_learning(Euclidean(2), table(pts, Euclidean(2), label=y), "label")
    assert np.allclose(lm.factor @ lm.factor.T, lm.metric) and len(lm.transform(table(pts, Euclidean(2))).first()["features"]) == 2
    v = rng.normal(size=(30, 4))
    on = L.onto_simplex(v)
    assert np.allclose(on.sum(1), 1) and (on >= 0).all()
    for _ in range(50):  # no point of the simplex is nearer
        q = rng.dirichlet(np.ones(4))
        assert (np.linalg.norm(on - v, axis=1) <= np.linalg.norm(q - v, axis=1) + 1e-9).all()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, i % 3, [float(i), 1.0], f"2024-01-01 0{i % 4}:00:00") for i in range(24)]
    spark.createDataFrame(rows, "id long, k int, point array<double>, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, k int, point array<double>, ts timestamp").parquet(src)
    q = keyed_frechet_mean(Euclidean(2), stream, "k").writeStream.format("memory").queryName("means").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["k"]: r["point"][0] for r in spark.table("means").collect()}
    assert got == pytest.approx({k: np.mean([r[0] for r in rows if r[1] == k]) for k in range(3)})
    batch = windowed_circular_mean(stream.withColumn("a", F.get("point", F.lit(1))), "ts", "a", "1 hour").writeStream.format("memory").queryName("angles").outputMode("complete").trigger(availableNow=True).start()
    batch.awaitTermination()
    assert spark.table("angles").count() == 4 and spark.table("angles").first()["mean"] == pytest.approx(1)
    model = StreamingKMeans(Euclidean(2), [[0.0, 1.0], [20.0, 1.0]])
    stream.writeStream.foreachBatch(model.update).trigger(availableNow=True).start().awaitTermination()
    assert model.centers[0, 0] > 2 and model.updates.sum() == 2
