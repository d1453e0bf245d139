"""Findings of round 3: each of these failed before its change."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tangentia.functions import Euclidean, PoincareBall, Torus
from tangentia.operators import clustering as C
from tangentia.operators import data as D
from tangentia.operators import embedding as E
from tangentia.operators import local as Lo
from tangentia.operators import location as Loc
from tangentia.operators import pairs as P
from tangentia.plans import certificates


def rows(spark, points, geometry):
    df = spark.createDataFrame([(i, np.ravel(p).astype(float).tolist()) for i, p in enumerate(points)], "id long, point array<double>")
    return df.withColumn("point", D.stamped(F.col("point"), "point", geometry))


def test_trimming_of_even_rows_converges(spark):
    """F8: means of evenly spread rows moved by little and were not done within 100 turns."""
    x = np.round(np.random.default_rng(12).uniform(-999.99, 9999.99, 90_000), 2) / 4001
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x})).select("id", D.stamped(F.array("a"), "point", Torus(1)))
    r = Loc.trimmed_frechet_mean(Torus(1), df)
    assert r.converged and r.iterations < 60
    near = np.sort(np.abs(x - r.point[0]))[:81_000]
    own = x[np.abs(x - r.point[0]) <= near[-1]]
    # Equally far rows may lie on the border.
    assert 0 <= len(own) - 81_000 < 5 and abs(own.mean() - r.point[0]) < 1e-4


def test_chains_within_clusters_are_walked(spark, sf, monkeypatch):
    """that each row has one near it in its cluster was taken for a chain through the cluster."""
    made = C.agglomerative_clustering
    sf = sf.replace("0.001", "0.01")

    def joined(*a, **b):
        k = made(*a, **b)
        size = {r[0]: r[1] for r in k.labels.groupBy("cluster").count().collect()}
        large = sorted(size, key=size.get)[-2:]
        k.labels = k.labels.withColumn("cluster", F.when(F.col("cluster") == large[0], large[1]).otherwise(F.col("cluster")))
        return k

    assert certificates.single_linkage_is_a_spanning_tree(spark, sf).first().asDict() == {"one_cluster_apart": True, "heights_rise": True, "threshold_components": True}
    monkeypatch.setattr(C, "agglomerative_clustering", joined)
    assert not certificates.single_linkage_is_a_spanning_tree(spark, sf).first()["threshold_components"]


def test_forests_join_what_links_join():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.02, 0.1, 1.0):
        near = rng.random((30, 40)) < share
        found = [(i, 30 + int(j)) for i, js in enumerate(certificates.forest(near)) for j in js]
        links = [(i, 30 + j) for i, j in np.argwhere(near).tolist()]
        a, b = (certificates.components(70, *np.array(x, int).reshape(-1, 2).T) for x in (found, links))
        assert np.array_equal(a, b) and len(found) == 70 - len(np.unique(a))


def test_medoids_take_few_sums(monkeypatch):
    """a medoid took all distances of its cluster, again in every step."""
    rng, taken = np.random.default_rng(31), []
    plain = C.plain_distances
    monkeypatch.setattr(C, "plain_distances", lambda m, x, y: taken.append(len(x)) or plain(m, x, y))
    for m in (PoincareBall(2), Torus(2), Euclidean(2)):
        x, many = rng.uniform(-0.6, 0.6, (4000, 2)), rng.integers(1, 4, 4000)
        taken.clear()
        at = C._medoid(m, x, many)
        sums = plain(m, x, x) @ many
        assert sums[at] <= sums.min() * (1 + 1e-12) and sum(taken) < 1500
        assert np.allclose(plain(m, x[:50], x), P.distances(m, x[:50], x), atol=1e-9)


def test_large_matrices_are_made_by_executors(spark, monkeypatch):
    """the driver alone made the blocks of a matrix it doesn't hold, again for each product."""
    rng, m = np.random.default_rng(32), PoincareBall(2)
    x = rng.uniform(-0.5, 0.5, (120, 2))
    x = np.concatenate([x, x[:30]])
    df, want = rows(spark, x, m), E.kernel_pca(m, rows(spark, x, m))
    plain = Lo.plain_distances
    for name, value in (("MATRIX", 1), ("DENSE", 20), ("HELD", 1000)):
        monkeypatch.setattr(Lo, name, value)
    made = []
    monkeypatch.setattr(Lo, "plain_distances", lambda g, a, b: made.append(len(a)) or plain(g, a, b))
    got = E.kernel_pca(m, df)
    # The driver itself makes some rows to begin with.
    assert sum(made) <= 121
    assert np.isclose(got.diagnostics["bandwidth"], want.diagnostics["bandwidth"]) and np.allclose(np.abs(got.coordinates), np.abs(want.coordinates), atol=1e-7)
