"""Queries over curved geometries against their SQL."""

import os

import pytest

from tangentia.plans import certificates, pipelines
from tangentia.plans.closed_forms import DISTANCES, MEANS, ORACLE, QUERIES

SLOW = {name for name in DISTANCES if "stiefel" in name}
CHOSEN = [n for n in QUERIES if n not in SLOW and n not in ("curved_medians_are_minimal", "curved_means_are_stationary")]


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def rows(df):
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


QUICK = "codes_are_weights random_rotations_belong nearest_centroids_of_segments local_lines_of_balances medoids_are_best_of_their_clusters single_linkage_is_a_spanning_tree principal_scores_keep_points subspace_of_items eigenvector_of_items registration_of_customers circular_responses shapes_by_nearest_mean embeddings_of_suppliers".split()


@pytest.mark.parametrize("name", [*CHOSEN, *QUICK])
def test_query_matches_its_sql(spark, sf, duck, name):
    queries, sql = {**QUERIES, **certificates.QUERIES, **pipelines.QUERIES}, {**ORACLE, **certificates.ORACLE, **pipelines.ORACLE}
    got, want = queries[name](spark, sf).toPandas(), duck.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want[list(got.columns)])


def test_all_are_compared():
    assert set(QUERIES) == set(ORACLE) >= {*DISTANCES, *MEANS} and set(certificates.QUERIES) == set(certificates.ORACLE) and set(pipelines.QUERIES) == set(pipelines.ORACLE)
