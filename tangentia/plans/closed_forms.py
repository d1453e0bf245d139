"""Queries over curved geometries whose results SQL can state: closed forms, certificates of optima, and streams.

Points are made of the table customer: an angle a of the balance and an angle b of the nation,
less than half a turn apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.functions import (
    CorrelationAffineQuotient, CorrelationECM, CorrelationLEC, Euclidean, GeneralizedGrassmann, GeneralizedStiefel, Geometry, Grassmann, GrassmannProjection, KendallShape, Oblique, SpecialEuclidean,
    SpecialOrthogonal, SPDAffineInvariant, SPDBuresWasserstein, SPDLogEuclidean, Sphere, Stiefel, StiefelEuclidean, Torus,
)
from tangentia.functions.columns import columns
from tangentia.operators import embedding, location
from tangentia.operators.data import stamped
from tangentia.session import shared
from tangentia.streaming import keyed_frechet_mean, session_counts, windowed_circular_mean

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ANGLES = "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal / 4001 AS a, c_nationkey / 9.0 AS b FROM customer"


def angles(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") / 4001).alias("a"), (F.col("c_nationkey") / 9.0).alias("b"))


def array(*values: Column | float) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def six(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def turn(a: Column) -> Column:
    return array(F.cos(a), -F.sin(a), F.sin(a), F.cos(a))


def turn3(a: Column) -> Column:
    return array(F.cos(a), -F.sin(a), 0, F.sin(a), F.cos(a), 0, 0, 0, 1)


def motion(a: Column, x: Column, y: Column) -> Column:
    return array(F.cos(a), -F.sin(a), x, F.sin(a), F.cos(a), y, 0, 0, 1)


def line(a: Column) -> Column:
    return array(F.cos(a), F.sin(a))


def lines(a: Column, b: Column) -> Column:
    """Two unit columns of length 2, by rows."""
    return array(F.cos(a), F.cos(b), F.sin(a), F.sin(b))


def correlation(r: Column) -> Column:
    return array(1, r, r, 1)


def triangle(x: Column, y: Column) -> Column:
    """The centred triangle (0, 0), (1, 0), (x, y) of size 1."""
    points = [(F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0)), (x, y)]
    mean = [(p + q + r) / 3 for p, q, r in zip(*points)]
    flat = [c - m for point in points for c, m in zip(point, mean)]
    size = F.sqrt(sum((c * c for c in flat), F.lit(0.0)))
    return F.array(*[c / size for c in flat])


#: name: geometry, the two points of a row, their distance in SQL.
DISTANCES: dict[str, tuple[Geometry, Callable[[Column, Column], tuple[Column, Column]], str]] = {
    "rotation_distance": (SpecialOrthogonal(2), lambda a, b: (turn(a), turn(b)), "sqrt(2) * abs(a - b)"),
    "rotation_in_space_distance": (SpecialOrthogonal(3), lambda a, b: (turn3(a), turn3(b)), "sqrt(2) * abs(a - b)"),
    "rigid_motion_distance": (SpecialEuclidean(2), lambda a, b: (motion(a, b, a * b), motion(b, a, F.lit(1.0))), "sqrt(2 * (a - b) ^ 2 + (a - b) ^ 2 + (a * b - 1) ^ 2)"),
    "grassmann_distance": (Grassmann(2, 1), lambda a, b: (line(a), line(b)), "least(abs(a - b), pi() - abs(a - b))"),
    "grassmann_projection_distance": (GrassmannProjection(2, 1), lambda a, b: (line(a), line(b)), "least(abs(a - b), pi() - abs(a - b))"),
    "generalized_grassmann_distance": (GeneralizedGrassmann(2, 1), lambda a, b: (line(a), line(b)), "least(abs(a - b), pi() - abs(a - b))"),
    "stiefel_distance": (Stiefel(2, 1), lambda a, b: (line(a), line(b)), "abs(a - b)"),
    "stiefel_euclidean_distance": (StiefelEuclidean(2, 1), lambda a, b: (line(a), line(b)), "abs(a - b)"),
    "generalized_stiefel_distance": (GeneralizedStiefel(2, 1), lambda a, b: (line(a), line(b)), "abs(a - b)"),
    "oblique_distance": (Oblique(2, 2), lambda a, b: (lines(a, b), lines(b / 2, a / 2)), "sqrt((a - b / 2) ^ 2 + (b - a / 2) ^ 2)"),
    "kendall_distance": (
        KendallShape(3, 2), lambda a, b: (triangle(a, F.lit(0.8)), triangle(b, F.lit(0.5))),
        "acos(least(1.0, sqrt((1 + a * b + 0.4 - ((1 + a) * (1 + b) + 0.4) / 3) ^ 2 + (0.8 * b - 0.5 * a - (0.8 * (1 + b) - 0.5 * (1 + a)) / 3) ^ 2)"
        " / sqrt(1 + a * a + 0.64 - ((1 + a) ^ 2 + 0.64) / 3) / sqrt(1 + b * b + 0.25 - ((1 + b) ^ 2 + 0.25) / 3)))",
    ),
    "correlation_ecm_distance": (CorrelationECM(2), lambda a, b: (correlation(F.sin(a) * 0.9), correlation(F.sin(b) * 0.9)), "abs(0.9 * sin(a) / sqrt(1 - 0.81 * sin(a) ^ 2) - 0.9 * sin(b) / sqrt(1 - 0.81 * sin(b) ^ 2))"),
    "correlation_lec_distance": (CorrelationLEC(2), lambda a, b: (correlation(F.sin(a) * 0.9), correlation(F.sin(b) * 0.9)), "abs(0.9 * sin(a) / sqrt(1 - 0.81 * sin(a) ^ 2) - 0.9 * sin(b) / sqrt(1 - 0.81 * sin(b) ^ 2))"),
    "correlation_quotient_distance": (CorrelationAffineQuotient(2), lambda a, b: (correlation(F.sin(a) * 0.9), correlation(F.sin(b) * 0.9)), "sqrt(2) * 0.9 * abs(sin(a) - sin(b))"),
    "circle_distance": (Torus(2), lambda a, b: (array(a, 2 * b), array(b, a)), "sqrt((a - b) ^ 2 + atan2(sin(2 * b - a), cos(2 * b - a)) ^ 2)"),
    "covariance_affine_distance": (SPDAffineInvariant(2), lambda a, b: (array(F.exp(a), 0, 0, F.exp(b)), array(F.exp(b / 2), 0, 0, 1)), "sqrt((a - b / 2) ^ 2 + b ^ 2)"),
    "covariance_transport_distance": (SPDBuresWasserstein(2), lambda a, b: (array(F.exp(2 * a), 0, 0, F.exp(2 * b)), array(1, 0, 0, F.exp(2 * a))), "sqrt((exp(a) - 1) ^ 2 + (exp(b) - exp(a)) ^ 2)"),
}


def _distance_query(geometry: Geometry, points) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        x, y = points(F.col("a"), F.col("b"))
        rows = angles(spark, sf).select("id", x.alias("x"), y.alias("y"))
        return rows.select("id", six(columns(geometry).dist("x", "y")).alias("distance"))

    return run


for _name, (_geometry, _points, _sql) in DISTANCES.items():
    QUERIES[_name] = _distance_query(_geometry, _points)
    ORACLE[_name] = f"SELECT id, round({_sql}, 6) + 0.0 AS distance FROM ({ANGLES})"


#: name: geometry, the point of a row, the angles of the mean in SQL, and how a mean gives them.
MEANS: dict[str, tuple[Geometry, Callable[[Column, Column], Column], list[str], Callable[[np.ndarray], list[float]]]] = {
    "rotation_mean": (SpecialOrthogonal(2), lambda a, b: turn(a), ["a"], lambda p: [np.arctan2(p[1, 0], p[0, 0])]),
    "rigid_motion_mean": (SpecialEuclidean(2), lambda a, b: motion(a, b, a * b), ["a", "b", "a * b"], lambda p: [np.arctan2(p[1, 0], p[0, 0]), p[0, 2], p[1, 2]]),
    "grassmann_mean": (Grassmann(2, 1), lambda a, b: line(a / 2), ["a / 2"], lambda p: [np.arctan(p[1, 0] / p[0, 0])]),
    "oblique_mean": (Oblique(2, 2), lambda a, b: lines(a, b), ["a", "b"], lambda p: list(np.arctan2(p[1], p[0]))),
    "circle_mean": (Torus(2), lambda a, b: array(a, b), ["a", "b"], lambda p: list(p)),
    "great_circle_mean": (Sphere(3), lambda a, b: array(F.cos(a), 0, F.sin(a)), ["a"], lambda p: [np.arctan2(p[2], p[0])]),
    "covariance_affine_mean": (SPDAffineInvariant(2), lambda a, b: array(F.exp(a), 0, 0, F.exp(b)), ["a", "b"], lambda p: [np.log(p[0, 0]), np.log(p[1, 1])]),
    "covariance_transport_mean": (SPDBuresWasserstein(2), lambda a, b: array(F.exp(2 * a), 0, 0, F.exp(2 * b)), ["exp(a)", "exp(b)"], lambda p: [np.sqrt(p[0, 0]), np.sqrt(p[1, 1])]),
}


def _mean_query(geometry: Geometry, point, n: int, told) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = angles(spark, sf).select("segment", stamped(point(F.col("a"), F.col("b")), "point", geometry))
        got = location.frechet_means(geometry, rows, group="segment", tol=1e-10)
        found = [(g, *(round(float(v), 4) + 0.0 for v in told(m.point))) for g, m in got.items()]
        return spark.createDataFrame(found, "segment string, " + ", ".join(f"mean_{k} double" for k in range(n)))

    return run


for _name, (_geometry, _points, _parts, _told) in MEANS.items():
    QUERIES[_name] = _mean_query(_geometry, _points, len(_parts), _told)
    ORACLE[_name] = f"SELECT segment, {', '.join(f'round(avg({x}), 4) + 0.0 AS mean_{k}' for k, x in enumerate(_parts))} FROM ({ANGLES}) GROUP BY segment"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _curved(spark: SparkSession, sf: str) -> dict[str, tuple[Geometry, DataFrame]]:
    """Points in general position, by name."""
    rows = angles(spark, sf)
    a, b = F.col("a"), F.col("b")
    tilted = array(F.cos(a) * F.cos(b), -F.sin(a), F.cos(a) * F.sin(b), F.sin(a) * F.cos(b), F.cos(a), F.sin(a) * F.sin(b), -F.sin(b), 0, F.cos(b))
    spots = {
        "rotations": (SpecialOrthogonal(3), tilted),
        "lines_in_space": (Grassmann(3, 1), array(F.cos(a / 4) * F.cos(b / 4), F.sin(a / 4) * F.cos(b / 4), F.sin(b / 4))),
        "directions": (Sphere(3), array(F.cos(a / 3) * F.cos(b / 3), F.sin(a / 3) * F.cos(b / 3), F.sin(b / 3))),
        "triangles": (KendallShape(3, 2), triangle(a, F.lit(0.5) + b / 4)),
        "covariances": (SPDAffineInvariant(2), array(F.exp(a), a / 10, a / 10, F.exp(b))),
        "covariances_by_transport": (SPDBuresWasserstein(2), array(F.exp(a), a / 10, a / 10, F.exp(b))),
    }
    return {name: (m, rows.select("id", stamped(p, "point", m))) for name, (m, p) in spots.items()}


_CURVED = "(VALUES ('rotations'), ('lines_in_space'), ('directions'), ('triangles'), ('covariances'), ('covariances_by_transport'))"


@query(f"SELECT name, true AS converged, true AS stationary FROM {_CURVED} AS t(name)")
def curved_means_are_stationary(spark: SparkSession, sf: str) -> DataFrame:
    """The mean logarithm at a Fréchet mean is 0, which holds at minima alone; an aggregate of its own, not the iteration's."""
    out = []
    for name, (m, x) in _curved(spark, sf).items():
        mean = location.frechet_mean(m, x, tol=1e-9)
        at = F.array(*[F.lit(float(v)) for v in mean.point.ravel()])
        logs = x.select(columns(m).log(at, F.col("point")).alias("u"))
        u = np.array(logs.agg(F.array(*[F.avg(F.get("u", F.lit(i))) for i in range(m.length)]).alias("u")).first()["u"]).reshape(1, *m.shape)
        out.append((name, bool(mean.converged), bool(m.norm(mean.point[None], u)[0] < 1e-5)))
    return spark.createDataFrame(out, "name string, converged boolean, stationary boolean")


@query(f"SELECT name, true AS not_better FROM {_CURVED} AS t(name)")
def curved_medians_are_minimal(spark: SparkSession, sf: str) -> DataFrame:
    """No point a small step away from a Fréchet median, in any of twelve directions, has a smaller mean distance."""
    out = []
    for name, (m, x) in _curved(spark, sf).items():
        at = location.frechet_median(m, x, tol=1e-8).point
        rng = np.random.default_rng(5)
        near = [at] + [m.exp(at[None], m.random_tangent(rng, at[None], 0.02, True))[0] for _ in range(12)]
        spots = [F.array(*[F.lit(float(v)) for v in p.ravel()]) for p in near]
        wide = x.select("point", *[p.alias(f"p{k}") for k, p in enumerate(spots)])
        costs = wide.select(*[columns(m).dist(f"p{k}", "point").alias(f"d{k}") for k in range(13)]).agg(*[F.avg(f"d{k}") for k in range(13)]).first()
        out.append((name, bool(min(costs[1:]) >= costs[0] - 1e-6)))
    return spark.createDataFrame(out, "name string, not_better boolean")


@query(
    "SELECT scenario, solver, CASE WHEN scenario IN ('dominant_subspace', 'covariance_mean', 'correlation_mean') AND solver = 'TrustRegions' THEN NULL ELSE true END AS reached FROM (VALUES ('dominant_eigenvector'), ('dominant_subspace'), "
    "('covariance_mean'), ('correlation_mean'), ('product_target')) AS a(scenario), (VALUES ('SteepestDescent'), ('ConjugateGradient'), ('TrustRegions'), ('BarzilaiBorwein'), ('LBFGS')) AS b(solver)"
)
def solver_optima(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each solver reaches the known optimum of each scenario, to 1e-3; null where it needs a Hessian that isn't given."""
    from tangentia.plans.scenarios import WAVE, product_goal, runs

    # In the charts of the two means, the optimum is the variance of the points' coordinates.
    flat = {"covariance_mean": (SPDLogEuclidean(3), "logm", 2), "correlation_mean": (CorrelationECM(3), "chart", 3)}
    # Each phase t of the product minimises (t - goal) ** 2 + WAVE sin t; Newton's method finds where.
    goal = product_goal()[3:]
    t = goal.copy()
    for _ in range(30):
        t -= (2 * (t - goal) + WAVE * np.cos(t)) / (2 - WAVE * np.sin(t))
    best = {"dominant_eigenvector": -6.0, "dominant_subspace": -11.0, "product_target": float(((t - goal) ** 2 + WAVE * np.sin(t)).sum())}
    for name, (m, chart, seed) in flat.items():
        z = getattr(m, chart)(m.random_point(np.random.default_rng(seed), 8))
        best[name] = float(((z - z.mean(0)) ** 2).sum((1, 2)).mean())
    known = spark.createDataFrame(list(best.items()), "scenario string, optimum double")
    close = F.abs(F.col("final_cost") - F.col("optimum")) < 1e-3
    return runs(spark, 200).join(known, "scenario").select("scenario", "solver", F.when(~F.col("reason").startswith("unsupported"), close).alias("reached"))


@query(f"WITH x AS ({ANGLES}), o AS (SELECT a AS a0, b AS b0 FROM x WHERE id = (SELECT min(id) FROM x)) SELECT id, round(sqrt((a - a0) ^ 2 + (b - b0) ^ 2), 5) + 0.0 AS distance FROM x, o")
def landmark_mds_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of all rows' coordinates to the first row's; landmark coordinates of flat points keep distances."""
    rows = angles(spark, sf).select("id", stamped(array(F.col("a"), F.col("b")), "point", Euclidean(2)))
    placed, _ = embedding.landmark_mds(Euclidean(2), rows, n_landmarks=100)
    first = placed.orderBy("id").select("coordinates").first()[0]
    gap = F.sqrt(sum((F.pow(F.get("coordinates", F.lit(k)) - v, 2) for k, v in enumerate(first)), F.lit(0.0)))
    return placed.select("id", (F.round(gap, 5) + 0.0).alias("distance"))


def as_instant(ts: Column) -> Column:
    """A timestamp without a zone as one with, in UTC whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")


def as_clock(ts: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def streamed(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What make() gives for the table events as a stream, read to its end.

    Complete results may be as many as the events: the last batch's are kept in the shared folder, not on the driver.
    Updates are few rows, in a table in memory.
    """
    name = f"stream_{uuid.uuid4().hex}"
    source = f"{sf}/events.parquet"
    rows = spark.read.parquet(source)
    reader = spark.readStream.schema(rows.schema)
    alone = rows.inputFiles()[0].endswith("/events.parquet")
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf) if alone else reader.parquet(source)
    if dict(rows.dtypes)["ts"] == "timestamp_ntz":
        stream = stream.withColumn("ts", as_instant(F.col("ts")))
    out = make(stream)
    writer = out.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{shared(spark)}/{name}").trigger(availableNow=True)
    if mode != "complete":
        writer.format("memory").start().awaitTermination()
        return spark.table(name)
    at = []

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{shared(spark)}/{name}-{k}")
        at.append(k)

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{shared(spark)}/{name}-{at[-1]}") if at else spark.createDataFrame([], out.schema)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, round(atan2(avg(sin(value)), avg(cos(value))), 6) + 0.0 AS mean, count(*) AS n FROM events GROUP BY 1")
def streamed_circular_means(spark: SparkSession, sf: str) -> DataFrame:
    out = streamed(spark, sf, lambda s: windowed_circular_mean(s, "ts", "value", "1 day"), "complete")
    return out.select(as_clock(F.col("window.start")).alias("day"), six(F.col("mean")).alias("mean"), "n")


@query("SELECT event_type, round(avg(value), 4) + 0.0 AS mean, count(*) AS n FROM events GROUP BY 1")
def streamed_keyed_means(spark: SparkSession, sf: str) -> DataFrame:
    points = lambda s: s.select("event_type", "event_id", stamped(F.array("value"), "point", Euclidean(1)))
    out = streamed(spark, sf, lambda s: keyed_frechet_mean(Euclidean(1), points(s), "event_type", order="event_id"), "update")
    last = out.groupBy("event_type").agg(F.max_by("point", "n").alias("point"), F.max("n").alias("n"))
    return last.select("event_type", (F.round(F.get("point", F.lit(0)), 4) + 0.0).alias("mean"), "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k"
)
def streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = streamed(spark, sf, lambda s: session_counts(s, "ts", "user_id", "2 hours"), "complete")
    return out.select("user_id", as_clock(F.col("session_window.start")).alias("first"), "n")
