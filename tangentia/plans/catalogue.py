"""The named queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.functions import CorrelationECM, Euclidean, Hyperboloid, PoincareBall, ProbabilitySimplex, Product, Sphere, SphereExtrinsic, SPDAffineInvariant, SPDBuresWasserstein, SPDLogEuclidean, Torus
from tangentia.functions.columns import columns
from tangentia.operators import clustering, embedding, inference, learning, location, pairs, prediction, transport
from tangentia.operators.data import as_points, check_points, random_points, stamped
from tangentia.sources import clock_points, covariance_points, histogram_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed values of the test tables.
EVENT_TYPES = ("click", "login", "purchase", "search", "view")
DIM = 64


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def sphere_points(spark, sf, geometry=None) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("point"), "label")
    geometry = geometry or Sphere(DIM)
    rows = as_points(rows, "point", geometry, check="none")
    return rows.withColumn("point", stamped(columns(geometry).project("point"), "point", geometry))


def line_points(df: DataFrame, id_col: str, *values: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), stamped(F.array(*[F.col(v).cast("double") for v in values]), "point", Euclidean(len(values))))


E = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: v::DOUBLE) AS w FROM embeddings),
    x AS (SELECT id, label, list_transform(w, lambda v: v / sqrt(list_inner_product(w, w))) AS p FROM e)"""
ACOS = "acos(greatest(-1.0, least(1.0, list_inner_product({0}.p, {1}.p))))"
NEAR = E + f""", d AS (SELECT a.id AS query_id, b.id AS neighbor_id, b.label, {ACOS.format("a", "b")} AS distance FROM x a JOIN x b ON a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)"""


@query(NEAR + " SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) + 0.0 AS distance FROM n WHERE rank <= 5")
def sphere_knn(spark, sf):
    return pairs.nearest_neighbors(Sphere(DIM), sphere_points(spark, sf), n_neighbors=5).withColumn("distance", r6("distance"))


@query(NEAR + ", v AS (SELECT query_id, label, count(*) AS votes FROM n WHERE rank <= 5 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS k FROM v) SELECT query_id AS vec_id, label AS prediction, votes FROM b WHERE k = 1")
def knn_vote(spark, sf):
    """For each embedding the majority label of its five nearest neighbours by geodesic distance."""
    x = sphere_points(spark, sf)
    near = pairs.nearest_neighbors(Sphere(DIM), x, n_neighbors=5).join(x.select(F.col("id").alias("neighbor_id"), "label"), "neighbor_id")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("query_id").agg(F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), F.col("label"))).alias("b"))
    return best.select(F.col("query_id").alias("vec_id"), F.col("b.label").alias("prediction"), F.col("b.votes").alias("votes"))


@query(NEAR.replace("a.id <> b.id", "true") + ", h AS (SELECT query_id, label, sum(CASE WHEN distance <= 1e-6 THEN 1e6 ELSE 1 / distance END) AS v FROM n WHERE rank <= 5 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) AS k FROM h) SELECT query_id AS vec_id, label AS prediction FROM b WHERE k = 1")
def knn_distance_vote(spark, sf):
    """k-NN classifier with inverse distances; a training row finds itself first."""
    x = sphere_points(spark, sf)
    return prediction.knn_classifier(Sphere(DIM), x, "label", 5, "distance").transform(x).select(F.col("id").alias("vec_id"), "prediction")


@query(E + f" SELECT a.label AS label_i, b.label AS label_j, count(*) AS n, round(avg({ACOS.format('a', 'b')}), 6) AS mean_distance, round(max({ACOS.format('a', 'b')}), 6) AS max_distance FROM x a, x b WHERE a.id <> b.id GROUP BY 1, 2")
def sphere_pairwise_by_label(spark, sf):
    x = sphere_points(spark, sf)
    d = pairs.pairwise_distances(Sphere(DIM), x).filter("i <> j")
    side = lambda k: x.select(F.col("id").alias(k), F.col("label").alias(f"label_{k}"))
    d = d.join(side("i"), "i").join(side("j"), "j")
    return d.groupBy("label_i", "label_j").agg(F.count("*").alias("n"), r6(F.avg("distance")).alias("mean_distance"), r6(F.max("distance")).alias("max_distance"))


MEANS = E + """, u AS (SELECT label, generate_subscripts(p, 1) AS k, unnest(p) AS v FROM x), s AS (SELECT label, k, avg(v) AS v FROM u GROUP BY 1, 2),
    m AS (SELECT label, k, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM s)"""


@query(MEANS + " SELECT label, (k - 1)::INTEGER AS k, round(v, 6) + 0.0 AS v FROM m")
def sphere_extrinsic_mean_by_label(spark, sf):
    m = location.extrinsic_mean(SphereExtrinsic(DIM), sphere_points(spark, sf, SphereExtrinsic(DIM)), group="label")
    return m.select("label", F.posexplode("mean").alias("k", "v")).withColumn("v", r6("v"))


@query(MEANS + ", c AS (SELECT label, list(v ORDER BY k) AS p FROM m GROUP BY 1), d AS (SELECT x.id AS vec_id, c.label AS prediction, acos(greatest(-1.0, least(1.0, list_inner_product(x.p, c.p)))) AS d FROM x, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, prediction) AS k FROM d) SELECT vec_id, prediction, round(d, 6) AS distance FROM b WHERE k = 1")
def nearest_extrinsic_centroid(spark, sf):
    x = sphere_points(spark, sf, SphereExtrinsic(DIM))
    m = sorted((r["label"], r["mean"]) for r in location.extrinsic_mean(SphereExtrinsic(DIM), x, group="label").collect())
    near = clustering.assigned(SphereExtrinsic(DIM), x, np.array([p for _, p in m]))
    names = F.array(*[F.lit(k) for k, _ in m])
    return near.select(F.col("id").alias("vec_id"), F.get(names, F.col("cluster")).alias("prediction"), r6("distance").alias("distance"))


NEXT = E + f", q AS (SELECT a.id, {ACOS.format('a', 'b')} AS d FROM x a JOIN x b ON b.id = a.id + 1)"


def _next_pairs(spark, sf) -> DataFrame:
    x = sphere_points(spark, sf)
    return x.select("id", F.col("point").alias("x")).join(x.select((F.col("id") - 1).alias("id"), F.col("point").alias("y")), "id")


@query(NEXT + " SELECT id AS vec_id, round(d, 6) AS log_norm, 0.0::DOUBLE AS gap, round(d, 6) AS moved_norm FROM q")
def sphere_exp_log_transport(spark, sf):
    """log's norm, the gap of exp after log, and the norm of the log carried along its own geodesic."""
    c = columns(Sphere(DIM))
    q = _next_pairs(spark, sf).withColumn("u", c.log("x", "y"))
    back = F.aggregate(F.zip_with(c.exp("x", "u"), "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return q.select(F.col("id").alias("vec_id"), r6(c.norm("x", F.col("u"))).alias("log_norm"), r6(F.round(F.sqrt(back), 6)).alias("gap"), r6(c.norm("y", c.transport("x", "y", "u"))).alias("moved_norm"))


@query(NEXT + ", g AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS t) SELECT id AS vec_id, t::DOUBLE AS t, round(t * d, 5) AS from_x, round((1 - t) * d, 5) AS to_y FROM q, g")
def geodesic_interpolation_grid(spark, sf):
    c = columns(Sphere(DIM))
    g = pairs.geodesic_interpolation(Sphere(DIM), _next_pairs(spark, sf), "x", "y", [0.0, 0.25, 0.5, 1.0])
    r5 = lambda v: F.round(v, 5) + F.lit(0.0)
    return g.select(F.col("id").alias("vec_id"), "t", r5(F.when(F.col("t") == 0, 0.0).otherwise(c.dist("x", "point"))).alias("from_x"), r5(F.when(F.col("t") == 1, 0.0).otherwise(c.dist("y", "point"))).alias("to_y"))


@query("SELECT count(*) AS n_samples, count(*) FILTER (abs(sqrt(list_inner_product(w, w)) - 1) > 1e-6) AS invalid, 0::BIGINT AS nulls, count(*) FILTER (abs(sqrt(list_inner_product(w, w)) - 1) > 1e-6) = 0 AS valid FROM (SELECT list_transform(embedding, lambda v: v::DOUBLE * CASE WHEN label = 3 THEN 1.01 ELSE 1.0 END) AS w FROM embeddings)")
def validation_report(spark, sf):
    """Membership of embeddings of which one label's are stretched."""
    x = table(spark, sf, "embeddings").withColumn("point", F.transform("embedding", lambda v: v.cast("double") * F.when(F.col("label") == 3, 1.01).otherwise(1.0)))
    return check_points(x, "point", Sphere(DIM)).select("n_samples", "invalid", "nulls", "valid")


@query("SELECT count(*) AS n, round(max(abs(sqrt(list_inner_product(p, p)) - 1)), 6) AS worst FROM (SELECT list_transform(w, lambda v: v / sqrt(list_inner_product(w, w))) AS p FROM (SELECT list_transform(embedding, lambda v: v::DOUBLE) AS w FROM embeddings))")
def repair_report(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double") * 1.01).alias("point"))
    p = as_points(x, "point", Sphere(DIM), repair=True)
    norm = F.sqrt(F.aggregate("point", F.lit(0.0), lambda s, v: s + v * v))
    return p.agg(F.count("*").alias("n"), r6(F.max(F.abs(norm - 1))).alias("worst"))


CLOCK = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * (2 * pi() / 86400) - pi()"
WEEK = "dayofweek(ts) * (2 * pi() / 7) - pi()"


@query(f"SELECT event_type, round(atan2(avg(sin({CLOCK})), avg(cos({CLOCK}))), 6) AS hour_mean, round(atan2(avg(sin({WEEK})), avg(cos({WEEK}))), 6) AS week_mean FROM events GROUP BY 1")
def torus_clock_mean_by_type(spark, sf):
    m = location.extrinsic_mean(Torus(2), clock_points(table(spark, sf, "events"), "ts"), group="event_type")
    return m.select("event_type", r6(F.get("mean", F.lit(0))).alias("hour_mean"), r6(F.get("mean", F.lit(1))).alias("week_mean"))


WRAP = "({0} - 2 * pi() * floor(({0} + pi()) / (2 * pi())))"


@query(f"""WITH p AS (SELECT event_type, {CLOCK} AS a, {WEEK} AS b FROM events), m AS (SELECT event_type, atan2(avg(sin(a)), avg(cos(a))) AS ma, atan2(avg(sin(b)), avg(cos(b))) AS mb FROM p GROUP BY 1),
    d AS (SELECT event_type, sqrt({WRAP.format("(a - ma)")} ^ 2 + {WRAP.format("(b - mb)")} ^ 2) AS d FROM p JOIN m USING (event_type))
    SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM d GROUP BY 1""")
def torus_spread_by_type(spark, sf):
    x = clock_points(table(spark, sf, "events"), "ts")
    m = location.extrinsic_mean(Torus(2), x, group="event_type")
    d = x.join(F.broadcast(m), "event_type").withColumn("d", columns(Torus(2)).dist("mean", "point"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_distance"), r6(F.max("d")).alias("max_distance"))


MIX = "WITH c AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') + 1.0 AS c{i}" for i, t in enumerate(EVENT_TYPES)) + " FROM events GROUP BY 1), s AS (SELECT user_id, c0 + c1 + c2 + c3 + c4 AS n, c0, c1, c2, c3, c4 FROM c), x AS (SELECT user_id AS id, [" + ", ".join(f"c{i}::DOUBLE / n" for i in range(5)) + "] AS p FROM s)"


@query(MIX + " SELECT id AS user_id, (generate_subscripts(p, 1) - 1)::INTEGER AS k, round(unnest(p), 6) AS share FROM x")
def simplex_user_mix(spark, sf):
    x = histogram_points(table(spark, sf, "events"), "user_id", "event_type", EVENT_TYPES)
    return x.select("user_id", F.posexplode("point").alias("k", "share")).withColumn("share", r6("share"))


@query("""WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) + 1.0 AS n FROM customer GROUP BY 1, 2),
    g AS (SELECT k, s FROM (SELECT DISTINCT c_nationkey AS k FROM customer), (SELECT DISTINCT c_mktsegment AS s FROM customer)),
    f AS (SELECT g.k, g.s, coalesce(c.n, 1.0)::DOUBLE AS n FROM g LEFT JOIN c ON g.k = c.k AND g.s = c.s), x AS (SELECT k, s, n / sum(n) OVER (PARTITION BY k) AS p FROM f)
    SELECT a.k AS i, b.k AS j, round(2 * acos(greatest(-1.0, least(1.0, sum(sqrt(a.p * b.p))))), 5) + 0.0 AS distance FROM x a JOIN x b ON a.s = b.s WHERE a.k <> b.k GROUP BY 1, 2""")
def simplex_segments_of_nations(spark, sf):
    """Fisher-Rao distances between nations' mixes of market segments."""
    c = table(spark, sf, "customer")
    names = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())
    x = histogram_points(c, "c_nationkey", "c_mktsegment", names).withColumnRenamed("c_nationkey", "id")
    d = pairs.pairwise_distances(ProbabilitySimplex(len(names)), x).filter("i <> j")
    return d.withColumn("distance", F.round("distance", 5) + F.lit(0.0))


COV = "WITH v AS (SELECT l_suppkey AS k, var_samp(l_quantity / 10) AS a, covar_samp(l_quantity / 10, l_discount * 20) AS b, var_samp(l_discount * 20) AS c FROM lineitem GROUP BY 1 HAVING count(*) > 1), w AS (SELECT v.*, s_nationkey, (a + c) / 2 AS m, sqrt(((a - c) / 2) ^ 2 + b ^ 2) AS r FROM v JOIN supplier ON k = s_suppkey)"


def _supplier_covariances(spark, sf, geometry) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20).alias("b"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    x = covariance_points(rows, "l_suppkey", ["a", "b"]).join(s, "l_suppkey").withColumnRenamed("l_suppkey", "id")
    return x.withColumn("point", stamped(F.col("point"), "point", geometry))


@query(COV + """, l AS (SELECT s_nationkey, (ln(m + r) + ln(m - r)) / 2 AS t, (ln(m + r) - ln(m - r)) / (2 * r) AS f, a, b, c, m FROM w),
    g AS (SELECT s_nationkey, avg(t + f * (a - m)) AS a, avg(f * b) AS b, avg(t + f * (c - m)) AS c FROM l GROUP BY 1), h AS (SELECT *, (a + c) / 2 AS m, sqrt(((a - c) / 2) ^ 2 + b ^ 2) AS r FROM g),
    e AS (SELECT *, (exp(m + r) + exp(m - r)) / 2 AS t, CASE WHEN r > 0 THEN (exp(m + r) - exp(m - r)) / (2 * r) ELSE exp(m) END AS f FROM h)
    SELECT s_nationkey, round(t + f * (a - m), 5) AS m00, round(f * b, 5) + 0.0 AS m01, round(t + f * (c - m), 5) AS m11 FROM e""")
def spd_log_euclidean_mean_by_nation(spark, sf):
    """Mean covariance of quantity and discount over the suppliers of a nation: one aggregate in the log chart."""
    means = location.frechet_means(SPDLogEuclidean(2), _supplier_covariances(spark, sf, SPDLogEuclidean(2)), group="s_nationkey")
    rows = [(g, round(float(m.point[0, 0]), 5), round(float(m.point[0, 1]), 5) + 0.0, round(float(m.point[1, 1]), 5)) for g, m in means.items()]
    return spark.createDataFrame(rows, "s_nationkey int, m00 double, m01 double, m11 double")


PAIR2 = COV + " SELECT p.k AS i, q.k AS j, round({0}, 5) + 0.0 AS distance FROM w p JOIN w q ON p.k < q.k"


@query(PAIR2.format("sqrt(greatest(0.0, p.a + p.c + q.a + q.c - 2 * sqrt(p.a * q.a + 2 * p.b * q.b + p.c * q.c + 2 * sqrt((p.a * p.c - p.b ^ 2) * (q.a * q.c - q.b ^ 2)))))"))
def spd_bures_pairs(spark, sf):
    d = pairs.pairwise_distances(SPDBuresWasserstein(2), _supplier_covariances(spark, sf, SPDBuresWasserstein(2))).filter("i < j")
    return d.withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query(COV + """, z AS (SELECT p.k AS i, q.k AS j, (p.c * q.a - 2 * p.b * q.b + p.a * q.c) / (p.a * p.c - p.b ^ 2) AS t, (q.a * q.c - q.b ^ 2) / (p.a * p.c - p.b ^ 2) AS d FROM w p JOIN w q ON p.k < q.k),
    e AS (SELECT i, j, d, (t + sqrt(greatest(0.0, t * t - 4 * d))) / 2 AS l FROM z) SELECT i, j, round(sqrt(ln(l) ^ 2 + ln(d / l) ^ 2), 5) + 0.0 AS distance FROM e""")
def spd_affine_invariant_pairs(spark, sf):
    d = pairs.pairwise_distances(SPDAffineInvariant(2), _supplier_covariances(spark, sf, SPDAffineInvariant(2))).filter("i < j")
    return d.withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query(COV + ", o AS (SELECT s_nationkey, b / sqrt(a * c) AS q FROM w), z AS (SELECT s_nationkey, avg(q / sqrt(1 - q * q)) AS z FROM o GROUP BY 1) SELECT s_nationkey, round(z / sqrt(1 + z * z), 6) + 0.0 AS correlation FROM z")
def correlation_ecm_mean_by_nation(spark, sf):
    x = as_points(_supplier_covariances(spark, sf, SPDLogEuclidean(2)), "point", CorrelationECM(2), representation="covariance", check="none")
    means = location.frechet_means(CorrelationECM(2), x, group="s_nationkey")
    return spark.createDataFrame([(g, round(float(m.point[0, 1]), 6) + 0.0) for g, m in means.items()], "s_nationkey int, correlation double")


BALL = "WITH x AS (SELECT s_suppkey AS id, s_acctbal / 20000 AS a, (s_nationkey - 12) / 30.0::DOUBLE AS b FROM supplier), d AS (SELECT x.id AS i, y.id AS j, acosh(1 + 2 * ((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2) / ((1 - x.a ^ 2 - x.b ^ 2) * (1 - y.a ^ 2 - y.b ^ 2))) AS d FROM x JOIN x y ON x.id < y.id)"


def _ball_points(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), stamped(F.array(F.col("s_acctbal") / 20000, (F.col("s_nationkey") - 12) / F.lit(30.0)), "point", PoincareBall(2)))


@query(BALL + " SELECT i, j, round(d, 5) + 0.0 AS distance, round(d, 5) + 0.0 AS on_hyperboloid FROM d")
def poincare_supplier_pairs(spark, sf):
    """Distances in the ball, and of the same points on the hyperboloid."""
    x = _ball_points(spark, sf)
    h = as_points(x.withColumn("upper", F.col("point")), "upper", Hyperboloid(3), representation="poincare", check="none")
    both = pairs.pairs_once({"distance": (PoincareBall(2), "point"), "on_hyperboloid": (Hyperboloid(3), "upper")}, h)
    return both.select("i", "j", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("distance", "on_hyperboloid")])


@query("""WITH x AS (SELECT s_suppkey AS id, s_acctbal AS v, s_nationkey * (2 * pi() / 25) - pi() AS t FROM supplier)
    SELECT a.id AS i, b.id AS j, round(sqrt(((a.v - b.v) / 1000) ^ 2 + """ + WRAP.format("(b.t - a.t)") + """ ^ 2), 5) + 0.0 AS distance FROM x a JOIN x b ON a.id < b.id""")
def product_value_phase_pairs(spark, sf):
    """A struct of a number and an angle as one point of a product."""
    m = Product({"phase": Torus(1), "value": Euclidean(1)})
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.struct(F.array(F.col("s_nationkey") * (2 * np.pi / 25) - np.pi).alias("phase"), F.array(F.col("s_acctbal") / 1000).alias("value")).alias("point"))
    d = pairs.pairwise_distances(m, as_points(s, "point", m, check="none")).filter("i < j")
    return d.withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(abs(a.s_acctbal - b.s_acctbal), 6) AS distance FROM supplier a, supplier b WHERE abs(a.s_acctbal - b.s_acctbal) <= 100")
def supplier_radius_join(spark, sf):
    x = line_points(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal")
    return pairs.distance_join(Euclidean(1), x, x, 100.0).withColumn("distance", r6("distance"))


@query("WITH d AS (SELECT a.s_suppkey AS id, sum((a.s_acctbal - b.s_acctbal) ^ 2) AS cost FROM supplier a, supplier b GROUP BY 1) SELECT id, round(cost, 2) AS cost FROM d ORDER BY cost, id LIMIT 1")
def supplier_medoid(spark, sf):
    m = pairs.medoid(Euclidean(1), line_points(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal"))
    return spark.createDataFrame([(m["id"], round(m["cost"], 2))], "id long, cost double")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS m0, round(avg(l_discount), 6) AS m1, round(var_pop(l_quantity) + var_pop(l_discount), 5) AS variance FROM lineitem GROUP BY 1")
def euclidean_mean_by_flag(spark, sf):
    x = table(spark, sf, "lineitem").select("l_returnflag", stamped(F.array("l_quantity", "l_discount"), "point", Euclidean(2)))
    means = location.frechet_means(Euclidean(2), x, group="l_returnflag")
    return spark.createDataFrame([(g, round(float(m.point[0]), 6), round(float(m.point[1]), 6), round(m.objective, 5)) for g, m in means.items()], "l_returnflag string, m0 double, m1 double, variance double")


@query("SELECT round(avg(value), 6) AS mean, count(*) AS n FROM events")
def streaming_mean_of_values(spark, sf):
    m = location.streaming_frechet_mean(Euclidean(1), line_points(table(spark, sf, "events"), "event_id", "value"))
    return spark.createDataFrame([(round(float(m.point[0]), 6), m.iterations)], "mean double, n long")


@query("WITH m AS (SELECT avg(value) AS c FROM events), s AS (SELECT event_id AS id, round(abs(value - c), 9) AS d, abs(value - c) AS score FROM events, m), r AS (SELECT id, score, rank() OVER (ORDER BY d) - 1 AS less, count(*) OVER (PARTITION BY d) AS same, count(*) OVER () AS n FROM s) SELECT id, round(score, 6) AS score, round((less + 0.5 * (same + 1)) / n, 6) AS rank FROM r")
def metric_ranks_of_values(spark, sf):
    e = table(spark, sf, "events")
    center = [e.agg(F.avg("value")).first()[0]]
    r = location.metric_distance_ranks(Euclidean(1), line_points(e, "event_id", "value"), center=center)
    return r.select("id", r6("score").alias("score"), r6("rank").alias("rank"))


@query("SELECT a.s_suppkey AS id, round(1 - abs(avg(sign(b.s_acctbal - a.s_acctbal))), 6) AS depth FROM supplier a, supplier b GROUP BY 1")
def supplier_depth(spark, sf):
    x = line_points(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal")
    return location.geodesic_spatial_depth(Euclidean(1), x, x).withColumn("depth", r6("depth"))


KERNEL = "WITH q AS (SELECT DISTINCT p_size FROM part), k AS (SELECT q.p_size, p_retailprice AS y, exp(-0.5 * ((q.p_size - p.p_size) / 3.0) ^ 2) AS w FROM q, part p) SELECT p_size, round(sum(w * y) / sum(w), 4) AS prediction FROM k GROUP BY 1"


@query(KERNEL)
def kernel_price_by_size(spark, sf):
    p = table(spark, sf, "part")
    train = p.select(F.col("p_partkey").alias("id"), stamped(F.array(F.col("p_size").cast("double")), "point", Euclidean(1)), "p_retailprice")
    sizes = p.select("p_size").distinct().select(F.col("p_size").cast("long").alias("id"), stamped(F.array(F.col("p_size").cast("double")), "point", Euclidean(1)), "p_size")
    out = prediction.kernel_regression(Euclidean(1), train, "p_retailprice", 3.0).transform(sizes)
    return out.select("p_size", F.round("prediction", 4).alias("prediction"))


TWO = "WITH a AS (SELECT value AS v FROM events WHERE event_type = 'click'), b AS (SELECT value AS v FROM events WHERE event_type = 'view'), w AS (SELECT (SELECT avg(abs(x.v - y.v)) FROM a x, a y) AS aa, (SELECT avg(abs(x.v - y.v)) FROM a x, b y) AS ab, (SELECT avg(abs(x.v - y.v)) FROM b x, b y) AS bb, (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m)"


@query(TWO + " SELECT round(greatest(2 * ab - aa - bb, 0), 6) AS energy, round((aa * n / (n - 1) - ab) ^ 2 + (ab - bb * m / (m - 1)) ^ 2, 6) AS biswas_ghosh FROM w")
def two_type_statistics(spark, sf):
    """Energy and Biswas-Ghosh statistics of the values of clicks and views, over all pairs."""
    e = table(spark, sf, "events")
    a, b = (line_points(e.filter(F.col("event_type") == k), "event_id", "value") for k in ("click", "view"))
    n, m = a.count(), b.count()
    xx, xy, yy = inference.mean_distances(Euclidean(1), a, b)
    energy = max(2 * xy - xx * (n - 1) / n - yy * (m - 1) / m, 0.0)
    return spark.createDataFrame([(round(energy, 6), round(inference.biswas_ghosh_statistic(xx, xy, yy), 6))], "energy double, biswas_ghosh double")


@query("""WITH m AS (SELECT event_type AS g, count(*)::DOUBLE AS n, avg(value) AS c FROM events GROUP BY 1), d AS (SELECT event_type AS g, (value - c) ^ 2 AS q FROM events JOIN m ON event_type = g),
    v AS (SELECT g, avg(q) AS v, var_pop(q) AS s FROM d GROUP BY 1), x AS (SELECT m.g, n / sum(n) OVER () AS l, sum(n) OVER () AS t, v, s FROM m JOIN v USING (g)),
    u AS (SELECT sum(a.l * b.l * (a.v - b.v) ^ 2 / (a.s * b.s)) AS u FROM x a JOIN x b ON a.g < b.g), f AS (SELECT max(t) AS t, (SELECT var_pop(value) FROM events) - sum(l * v) AS f, sum(l / s) AS p, sum(l * l * s) AS q FROM x),
    z AS (SELECT t * u / p + t * f * f / q AS z FROM u, f) SELECT round(z, 4) AS statistic, round(exp(-z / 2) * (1 + z / 2), 6) AS pvalue FROM z""")
def frechet_anova_of_values(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", stamped(F.array("value"), "point", Euclidean(1)))
    r = inference.frechet_anova(Euclidean(1), e, "event_type")
    return spark.createDataFrame([(round(r.statistic, 4), round(r.pvalue, 6))], "statistic double, pvalue double")


@query("WITH a AS (SELECT l_discount AS v, row_number() OVER (ORDER BY l_discount) AS r FROM lineitem), b AS (SELECT l_tax AS v, row_number() OVER (ORDER BY l_tax) AS r FROM lineitem) SELECT round(sqrt(avg((a.v - b.v) ^ 2)), 6) AS distance FROM a JOIN b USING (r)")
def wasserstein_discount_tax(spark, sf):
    rows = table(spark, sf, "lineitem")
    d = transport.wasserstein_line(rows.select(F.col("l_discount").alias("v")), rows.select(F.col("l_tax").alias("v")), "v")
    return spark.createDataFrame([(round(d, 6),)], "distance double")


@query("""WITH x AS (SELECT c_mktsegment AS l, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b FROM customer), g AS (SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM x GROUP BY l),
    s AS (SELECT sum(n * aa - sa * sa) AS aa, sum(n * ab - sa * sb) AS ab, sum(n * bb - sb * sb) AS bb FROM g), t AS (SELECT sum(n) * sum(aa) - sum(sa) ^ 2 AS aa, sum(n) * sum(ab) - sum(sa) * sum(sb) AS ab, sum(n) * sum(bb) - sum(sb) ^ 2 AS bb FROM g)
    SELECT round(s.aa / 1e6, 4) AS s00, round(s.ab / 1e6, 4) AS s01, round(s.bb / 1e6, 4) AS s11, round((t.aa - s.aa) / 1e6, 4) AS d00, round((t.ab - s.ab) / 1e6, 4) AS d01, round((t.bb - s.bb) / 1e6, 4) AS d11 FROM s, t""")
def metric_learning_scatters(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("z"))
    s, d = learning.pair_scatters(c, F.col("z"), "c_mktsegment")
    values = [round(float(m[i, j]) / 1e6, 4) for m in (s, d) for i, j in ((0, 0), (0, 1), (1, 1))]
    return spark.createDataFrame([tuple(values)], "s00 double, s01 double, s11 double, d00 double, d01 double, d11 double")


def _kmeans_sql(steps: int) -> str:
    centers = "(VALUES (0, -0.5, 4.0), (1, 4.5, 12.0), (2, 9.0, 20.0)) AS t(k, a, b)"
    sql = f"WITH x AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b FROM customer), c0 AS (SELECT k, a::DOUBLE AS a, b::DOUBLE AS b FROM {centers})"
    for i in range(steps + 1):
        sql += f", n{i} AS (SELECT id, x.a, x.b, arg_min(c.k, (x.a - c.a) ^ 2 + (x.b - c.b) ^ 2 + c.k * 1e-12) AS k, min((x.a - c.a) ^ 2 + (x.b - c.b) ^ 2) AS d FROM x, c{i} c GROUP BY 1, 2, 3)"
        sql += f", c{i + 1} AS (SELECT k, avg(a) AS a, avg(b) AS b FROM n{i} GROUP BY 1)"
    return sql + f" SELECT id, k::INTEGER AS cluster, round(sqrt(d), 5) AS distance FROM n{steps}"


@query(_kmeans_sql(3))
def kmeans_three_steps(spark, sf):
    x = line_points(table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b")), "c_custkey", "a", "b")
    k = clustering.kmeans_steps(Euclidean(2), x, np.array([[-0.5, 4.0], [4.5, 12.0], [9.0, 20.0]]), 3)
    return k.labels.withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query("WITH v AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_extendedprice / 1000) AS b, var_pop(l_extendedprice / 1000) AS c FROM lineitem), e AS (SELECT (a + c) / 2 AS m, sqrt(((a - c) / 2) ^ 2 + b ^ 2) AS r FROM v) SELECT round(m + r, 4) AS first, round(m - r, 4) AS second, round((m + r) / (2 * m), 6) AS share FROM e")
def principal_geodesics_flat(spark, sf):
    x = table(spark, sf, "lineitem").select(stamped(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000), "point", Euclidean(2)))
    p = embedding.principal_geodesic_analysis(Euclidean(2), x)
    return spark.createDataFrame([(round(float(p.variances[0]), 4), round(float(p.variances[1]), 4), round(float(p.explained_ratio[0]), 6))], "first double, second double, share double")


@query("SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS slope, round(avg(l_extendedprice / 1000), 6) AS intercept FROM lineitem")
def geodesic_regression_flat(spark, sf):
    x = table(spark, sf, "lineitem").select("l_quantity", stamped(F.array(F.col("l_extendedprice") / 1000), "point", Euclidean(1)))
    r = prediction.geodesic_regression(Euclidean(1), x, "l_quantity")
    return spark.createDataFrame([(round(float(r.slope[0]), 6), round(float(r.intercept[0]), 6))], "slope double, intercept double")


# Without SQL: iterative, fitted or randomised.


def _location_row(spark, m) -> DataFrame:
    return spark.createDataFrame([(np.ravel(m.point).tolist(), float(m.objective), m.iterations, m.converged, m.reason)], "point array<double>, objective double, iterations int, converged boolean, reason string")


@query()
def sphere_frechet_mean_by_label(spark, sf):
    means = location.frechet_means(Sphere(DIM), sphere_points(spark, sf), group="label")
    return spark.createDataFrame([(g, m.point.tolist(), m.objective, m.converged) for g, m in means.items()], "label int, point array<double>, objective double, converged boolean")


@query()
def torus_frechet_median(spark, sf):
    return _location_row(spark, location.frechet_median(Torus(2), clock_points(table(spark, sf, "events"), "ts"), maxiter=50, tol=1e-5))


@query()
def affine_invariant_mean(spark, sf):
    return _location_row(spark, location.frechet_mean(SPDAffineInvariant(2), _supplier_covariances(spark, sf, SPDAffineInvariant(2))))


@query()
def bures_huber_location(spark, sf):
    return _location_row(spark, location.geodesic_m_estimator(SPDBuresWasserstein(2), _supplier_covariances(spark, sf, SPDBuresWasserstein(2)), tol=1e-5))


@query()
def trimmed_mean_of_values(spark, sf):
    return _location_row(spark, location.trimmed_frechet_mean(Euclidean(1), line_points(table(spark, sf, "events"), "event_id", "value"), maxiter=100))


@query()
def supplier_enclosing_ball(spark, sf):
    return _location_row(spark, location.minimum_enclosing_ball(PoincareBall(2), _ball_points(spark, sf), maxiter=100))


@query()
def supplier_coreset(spark, sf):
    return location.lightweight_coreset(PoincareBall(2), _ball_points(spark, sf), 20, seed=7)


@query()
def bootstrap_supplier_mean(spark, sf):
    return location.bootstrap_frechet_mean(PoincareBall(2), _ball_points(spark, sf), seed=3, n_bootstrap=40, tol=1e-5)[1]


@query()
def sphere_kmeans(spark, sf):
    return clustering.kmeans(Sphere(DIM), sphere_points(spark, sf), 10, seed=1, maxiter=30, center_maxiter=20).labels


@query()
def supplier_agglomerative(spark, sf):
    return clustering.agglomerative_clustering(PoincareBall(2), _ball_points(spark, sf), 4).labels


@query()
def supplier_kmedoids(spark, sf):
    return clustering.kmedoids(PoincareBall(2), _ball_points(spark, sf), 4).labels


@query()
def supplier_spectral(spark, sf):
    return clustering.spectral_clustering(PoincareBall(2), _ball_points(spark, sf), 4).labels


@query()
def supplier_mean_shift(spark, sf):
    return clustering.mean_shift(PoincareBall(2), _ball_points(spark, sf), 0.5, maxiter=30).labels


@query()
def supplier_minibatch_kmeans(spark, sf):
    return clustering.minibatch_kmeans(PoincareBall(2), _ball_points(spark, sf), 3, epochs=30).labels


@query()
def supplier_quantization(spark, sf):
    return clustering.competitive_quantization(PoincareBall(2), _ball_points(spark, sf), 3, epochs=3).labels


@query()
def nearest_centroid_labels(spark, sf):
    x = sphere_points(spark, sf)
    return prediction.nearest_centroid_classifier(Sphere(DIM), x, "label").transform(x).select("id", "prediction")


@query()
def tangent_lda_labels(spark, sf):
    x = sphere_points(spark, sf)
    return prediction.tangent_space_discriminant_analysis(Sphere(DIM), x, "label", n_components=16).transform(x).select("id", "prediction")


@query()
def tangent_logistic_labels(spark, sf):
    x = sphere_points(spark, sf)
    return prediction.tangent_space_logistic_regression(Sphere(DIM), x, "label", n_components=6, maxiter=30).transform(x).select("id", "prediction")


@query()
def bandwidth_scores(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), stamped(F.array(F.col("s_nationkey").cast("double")), "point", Euclidean(1)), "s_acctbal")
    return prediction.select_kernel_bandwidth(Euclidean(1), s, "s_acctbal", [1.0, 3.0, 9.0])[1]


@query()
def local_linear_prices(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("t"), stamped(F.array(F.col("s_acctbal") / 1000), "point", Euclidean(1)))
    return prediction.local_polynomial_regression(Euclidean(1), s, "t", 4.0).transform(s.select("id", "t"), "t")


@query()
def supplier_mds(spark, sf):
    x = _ball_points(spark, sf)
    return embedding.classical_mds(PoincareBall(2), x).table(x)


@query()
def supplier_kernel_pca(spark, sf):
    x = _ball_points(spark, sf)
    return embedding.kernel_pca(PoincareBall(2), x).table(x)


@query()
def supplier_isomap(spark, sf):
    x = _ball_points(spark, sf)
    return embedding.isomap(PoincareBall(2), x, mutual=False, disconnected="max_finite").table(x)


@query()
def supplier_sammon(spark, sf):
    x = _ball_points(spark, sf)
    return embedding.sammon_mapping(PoincareBall(2), x, maxiter=50).table(x)


@query()
def supplier_tsne(spark, sf):
    x = _ball_points(spark, sf)
    return embedding.tsne(PoincareBall(2), x, seed=1, perplexity=3.0, maxiter=100).table(x)


@query()
def supplier_phate(spark, sf):
    x = _ball_points(spark, sf)
    return embedding.phate(PoincareBall(2), x).table(x)


def _two_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier")
    x = _ball_points(spark, sf).join(s.select(F.col("s_suppkey").alias("id"), "s_acctbal"), "id")
    return x.filter("s_acctbal < 4500").drop("s_acctbal"), x.filter("s_acctbal >= 4500").drop("s_acctbal")


@query()
def two_sample_tests(spark, sf):
    a, b = _two_sides(spark, sf)
    m = PoincareBall(2)
    tests = [f(m, a, b, seed=5, n_permutations=39) for f in (inference.biswas_ghosh_two_sample_test, inference.energy_two_sample_test, inference.kernel_mmd_two_sample_test, inference.wasserstein_two_sample_test) if f is not inference.kernel_mmd_two_sample_test]
    tests.append(inference.kernel_mmd_two_sample_test(m, a, b, seed=5, n_permutations=39, check_psd=False))
    return spark.createDataFrame([(t.method, float(t.statistic), t.pvalue) for t in tests], "method string, statistic double, pvalue double")


@query()
def paired_test(spark, sf):
    x = _ball_points(spark, sf)
    y = x.withColumn("point", F.transform("point", lambda v: v * 0.9))
    t = inference.paired_frechet_test(PoincareBall(2), x, y, seed=5, n_permutations=39)
    return spark.createDataFrame([(t.method, t.statistic, t.pvalue)], "method string, statistic double, pvalue double")


@query()
def exact_transport_plan(spark, sf):
    a, b = _two_sides(spark, sf)
    return transport.empirical_wasserstein_distance(PoincareBall(2), a, b).table(a)


@query()
def sinkhorn_of_suppliers(spark, sf):
    a, b = _two_sides(spark, sf)
    return spark.createDataFrame([(transport.sinkhorn_divergence(PoincareBall(2), a, b, epsilon=0.5, maxiter=4),)], "divergence double")


@query()
def learned_metric_features(spark, sf):
    x = line_points(table(spark, sf, "customer").withColumn("n", F.col("c_nationkey").cast("double")), "c_custkey", "c_acctbal", "n").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id")
    return learning.riemannian_metric_learning(Euclidean(2), x, "c_mktsegment").transform(x).select("id", "features")


@query()
def barycentric_codes(spark, sf):
    return learning.geodesic_barycentric_coding(PoincareBall(2), _ball_points(spark, sf), [[0.0, 0.0], [0.4, 0.3], [0.3, -0.3]]).select("id", "code", "reconstruction")


@query()
def dictionary_atoms(spark, sf):
    d = learning.manifold_dictionary_learning(PoincareBall(2), _ball_points(spark, sf), 3, seed=2, maxiter=4)
    return spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(d.atoms)], "atom int, point array<double>")


@query()
def propagated_labels(spark, sf):
    x = sphere_points(spark, sf).withColumn("known", F.when(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.col("label")).otherwise(-1))
    return learning.label_propagation(Sphere(DIM), x, "known", n_neighbors=7, maxiter=10).select("id", "prediction")


@query()
def regularized_values(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), stamped(F.array(F.col("s_nationkey").cast("double")), "point", Euclidean(1)), F.when(F.col("s_nationkey") > 5, F.col("s_acctbal")).alias("y"))
    return learning.manifold_regularized_regression(Euclidean(1), s, "y")


@query()
def random_rotations(spark, sf):
    from tangentia.functions import SpecialOrthogonal

    return random_points(spark, SpecialOrthogonal(3), 100, seed=11)


@query()
def solver_scenarios(spark, sf):
    from tangentia.plans.scenarios import runs

    return runs(spark).drop("seconds")
