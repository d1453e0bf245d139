"""Points from ordinary tables: times, histograms, moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.functions import ProbabilitySimplex, SPDLogEuclidean, Torus
from tangentia.operators.data import stamped


def time_of_day(ts: Column) -> Column:
    """The time of the day as an angle in [-pi, pi)."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return seconds * (2 * math.pi / 86400) - math.pi


def day_of_week(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1) * (2 * math.pi / 7) - math.pi


def clock_points(df: DataFrame, ts: str, out: str = "point") -> DataFrame:
    """Torus(2) points of time of day and day of week."""
    return df.withColumn(out, stamped(F.array(time_of_day(F.col(ts)), day_of_week(F.col(ts))), out, Torus(2)))


def histogram_points(df: DataFrame, key: str, category: str, values: Sequence[str], prior: float = 1.0, out: str = "point") -> DataFrame:
    """One simplex point per key: shares of the categories, each with a prior count. One shuffle of counts."""
    counts = [F.count_if(F.col(category) == v).alias(f"c{i}") for i, v in enumerate(values)]
    rows = df.groupBy(key).agg(*counts)
    n = F.lit(prior * len(values)) + sum((F.col(f"c{i}") for i in range(len(values))), F.lit(0.0))
    return rows.select(key, stamped(F.array(*[(F.col(f"c{i}") + prior) / n for i in range(len(values))]), out, ProbabilitySimplex(len(values))))


def covariance_points(df: DataFrame, key: str, values: Sequence[str], ridge: float = 0.0, out: str = "point") -> DataFrame:
    """One covariance per key of the columns (sample covariance, plus a ridge); keys with one row are left out."""
    n = len(values)
    entries = [F.covar_samp(a, b).alias(f"v{i}_{j}") for i, a in enumerate(values) for j, b in enumerate(values)]
    rows = df.groupBy(key).agg(F.count("*").alias("n"), *entries).filter("n > 1")
    flat = F.array(*[F.col(f"v{i}_{j}") + (ridge if i == j else 0.0) for i in range(n) for j in range(n)])
    return rows.select(key, stamped(flat, out, SPDLogEuclidean(n)))
