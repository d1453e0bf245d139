"""Streams of points: keyed inductive means, windowed means in flat charts, mini-batch clustering."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tangentia.functions import Geometry
from tangentia.operators.location import streaming_fold
from tangentia.operators.pairs import distances, stacked
from tangentia.session import reachable


def keyed_frechet_mean(geometry: Geometry, stream: DataFrame, key: str, point: str = "point", order: str = "id", weight: str | None = None, prior: tuple | None = None) -> DataFrame:
    """(key, point, weight, n): the inductive mean of each key so far, updated by each micro-batch in the order of a column.

    State is a point, its mass and a count per key. prior: (point, mass) that every key starts
    with, in units of the rows' weights. Between micro-batches the order is that of arrival.
    """
    reachable(stream.sparkSession)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = stream.select(F.col(key).alias("k"), F.col(point).alias("x"), F.col(order).alias("o"), w.alias("w"))
    kind = stream.schema[key].dataType.simpleString()
    start = None if prior is None else (np.asarray(prior[0], float).reshape(geometry.shape), float(prior[1]))

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, mass, n = (start[0], start[1], 0) if start else (None, 0.0, 0)
        if state.exists:
            p, mass, n = state.get
            at = np.array(json.loads(p)).reshape(geometry.shape)
        batch = pd.concat(list(parts)).sort_values("o", kind="stable")
        at, mass = streaming_fold(geometry, stacked(geometry, batch["x"]), batch["w"].to_numpy(float), at, mass)
        n += len(batch)
        if at is not None:
            state.update((json.dumps(np.ravel(at).tolist()), float(mass), int(n)))
            yield pd.DataFrame({"k": [k[0]], "x": [np.ravel(at)], "w": [mass], "n": [n]})

    out = rows.groupBy("k").applyInPandasWithState(fold, f"k {kind}, x array<double>, w double, n long", "p string, w double, n long", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnsRenamed({"k": key, "x": "point", "w": "weight"})


def windowed_circular_mean(stream: DataFrame, ts: str, angle: str, width: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window, keys, mean, resultant, n): circular means by event-time window; late rows join until the watermark passes."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    rows = stream.withWatermark(ts, late).groupBy(w, *keys)
    return rows.agg(F.atan2(s, c).alias("mean"), F.sqrt(s * s + c * c).alias("resultant"), F.count("*").alias("n"))


def windowed_flat_mean(stream: DataFrame, ts: str, coordinates: str, length: int, width: str, late: str = "1 hour", keys: tuple[str, ...] = (), back: Callable[[Column], Column] | None = None) -> DataFrame:
    """(window, keys, mean, n): means of chart coordinates by window, mapped back to points by `back`."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    out = rows.agg(F.array(*[F.avg(F.get(coordinates, F.lit(i))) for i in range(length)]).alias("mean"), F.count("*").alias("n"))
    return out if back is None else out.withColumn("mean", back(F.col("mean")))


def session_counts(stream: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


class StreamingKMeans:
    """Centres that each micro-batch moves: the batch's mean logarithm by cluster, in steps of rate / (1 + decay * updates).

    Use as foreachBatch(model.update); a batch's sums are one aggregate.
    """

    def __init__(self, geometry: Geometry, centers, rate: float = 0.5, decay: float = 0.01, point: str = "point"):
        self.geometry, self.centers = geometry, np.asarray(centers, float).reshape(-1, *geometry.shape).copy()
        self.rate, self.decay, self.point, self.updates = rate, decay, point, np.zeros(len(self.centers))

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        g, centers = self.geometry, self.centers
        reachable(batch.sparkSession)

        def sums(parts):
            for p in parts:
                if len(p):
                    x = stacked(g, p["x"])
                    near = distances(g, x, centers).argmin(1)
                    for c in np.unique(near):
                        u = g.log(centers[c][None], x[near == c])
                        yield pd.DataFrame({"c": [int(c)], "u": [u.reshape(len(u), -1).sum(0)], "n": [len(u)]})

        rows = batch.select(F.col(self.point).alias("x")).mapInPandas(sums, "c int, u array<double>, n long")
        got = rows.groupBy("c").agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(g.length)]).alias("u"), F.sum("n").alias("n")).collect()
        for r in got:
            step = self.rate / (1 + self.decay * self.updates[r["c"]]) * np.array(r["u"]).reshape(1, *g.shape) / r["n"]
            self.centers[r["c"]] = g.exp(centers[r["c"]][None], step)[0]
            self.updates[r["c"]] += 1
