"""What operators need of a session."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="tangentia-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the shared checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def appended(df: DataFrame, f, fields: str) -> DataFrame:
    """df with further columns, which f makes of a pandas frame of each batch; metadata of the others stays.

    A pass of its own, so that expressions of df are evaluated before it and not within it.
    """
    reachable(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in fields.split(";")]
    base = df.drop(*names)
    schema = f"{base._jdf.schema().toDDL()}, {fields.replace(';', ',')}"

    def run(parts):
        for b in parts:
            yield b.assign(**f(b))[[*b.columns, *names]]

    out = base.mapInPandas(run, schema)
    return out.select(*[F.col(c.name).alias(c.name, metadata=c.metadata) if c.metadata else F.col(c.name) for c in base.schema], *names)


def summed_arrays(rows: DataFrame, key: str | None, column: str) -> dict:
    """By key (0 without one): the sums of an array column by position; partial sums are taken before the shuffle."""
    k = F.lit(0) if key is None else F.col(key)
    got = rows.select(k.alias("k"), F.posexplode(column).alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["k"], {})[r["at"]] = r["v"]
    return {g: np.array([v[i] for i in range(len(v))], float) for g, v in out.items()}
