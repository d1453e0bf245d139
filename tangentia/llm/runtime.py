"""Session helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; longer single texts pass alone.
SLICE_BYTES = 2 << 20
#: Bits of a sieve, whatever the number of keys; 8 MB before compression.
SIEVE_BITS = 1 << 26


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of text small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark


def _driver_rested(spark: SparkSession) -> None:
    """Collect the driver's garbage, Python's and the JVM's, and give freed native memory back, where the JVM can."""
    gc.collect()
    _released()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Exception):
        # Called by reflection, as the bean server's own class isn't open to others.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        told = gateway.new_array(jvm.java.lang.Object, 4)
        told[0], told[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), told)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, which outlives lost executors."""
    sc = df.sparkSession.sparkContext
    # What earlier cuts have made unreachable still has shuffle files, until the driver collects its garbage.
    _driver_rested(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which later passes read by column; compressed, unlike a checkpoint. It goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def gone() -> None:
        with contextlib.suppress(Exception):
            files.delete(place, True)

    atexit.register(gone)
    return spark.read.parquet(path)


def rested(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage, and so return heap that earlier stages have taken, which Python workers then can use."""
    _driver_rested(spark)
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session without other machines may leave it unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tangentia-checkpoint-")


def _released() -> None:
    """Give freed memory back to the system, Arrow's and the C library's; workers are many and long-lived, and so is the driver."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `most` bytes of text, or one row."""
    for batch in batches:
        _released()
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


def sieve_table(keys: DataFrame, place: Column) -> Broadcast:
    """A broadcast table of SIEVE_BITS bits, compressed, with those at the keys' places set; see sifted()."""
    at = keys.select(F.pmod(place, F.lit(SIEVE_BITS)).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("bits"))
    got = words.toArrow()
    table = np.zeros(SIEVE_BITS // 32, np.uint32)
    for part in got.to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint32)
    del got
    sent = keys.sparkSession.sparkContext.broadcast(zlib.compress(table, 1))
    del table
    _released()
    return sent


def unpacked(sent: Broadcast) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent.value), np.uint32)


def sifted(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def sieve(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A function of a column: false only for values that are not in keys[column].

    One bit per key in a table of a fixed size, which is all that executors get; the more
    keys, the more other values pass, and what passes must still be joined. It spares most rows the
    shuffle to a join that few of them meet.
    """
    sent = sieve_table(keys, F.xxhash64(column))

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = unpacked(sent)
        for at in batches:
            yield pd.Series(sifted(own, at.to_numpy()))

    return lambda c: passes(F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)))


def without(docs: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows of docs whose column isn't in gone (one column of that name, not null); only rows that may go are shuffled."""
    gone = saved(gone.select(column).distinct())
    meets = F.coalesce(sieve(gone, column)(F.col(column)), F.lit(False)) & F.col(column).isNotNull()
    return docs.filter(~meets).unionAll(docs.filter(meets).join(gone, column, "left_anti").select(docs.columns))
