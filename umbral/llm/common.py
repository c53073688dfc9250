"""Shared pieces: scratch tables, byte-level words and hashes, two-level ranks."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at a time; a cut falls on white space, so words stay whole.
CHUNK = 1 << 20


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; one of our own only where it is unset and Spark runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        top = "/tmp/umbral-checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/umbral/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a table that cut wrote, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(run):
    """run, a function over a task's batches, with the memory that its worker no longer needs given back when the task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    """Workers outlive their tasks; what allocators keep for later would add up beside the next stage's needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the words' offsets by row, and where a cut is allowed."""
    gap = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begin, finish = ~gap, ~gap
    begin[1:] &= gap[:-1] | first[1:]
    finish[:-1] &= gap[1:] | first[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets), gap | first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, may_cut: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a rolling polynomial by prefix sums. Spans don't cross a may_cut place but at its start."""
    out = np.empty(len(starts), np.uint64)
    at, n, w = 0, len(data), 0
    while at < n and w < len(starts):
        stop = min(n, at + CHUNK)
        while stop < n:
            ahead = np.flatnonzero(may_cut[stop : stop + CHUNK])
            if len(ahead):
                stop += int(ahead[0])
                break
            stop = min(n, stop + CHUNK)
        power = np.full(stop - at, STEP, np.uint64)
        if len(power):
            power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(BYTE[data[at:stop]] * power, out=total[1:])
        z = int(np.searchsorted(starts, stop))
        s, e = starts[w:z] - at, ends[w:z] - at
        inverse = np.full(stop - at, BACK, np.uint64)
        if len(inverse):
            inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        out[w:z] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * PLACE[-1]
        at, w = stop, z
    return mix(out)


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z in lower case) of whole texts, and their offsets by row."""
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    starts, ends, by_row, may_cut = word_bounds(data, offsets)
    return span_hashes(data, starts, ends, may_cut), by_row


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list, value=None, name: str = "__rank") -> DataFrame:
    """Adds the running total of value (default: rows) before each row, within keys, ordered by bucket, then order.

    No task sees a whole key: the totals of the buckets go through one window of a row per bucket,
    and rows are numbered only within (keys, bucket).
    """
    value = F.lit(1) if value is None else value
    df = df.withColumn("__value", value.cast("long"))
    sums = df.groupBy(*keys, bucket).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(F.col(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    base = base.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, bucket])], "__base")
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("__own", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, bucket])]
    out = joined.join(base, on, "left").withColumn(name, F.col("__base") + F.col("__own"))
    return out.drop("__base", "__own", "__value", *[f"__k{i}" for i in range(len(keys) + 1)])
