"""Structured Streaming: masked sinks, and event-time windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import scan
from ..operators.mask import mask


def source(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder or pattern."""
    schema = schema or spark.read.format(fmt).load(path).schema
    r = spark.readStream.format(fmt).schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    # a pattern for one name: a stream of a single file needs one
    return r.load(path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]")


def mask_stream(df: DataFrame, reports: dict, salt: str, seed: int = 42) -> DataFrame:
    """The batch masks on a stream; reports come from a scan of rows known beforehand."""
    return mask(df, salt=salt, reports=reports, strict=False, seed=seed)


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Runs over all that is there and stops; the sink is exactly-once through its checkpoint."""
    df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    df.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_masked(spark: SparkSession, path: str, out: str, checkpoint: str, salt: str, on_progress: Callable | None = None, fmt: str = "parquet") -> None:
    """Detects on the first batch, masks every batch with those reports, and appends; on_progress(batch, rows)."""
    state: dict = {}

    def one(batch: DataFrame, n: int) -> None:
        if "reports" not in state:
            state["reports"] = scan(batch)
        masked = mask(batch, salt=salt, reports=state["reports"], strict=False)
        masked.write.mode("append").parquet(out)
        if on_progress:
            on_progress(n, batch.count())

    each_batch(source(spark, path, fmt), one, checkpoint)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    return _windowed(df, F.window(ts, width), ts, keys, aggs, late)


def sliding(df: DataFrame, ts: str, width: str, slide: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    return _windowed(df, F.window(ts, width, slide), ts, keys, aggs, late)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    return _windowed(df, F.session_window(ts, gap), ts, keys, aggs, late)


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need timestamps with a zone; those without count as the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def _windowed(df, window, ts, keys, aggs, late) -> DataFrame:
    plain = dict(df.dtypes)[ts] == "timestamp_ntz"
    df = _event_time(df, ts)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    out = df.groupBy(window.alias("w"), *keys).agg(*aggs)
    kind = "timestamp_ntz" if plain else "timestamp"
    return out.select(F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), *[c for c in out.columns if c != "w"])


def dedup(df: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return _event_time(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
