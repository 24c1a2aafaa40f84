"""Streams of files, windows over event time, and continuous loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", archive: str | None = None, per_batch: int = 100, **options) -> DataFrame:
    """New files of a folder as a stream; files that are done are moved to `archive`. The first file limit of a batch also paces it."""
    r = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch).options(**options)
    if archive:
        r = r.options(cleanSource="archive", sourceArchiveDir=archive)
    return r.load(path)


def run(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Calls each(batch, number) on every batch; without `every`, all that is there now, and then stops. The checkpoint makes it resume."""
    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def tumbling(df: DataFrame, time: str, size: str, aggregates, keys=(), late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Aggregates of windows of event time, rows later than `late` being dropped in a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    if df.isStreaming:
        df = df.withWatermark(time, late)
    out = df.groupBy(w.alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def sessions(df: DataFrame, time: str, gap: str, aggregates, keys=(), late: str = "0 seconds") -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end"), "*").drop("window")


def distinct(df: DataFrame, keys, time: str, late: str) -> DataFrame:
    """First row of each key, remembered for as long as rows may be late."""
    if df.isStreaming:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))
