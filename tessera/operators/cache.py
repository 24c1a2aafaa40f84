"""Keeping results: in memory, on executors' disks, or as a table that later steps push filters into."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def keep(df: DataFrame, method: str = "demand") -> DataFrame:
    """none; demand: kept as it is read; preload: read at once; disk: on disk only."""
    if method == "none":
        return df
    df = df.persist(StorageLevel.DISK_ONLY if method == "disk" else StorageLevel.MEMORY_AND_DISK)
    if method == "preload":
        df.count()
    return df


def store(df: DataFrame, path: str, sort: tuple = (), partition: tuple = ()) -> DataFrame:
    """Spools rows to Parquet, sorted within files by the keys that later steps filter or join by, and reads them again."""
    out = df.sortWithinPartitions(*sort) if sort else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return df.sparkSession.read.parquet(path)
