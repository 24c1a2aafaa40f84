"""Grouping, analytics, distinct, sets, pivot, sort, limit, nodes and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import Filter, where
from .mapping import MapGroup, MapSort


def group(df: DataFrame, keys: Sequence[str | MapGroup], aggregates: Sequence, having: Sequence[Filter] = (), empty_row: bool = True) -> DataFrame:
    """One row a group. Without keys a single row, also for no input unless `empty_row` is False."""
    keys = [k.columns()[0] if isinstance(k, MapGroup) else F.col(k) for k in keys]
    aggs = [c for a in aggregates for c in ([a] if isinstance(a, Column) else a.columns())]
    if not keys and not empty_row:
        out = df.agg(*aggs, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")
    else:
        out = df.groupBy(*keys).agg(*aggs)
    return where(out, *having)


def generate(df: DataFrame, keys: Sequence[str], array: Column, target: str) -> DataFrame:
    """Grouping whose aggregate gives several rows a group."""
    return df.groupBy(*keys).agg(array.alias("__a")).select(*keys, F.explode_outer("__a").alias(target))


def analytic(df: DataFrame, keys: Sequence[str], aggregates: Sequence, order: Sequence[MapSort] = ()) -> DataFrame:
    """Every row, with the aggregates of its group."""
    w = Window.partitionBy(*keys)
    if order:
        w = w.orderBy(*[o.column() for o in order])
    return df.select("*", *[(a.column().over(w)).alias(a.target) for a in aggregates])


def group_node(df: DataFrame, keys: Sequence[str], target: str, sources: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*sources))).alias(target))


def ungroup(df: DataFrame, node: str, prefix: bool = True) -> DataFrame:
    """A row for each child, with the parent's columns; a parent without children gives one row with null children."""
    fields = [f.name for f in df.schema[node].dataType.elementType.fields]
    out = df.select(*[c for c in df.columns if c != node], F.explode_outer(node).alias("__c"))
    return out.select(*[c for c in df.columns if c != node], *[F.col("__c")[f].alias(f"{node}.{f}" if prefix else f) for f in fields])


def map_node(df: DataFrame, node: str, f) -> DataFrame:
    """A projection of the nested rows: f takes a struct Column and gives a Column."""
    return df.withColumn(node, F.transform(node, f))


def filter_node(df: DataFrame, node: str, f) -> DataFrame:
    return df.withColumn(node, F.filter(node, f))


def rows(df: DataFrame, generator: Column, *names: str) -> DataFrame:
    """A row for each value of a row generator."""
    return df.select("*", generator.alias(*names) if names else generator)


def pivot(df: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence, order: str) -> DataFrame:
    """A column for each label, with the last value by order."""
    return df.groupBy(*keys).pivot(label, list(labels)).agg(F.max_by(value, order))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "columnName", item: str = "item") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, item)


def sort(df: DataFrame, *keys: MapSort, tie: Sequence[str] = ()) -> DataFrame:
    """Nulls come first upward, last downward. `tie` makes the order total."""
    return df.orderBy(*[k.column() for k in keys], *tie)


def top(df: DataFrame, n: int, *keys: MapSort) -> DataFrame:
    return df.orderBy(*[k.column() for k in keys]).limit(n)


def top_each(df: DataFrame, keys: Sequence[str], n: int, *order: MapSort) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[o.column() for o in order])
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def concatenate(*dfs: DataFrame, order: Sequence[MapSort] = ()) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.orderBy(*[o.column() for o in order]) if order else out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def global_running(df: DataFrame, order: str, value: str, target: str, number: str | None = None, buckets: int | None = None) -> DataFrame:
    """Running sum (and row number) over a whole table in two passes: buckets by quantiles of a numeric order, sums of each, then offsets.

    The buckets are as many as asked for, or as the session's shuffle partitions, from 64 to 1,024, so the offsets are broadcast. Rows of equal order share a bucket and follow each other in no
    fixed way; `order` should be unique for a fixed result. Null orders come first.
    """
    buckets = buckets or max(64, min(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    parts = df.withColumn("__p", F.when(F.col(order).isNull(), -1).otherwise(at))
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({"__s": F.sum(value).over(w), "__n": F.row_number().over(w)})
    each = parts.groupBy("__p").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"), F.count("*").alias("__count"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offset = each.select("__p", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__so"), F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__no"))
    out = local.join(F.broadcast(offset), "__p").withColumn(target, F.coalesce("__s", F.lit(0)) + F.col("__so"))
    if number:
        out = out.withColumn(number, F.col("__n") + F.col("__no"))
    return out.drop("__p", "__s", "__n", "__so", "__no")
