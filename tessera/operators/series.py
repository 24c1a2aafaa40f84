"""Time and number series: truncate to a grain, fold, fill gaps, clip, project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mapping import MapAggregate

GRAINS = ("second", "minute", "hour", "day", "week", "weekday", "month", "year", "number")
MOST = 10_000


def truncate(x, grain: str, step: int = 1):
    """The start of the grain that holds x: weeks start on Sunday; weekday moves Saturday and Sunday to the Friday before; numbers round half to even."""
    if grain == "number":
        base = F.bround(x, 0)
        return base if step == 1 else F.floor(base / step) * step
    if grain == "week":
        day = F.date_trunc("day", x)
        return day - F.make_dt_interval(F.dayofweek(x) - 1)
    if grain == "weekday":
        day = F.date_trunc("day", x)
        return day - F.make_dt_interval(F.when(F.dayofweek(x) == 7, 1).when(F.dayofweek(x) == 1, 2).otherwise(0))
    if step == 1:
        return F.date_trunc(grain, x)
    if grain in ("month", "year"):
        months = (F.year(x) * 12 + F.month(x) - 1) if grain == "month" else F.year(x)
        floor = F.floor(months / step) * step
        return F.make_timestamp_ntz((F.floor(floor / 12) if grain == "month" else floor).cast("int"), (floor % 12 + 1).cast("int") if grain == "month" else F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[grain] * step
    return F.timestamp_seconds(F.floor(F.unix_timestamp(x.cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")


def _interval(grain: str, n):
    n = F.lit(n) if isinstance(n, int) else n
    zero = F.lit(0)
    if grain in ("month", "year"):
        return F.make_ym_interval(*((n, zero) if grain == "year" else (zero, n)))
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "weekday": 86400}[grain]
    return F.make_dt_interval(zero, zero, zero, n * unit)


def points(low, high, grain: str, step: int):
    """All points from low to high."""
    if grain == "number":
        n = F.greatest(F.lit(0), F.floor((high - low) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: low + i * step)
    seq = F.sequence(low, high, _interval(grain, 1 if grain == "weekday" else step))
    return F.filter(seq, lambda d: ~F.dayofweek(d).isin(1, 7)) if grain == "weekday" else seq


def series(df: DataFrame, column: str, grain: str = "day", step: int = 1, aggregates: Sequence[MapAggregate] = (), group: Sequence[str] = (), fill: bool = True,
           start=None, finish=None, project: int = 0, target: str | None = None, most: int = MOST) -> DataFrame:
    """One row a group and point: aggregates of the rows there; filler rows have 0 for sums, averages and counts, else null.

    start, finish: bounds that rows outside of are dropped for, and to which filling reaches. project: points to add after the last, marked
    is_forecast. More than `most` points in a group raise an error when rows are read.
    """
    target = target or column
    group = list(group)
    x = F.col(column)
    at = truncate(x if grain == "number" else x.cast("timestamp_ntz"), grain, step)
    lo = None if start is None else truncate(F.lit(start) if grain == "number" else F.lit(start).cast("timestamp_ntz"), grain, step)
    hi = None if finish is None else truncate(F.lit(finish) if grain == "number" else F.lit(finish).cast("timestamp_ntz"), grain, step)
    rows = df.withColumn("__at", at).filter(F.col("__at").isNotNull())
    if lo is not None:
        rows = rows.filter(F.col("__at") >= lo)
    if hi is not None:
        rows = rows.filter(F.col("__at") <= hi)
    folded = rows.groupBy(*group, "__at").agg(*[c for a in aggregates for c in a.columns()])
    if not fill and not project:
        return folded.withColumnRenamed("__at", target)
    edge = folded.groupBy(*group).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
    low, high = lo if lo is not None else F.col("__lo"), hi if hi is not None else F.col("__hi")
    last = high
    if project:
        last = high + project * step if grain == "number" else high + _interval(grain, project * step + (2 * (project // 5 + 1) if grain == "weekday" else 0))
    seq = points(low, last, grain, step)
    if project and grain == "weekday":
        seq = F.concat(F.filter(seq, lambda d: d <= high), F.slice(F.filter(seq, lambda d: d > high), 1, project))
    seq = F.when(F.size(seq) > most, F.raise_error(F.lit(f"a series has more than {most} points")).cast("array<double>" if grain == "number" else "array<timestamp_ntz>")).otherwise(seq)
    calendar = edge.select(*group, F.explode(seq).alias("__at"), high.alias("__end"))
    key = [*[F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group], F.col("a.__at") == F.col("b.__at")]
    cond = key[0]
    for k in key[1:]:
        cond = cond & k
    joined = calendar.alias("a").join(folded.alias("b"), cond, "left")
    out = [F.col(f"a.{g}").alias(g) for g in group] + [F.col("a.__at").alias(target)]
    for a in aggregates:
        v = F.col(f"b.{a.target}")
        out.append((F.coalesce(v, F.lit(0)) if a.aggregate.lower() in ("sum", "average", "count") else v).alias(a.target))
    if project:
        out.append((F.col("a.__at") > F.col("a.__end")).alias("is_forecast"))
    return joined.select(*out)


def moving_average(df: DataFrame, column: str, value: str, pre: int, post: int = 0, group: Sequence[str] = (), target: str = "moving_average") -> DataFrame:
    """Over the pre points before, the point, and the post after it."""
    w = Window.partitionBy(*group).orderBy(column).rowsBetween(-pre, post)
    return df.withColumn(target, F.avg(value).over(w))
