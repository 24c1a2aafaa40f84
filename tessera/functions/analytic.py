"""Aggregates, row-cache functions over windows, series functions.

Functions that depend on the order of rows take that order as a Column or name. Those over a whole table (no group) run over a window without
partition, which is one task; `global_running` in tessera.operators.window does the same in two passes for large tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import add, col, lit

_FIRST = Window.unboundedPreceding


def window(group=(), order=()):
    group = [group] if not isinstance(group, (list, tuple)) else group
    order = [order] if not isinstance(order, (list, tuple)) else order
    w = Window.partitionBy(*group)
    return w.orderBy(*order) if order else w


def concat_ordered(x, separator=",", order=None):
    if order is None:
        return F.array_join(F.array_sort(F.collect_list(x)), separator)
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("v")))), lambda s: s["v"]), separator)


add(
    "aggregate", "aggregate",
    Sum=lambda x: F.coalesce(F.sum(x), F.lit(0)), Average=lambda x, count_nulls=False: F.sum(x) / F.count(F.lit(1)) if count_nulls else F.avg(x), Min=F.min, Max=F.max,
    First=lambda x, order: F.min_by(x, order), Last=lambda x, order: F.max_by(x, order), Count=lambda *_: F.count(F.lit(1)), CountTrue=lambda c: F.count_if(c), CountFalse=lambda c: F.count_if(~c),
    CountEqual=lambda *x: F.count_if(reduce(lambda a, b: a & b, [x[0].eqNullSafe(y) for y in x[1:]])),
    CountDistinct=lambda x: F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0)), ConcatAgg=concat_ordered,
    CreateArray=lambda x, sort=True: F.array_sort(F.collect_list(x)) if sort else F.collect_list(x), Median=F.median, StdDev=lambda x: F.coalesce(F.stddev_pop(x), F.lit(0.0)),
    Variance=lambda x: F.coalesce(F.var_pop(x), F.lit(0.0)), FirstWhen=lambda c, x, order: F.min_by(x, F.when(c, order)), LastWhen=lambda c, x, order: F.max_by(x, F.when(c, order)),
    PivotToColumns=lambda label, x, order, labels: F.struct(*[F.max_by(x, F.when(label == v, order)).alias(str(v)) for v in labels]),
)

# --- analytic: every row kept ---------------------------------------------------------------------------------------


def percent_total(x, group=(), percent=False):
    total = F.sum(x).over(window(group))
    share = F.when(total == 0, 0.0).otherwise(x / F.when(total != 0, total))
    return share * 100 if percent else share


def moving(agg):
    """Rows from pre - 1 before to post after: pre counts the current row."""
    return lambda x, order, pre, post=0, group=(): agg(x).over(window(group, order).rowsBetween(-(pre - 1), post))


add(
    "analytic", "window",
    PercentTotal=percent_total, Rank=lambda *values, group=(), ascending=True: F.rank().over(window(group, [v.asc() if ascending else v.desc() for v in values])),
    MovingAverage=moving(lambda x: F.avg(F.coalesce(x, F.lit(0)))), MovingSum=moving(F.sum),
)

# --- row cache ------------------------------------------------------------------------------------------------------


def running(agg):
    """Over the last n rows, or all rows so far for n = 0."""
    return lambda x, order, n=0, group=(): agg(x).over(window(group, order).rowsBetween(-(n - 1) if n else _FIRST, 0))


def filled(x, order, group=()):
    return F.last(x, ignorenulls=True).over(window(group, order).rowsBetween(_FIRST, 0))


def change(x, order, n=1, group=()):
    return F.coalesce(x - F.lag(x, n).over(window(group, order)), F.lit(0))


def ratio(x, order, n=1, default=0, group=()):
    before = F.lag(x, n).over(window(group, order))
    return F.when(before.isNull() | (before == 0), lit(default)).otherwise(x / F.when(before != 0, before))


def _grouped(f):
    return lambda *a, group, **k: f(*a, group=group, **k)


_lag = lambda x, order, n=1, group=(): F.lag(x, n).over(window(group, order))
_number = lambda order, group=(): F.row_number().over(window(group, order))
_sum, _avg = running(F.sum), running(F.avg)
add(
    "row", "window",
    PreviousRow=_lag, PreviousGroupRow=_grouped(_lag), PreviousRowIfNull=filled, PreviousGroupRowIfNull=_grouped(filled), RowNumber=_number, GroupRowNumber=_grouped(_number),
    RunningSum=_sum, RunningGroupSum=_grouped(_sum), RunningAverage=_avg, RunningGroupAverage=_grouped(_avg), PreviousRowChange=change, PreviousGroupRowChange=_grouped(change),
    PreviousRowRatio=ratio, PreviousGroupRowRatio=_grouped(ratio),
)

# --- series: one row for each point; see tessera.operators.series for the folding of repeated points --------------------


def since(compare, frame: int | None = None):
    """The nearest earlier point whose value beats this one's: struct series, value; null where none does."""

    def build(series, x, group=()):
        w = window(group, series).rowsBetween(-frame if frame else _FIRST, -1)
        past = F.collect_list(F.struct(col(series).alias("series"), x.alias("value"))).over(w)
        better = F.filter(past, lambda p: compare(p["value"], x))
        return F.when(F.size(better) > 0, F.element_at(better, -1))

    return build


add(
    "series", "series",
    MovingSeriesAverage=lambda series, x, pre, post=0, group=(): F.avg(x).over(window(group, series).rowsBetween(-pre, post)),
    HighestSince=since(lambda a, b: a > b), LowestSince=since(lambda a, b: a < b),
    PreviousSeriesValue=lambda series, x, n=1, group=(): F.lag(F.struct(col(series).alias("series"), x.alias("value")), n).over(window(group, series)),
    PreviousSeriesValueNull=lambda series, x, group=(): F.last(F.when(x.isNotNull(), F.struct(col(series).alias("series"), x.alias("value"))), ignorenulls=True).over(window(group, series).rowsBetween(_FIRST, -1)),
)
