"""Joins with policies for missing and duplicate matches.

The result is the left columns, then the right ones under `alias__name` (or their own names without an alias). Predicates beyond
equality always apply before duplicates are judged. Null keys match nothing unless `null_safe`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import OPS
from .mapping import MapJoin, MapSort

HINTS = {"auto": None, "hash": "shuffle_hash", "sorted": "merge", "broadcast": "broadcast"}
_ID, _HIT = "__left_id", "__hit"


def _condition(on: Sequence[MapJoin], left: dict, right: dict, null_safe: bool) -> Column | None:
    out = None
    for m in on:
        a = left[m.left] if m.left is not None else F.lit(m.left_value)
        b = right[m.right] if m.right is not None else F.lit(m.right_value)
        c = a.eqNullSafe(b) if m.op == "=" and null_safe and m.left and m.right else OPS[m.op](a, b)
        out = c if out is None else out & c
    return out


def join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[MapJoin | str],
    *,
    missing: str = "null",
    duplicates: str = "all",
    order: Sequence[MapSort] | str | None = None,
    alias: str | None = None,
    strategy: str = "auto",
    condition=None,
    null_safe: bool = False,
    left_filter: Column | None = None,
    right_filter: Column | None = None,
    node: str | None = None,
) -> DataFrame:
    """Join right to left.

    missing     null keeps a left row without match, filter drops it, abend fails when the rows are read
    duplicates  all, first or last (by `order`, of each left row's matches), abend
    condition   function (left columns, right columns) -> Column, of dicts by name
    node        a name: matches become an array of structs, one output row for each left row
    """
    on = [MapJoin(m, m) if isinstance(m, str) else m for m in on]
    if strategy == "sorted" and not any(m.op == "=" and m.left and m.right for m in on):
        raise ValueError("a sorted join needs an equality")
    if left_filter is not None:
        left = left.filter(left_filter)
    if right_filter is not None:
        right = right.filter(right_filter)
    names = [f"{alias}__{c}" if alias else c for c in right.columns]
    hidden = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}") for c in right.columns])
    lc, rc = {c: F.col(f"`{c}`") for c in left.columns}, {c: F.col(f"`__right_{c}`") for c in right.columns}
    cond = _condition(on, lc, rc, null_safe)
    if condition is not None:
        cond = condition(lc, rc) if cond is None else cond & condition(lc, rc)
    hidden = hidden.withColumn(_HIT, F.lit(True))
    if HINTS[strategy]:
        hidden = hidden.hint(HINTS[strategy])
    how = "inner" if missing == "filter" else "left"
    if duplicates in ("first", "last") and order is None:
        raise ValueError("first and last need an order")
    keys = [f"__right_{m.right}" for m in on]
    if condition is None and keys and all(m.op == "=" and m.left and m.right for m in on):
        # By keys alone the right side can be folded before the join, so that a key's rows never meet each other's.
        if node is not None:
            folded = _folded_node(hidden, keys, right.columns, node)
            out = left.join(folded, cond, how)
            if missing != "abend":
                empty = F.array().cast(folded.schema[node].dataType)
                return out.select(*lc.values(), F.coalesce(F.col(f"`{node}`"), empty).alias(node))
        elif duplicates in ("first", "last") and (one := _folded_one(hidden, keys, order, duplicates == "last")) is not None:
            hidden, duplicates = one, "all"
    needs_id = duplicates in ("first", "last", "abend") or node is not None
    if needs_id:
        left = left.withColumn(_ID, F.monotonically_increasing_id())
    out = left.join(hidden, cond if cond is not None else F.lit(True), how)
    rcols = [F.col(f"`__right_{c}`") for c in right.columns]
    if missing == "abend":
        # The check stands in a column that is kept, else the optimizer would drop it.
        first = rcols[0]
        fail = F.raise_error(F.lit("a row has no match")).cast(right.schema[0].dataType)
        out = out.withColumn(f"__right_{right.columns[0]}", F.when(F.col(_HIT).isNull(), fail).otherwise(first))
    if node is not None:
        grouped = out.groupBy(_ID).agg(
            *[F.first(F.col(f"`{c}`")).alias(c) for c in lc],
            F.array_sort(F.collect_list(F.when(F.col(_HIT), F.struct(*[c.alias(n) for c, n in zip(rcols, right.columns, strict=True)])))).alias(node),
        )
        return grouped.drop(_ID)
    if duplicates in ("first", "last"):
        keys = [MapSort(order)] if isinstance(order, str) else list(order)
        sort = [MapSort(f"__right_{k.source}", k.descending != (duplicates == "last")).column() for k in keys]
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(_ID).orderBy(*sort))).filter("__n = 1").drop("__n")
    elif duplicates == "abend":
        n = F.count(F.lit(1)).over(Window.partitionBy(_ID))
        first = f"__right_{right.columns[0]}"
        fail = F.raise_error(F.lit("a row has several matches")).cast(right.schema[0].dataType)
        out = out.withColumn(first, F.when(n > 1, fail).otherwise(F.col(f"`{first}`")))
    return out.select(*[F.col(f"`{c}`") for c in lc], *[c.alias(n) for c, n in zip(rcols, names, strict=True)])


def _quoted(names) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _folded_node(hidden: DataFrame, keys: list[str], names: Sequence[str], node: str) -> DataFrame:
    """One row a key: its rows as an array."""
    row = F.struct(*[F.col(f"`__right_{n}`").alias(n) for n in names])
    return hidden.groupBy(*_quoted(dict.fromkeys(keys))).agg(F.array_sort(F.collect_list(row)).alias(node))


def _folded_one(hidden: DataFrame, keys: list[str], order, last: bool) -> DataFrame | None:
    """The first or last row of each key; None where no minimum gives it: orders that go both ways, columns without an order."""
    sorts = [MapSort(order)] if isinstance(order, str) else list(order)
    falling = {bool(k.descending) for k in sorts}
    if len(falling) > 1 or any("map<" in kind or "variant" in kind for _, kind in hidden.dtypes):
        return None
    pick = F.max if falling.pop() != last else F.min
    best = pick(F.struct(*[F.col(f"`__right_{k.source}`").alias(f"s{i}") for i, k in enumerate(sorts)], F.struct(*_quoted(hidden.columns)).alias("row")))
    return hidden.groupBy(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(dict.fromkeys(keys))]).agg(best.alias("__best")).select("__best.row.*")


def valid_dates(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range=("valid_from", "valid_to"), right_range=("valid_from", "valid_to"), alias: str = "right", missing: str = "null") -> DataFrame:
    """Rows of each key by the overlap of their validity, [from, to): both ranges become the overlap. A left row that overlaps nothing is
    kept as it is (missing='null') or dropped ('filter')."""
    (lf, lt), (rf, rt) = left_range, right_range
    out = join(left, right, list(keys), missing=missing, alias=alias, condition=lambda a, b: (b[rf] < a[lt]) & (b[rt] > a[lf]))
    a, b = F.col(f"{alias}__{rf}"), F.col(f"{alias}__{rt}")
    return out.withColumns({lf: F.greatest(lf, a), lt: F.least(lt, b)})


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, alias: str = "right", tolerance: str | None = None) -> DataFrame:
    """Each left row with the latest right row of its key that is not after it, in one shuffle: both sides in one window."""
    cols = [c for c in right.columns]
    pack = F.struct(*[F.col(f"`{c}`") for c in cols])
    a = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"), F.lit(None).cast(right.select(pack.alias("x")).schema["x"].dataType).alias("__r"))
    b = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), pack.alias("__r"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    if tolerance:
        out = out.withColumn("__m", F.when(F.col(f"__m.{right_time}") >= F.col("__t") - F.expr(f"INTERVAL {tolerance}"), F.col("__m")))
    return out.select("__l.*", *[F.col("__m")[c].alias(f"{alias}__{c}") for c in cols])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Left rows whose point lies in right's [low, high), by buckets of a given width: each range is filed under every bucket it touches."""
    a = left.withColumn("__b", F.floor(F.col(point) / width))
    b = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, ["__b", *keys]).filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[MapJoin | str], duplicates: str = "first", order=None, missing: str = "null", alias: str = "lookup") -> DataFrame:
    """Lookup in a table: the join by another name. For lookups in a service, see tessera.functions.files.service, which caches by task."""
    return join(left, right, on, missing=missing, duplicates=duplicates, order=order, alias=alias)


def semi(left, right, keys):
    return left.join(right, list(keys), "left_semi")


def anti(left, right, keys):
    return left.join(right, list(keys), "left_anti")


def outer(left, right, keys, how="full"):
    """Right and full joins on keys of the same name."""
    return left.join(right, list(keys), how)
