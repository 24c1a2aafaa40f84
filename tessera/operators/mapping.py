"""Column mappings: an ordered list from which each transform builds its projection, keys, aggregates or predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import call

AGGREGATES = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "count": F.count}


@dataclass(frozen=True)
class MapColumn:
    """Copy, rename, or a constant."""

    source: str | None = None
    target: str | None = None
    value: Any = None

    def columns(self) -> list[Column]:
        c = F.col(self.source) if self.source is not None else F.lit(self.value)
        return [c.alias(self.target or self.source)]

    uses = property(lambda self: [self.source] if self.source else [])


@dataclass(frozen=True)
class MapInputColumn:
    """A value given at run time."""

    target: str
    default: Any = None
    inputs: dict = field(default_factory=dict)

    def columns(self) -> list[Column]:
        return [F.lit(self.inputs.get(self.target, self.default)).alias(self.target)]

    uses = property(lambda self: [])


@dataclass(frozen=True)
class MapFunction:
    """A registered function, or any function of Columns, over columns and constants; a struct result may be spread to several targets."""

    function: str | Callable
    inputs: Sequence
    target: str | Sequence[str]
    options: dict = field(default_factory=dict)
    on_null: str = "execute"
    negate: bool = False

    def column(self) -> Column:
        args = [F.col(a) if isinstance(a, str) else a for a in self.inputs]
        out = call(self.function, *args, on_null=self.on_null, **self.options) if isinstance(self.function, str) else self.function(*args, **self.options)
        return ~out if self.negate else out

    def columns(self) -> list[Column]:
        if isinstance(self.target, str):
            return [self.column().alias(self.target)]
        c = self.column()
        return [c.getField(i) if isinstance(i, str) else c[i] for i in self.target]

    uses = property(lambda self: [a for a in self.inputs if isinstance(a, str)])


@dataclass(frozen=True)
class MapGroup:
    source: str
    target: str | None = None

    def columns(self) -> list[Column]:
        return [F.col(self.source).alias(self.target or self.source)]

    uses = property(lambda self: [self.source])


@dataclass(frozen=True)
class MapAggregate:
    """sum, average, min, max, count (of non-null values), first or last (by an order)."""

    source: str
    target: str
    aggregate: str = "sum"
    order: str | None = None

    def column(self) -> Column:
        kind = self.aggregate.lower()
        if kind in ("first", "last"):
            if self.order is None:
                raise ValueError(f"{kind} needs an order")
            return (F.min_by if kind == "first" else F.max_by)(self.source, self.order)
        return AGGREGATES[kind](self.source)

    def columns(self) -> list[Column]:
        return [self.column().alias(self.target)]

    uses = property(lambda self: [self.source])


@dataclass(frozen=True)
class MapGroupNode:
    """The group's rows as an array of structs."""

    target: str
    sources: Sequence[str]

    def column(self) -> Column:
        return F.array_sort(F.collect_list(F.struct(*self.sources)))

    def columns(self) -> list[Column]:
        return [self.column().alias(self.target)]

    uses = property(lambda self: list(self.sources))


@dataclass(frozen=True)
class MapSort:
    source: str
    descending: bool = False

    def column(self) -> Column:
        return F.desc_nulls_last(self.source) if self.descending else F.asc_nulls_first(self.source)


@dataclass(frozen=True)
class MapJoin:
    """left op right; either side a column name or, as `value`, a constant."""

    left: str | None
    right: str | None
    op: str = "="
    left_value: Any = None
    right_value: Any = None


def project(df: DataFrame, mappings: Sequence, pass_through: bool = False, ignore_null: Sequence[str] = ()) -> DataFrame:
    """The mapped columns, after the columns no mapping uses if they pass through. Rows with nulls in `ignore_null` are dropped."""
    used = {u for m in mappings for u in m.uses}
    made = [c for m in mappings for c in m.columns()]
    names = set(df.select(*made).columns) if made else set()
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in names] if pass_through else []
    out = df.select(*rest, *made)
    return out.dropna(subset=list(ignore_null)) if ignore_null else out
