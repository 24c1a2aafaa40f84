"""Filters, JSON filters, and the query transform."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import MapAggregate, MapSort

OPS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a.isin(*b), "not in": lambda a, b: ~a.isin(*b), "null": lambda a, _: a.isNull(), "not null": lambda a, _: a.isNotNull(), "like": lambda a, b: a.like(b),
}
NAMES = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "in": "in", "notin": "not in", "null": "null", "notnull": "not null", "like": "like", "isin": "in"}


@dataclass(frozen=True)
class Filter:
    """column op (another column or a value); joined to the filters before it by `and` or `or`."""

    column: str
    op: str = "="
    value: Any = None
    other: str | None = None
    join: str = "and"
    allow_null: bool = False

    def predicate(self) -> Column:
        a = F.col(self.column)
        out = OPS[self.op](a, F.col(self.other) if self.other else self.value)
        return a.isNull() | out if self.allow_null else out


def predicate(filters: Sequence[Filter]) -> Column | None:
    """Strictly from left to right: `a or b and c` is `(a or b) and c`."""
    out = None
    for f in filters:
        p = f.predicate()
        out = p if out is None else (out & p) if f.join == "and" else (out | p)
    return out


def where(df: DataFrame, *filters: Filter | Column) -> DataFrame:
    """Rows for which all Columns, and the chain of Filters, hold."""
    chain = predicate([f for f in filters if isinstance(f, Filter)])
    for c in [*([chain] if chain is not None else []), *[f for f in filters if not isinstance(f, Filter)]]:
        df = df.filter(c)
    return df


def from_json(spec: dict) -> list[Filter]:
    """{"col": value}, {"col": {"lt": value, ...}} or {"col": [values]}; all must hold."""
    out = []
    for name, v in spec.items():
        if isinstance(v, dict):
            out += [Filter(name, NAMES[k.lower()], x) for k, x in v.items()]
        elif isinstance(v, list):
            out.append(Filter(name, "in", v))
        else:
            out.append(Filter(name, "null") if v is None else Filter(name, "=", v))
    return out


def bind(filters: Sequence[Filter], parameters: dict) -> list[Filter]:
    """{name} in a filter's value, or a whole value {name}, replaced by the parameter of that name."""

    def one(v):
        if isinstance(v, str):
            whole = re.fullmatch(r"\{(\w+)\}", v)
            return parameters.get(whole[1], v) if whole else re.sub(r"\{(\w+)\}", lambda m: str(parameters.get(m[1], m[0])), v)
        return [one(x) for x in v] if isinstance(v, list) else v

    return [Filter(f.column, f.op, one(f.value), f.other, f.join, f.allow_null) for f in filters]


@dataclass
class SelectQuery:
    """filters, then groups and aggregates, then having, sorts, rows (-1: all), columns."""

    columns: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    aggregates: list[MapAggregate] = field(default_factory=list)
    having: list[Filter] = field(default_factory=list)
    sorts: list[MapSort] = field(default_factory=list)
    rows: int = -1

    def run(self, df: DataFrame, parameters: dict | None = None) -> DataFrame:
        df = where(df, *bind(self.filters, parameters or {}))
        if self.groups or self.aggregates:
            df = df.groupBy(*self.groups).agg(*[c for a in self.aggregates for c in a.columns()]) if self.aggregates else df.select(*self.groups).distinct()
            df = where(df, *bind(self.having, parameters or {}))
        if self.sorts:
            df = df.orderBy(*[s.column() for s in self.sorts])
        if self.rows >= 0:
            df = df.limit(self.rows)
        return df.select(*self.columns) if self.columns else df


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    return df.limit(rows)


def row_count(df: DataFrame) -> int:
    return df.count()


def max_value(df: DataFrame, column: str):
    return df.agg(F.max(column)).first()[0]


def column_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
