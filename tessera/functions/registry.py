"""Functions by category and name.

A builder takes Columns (and plain values for options) and returns a Column: scalar and condition functions a plain one, aggregates one for
`agg`, window functions one that already holds its window. Functions with several outputs return a struct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    category: str
    name: str
    kind: str  # map, condition, aggregate, window, series, rows, validate, profile, estimator
    build: Callable


REGISTRY: dict[str, Function] = {}


def add(category: str, kind: str, **builders: Callable) -> None:
    for name, f in builders.items():
        REGISTRY[f"{category}.{name}"] = Function(category, name, kind, f)


def get(name: str) -> Function:
    """By "category.Name", or by the name alone where only one category has it."""
    if name in REGISTRY:
        return REGISTRY[name]
    found = [f for f in REGISTRY.values() if f.name == name]
    if len(found) != 1:
        raise KeyError(f"{name}: {'no such function' if not found else 'several: ' + ', '.join(f'{f.category}.{f.name}' for f in found)}")
    return found[0]


def call(name: str, *args, on_null: str = "execute", on_error: str = "abend", **options):
    """The function's Column, with a policy for nulls (execute, null, ignore, abend) and for errors (abend, null).

    `ignore` gives null as well; the mapping transform drops such rows. Errors turn to null only for functions that can be
    tried, which are built with Spark's try_* forms.
    """
    f = get(name)
    out = f.build(*args, **options)
    cols = [a for a in args if isinstance(a, Column)]
    if on_null == "execute" or not cols:
        return out
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    if on_null == "abend":
        return F.when(missing, F.raise_error(F.lit(f"{name}: null argument"))).otherwise(out)
    return F.when(~missing, out)


def col(x) -> Column:
    """A column, given its name, or the Column or plain value itself."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def arrow_udf(kind: str, deterministic: bool = True):
    """A pandas UDF that is made when first called: its type is parsed by the session, which need not exist at import."""

    def wrap(f):
        def build(*args):
            from pyspark.sql.functions import pandas_udf

            u = pandas_udf(f, kind)
            return (u if deterministic else u.asNondeterministic())(*args)

        return build

    return wrap
