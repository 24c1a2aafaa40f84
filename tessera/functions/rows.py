"""Row generators: each returns a Column that yields rows in a select, or works on a DataFrame where it must.

The outer forms are used, so a row for which nothing is generated still gives one row, of nulls.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import add, lit
from .scalar import _class, json_path


def _cap(array, n: int | None):
    return F.slice(array, 1, n) if n else array


add(
    "rows", "rows",
    GenerateSequence=lambda a, b, step=1: F.explode_outer(F.sequence(lit(a), lit(b), lit(step))),
    GenerateDateSequence=lambda a, b, step=1: F.explode_outer(F.sequence(a, b, F.make_dt_interval(lit(step)))),
    SplitColumnToRows=lambda chars, x, n=None: F.explode_outer(_cap(F.split(x, _class(chars)), n)),
    ColumnsToRows=lambda *names: F.inline_outer(F.array(*[F.struct(F.lit(n).alias("columnName"), F.col(n).alias("item")) for n in names])),
    XPathNodesToRows=lambda x, path, n=None: F.explode_outer(_cap(F.xpath(x, F.lit(path + "/text()")), n)),
    JsonElementsToRows=lambda x, path, n=None: F.explode_outer(_cap(F.from_json(F.get_json_object(x, json_path(path)) if path else x, "array<string>"), n)),
    JsonPivotElementToRows=lambda x, path, n=None: F.inline_outer(
        _cap(F.transform(F.map_entries(F.from_json(F.get_json_object(x, json_path(path)) if path else x, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))), n)
    ),
)
