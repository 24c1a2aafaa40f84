"""Profile functions: a summary aggregate, and a class of each value whose counts are the detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import add


def best_type(x):
    s = F.trim(x.cast("string"))
    return (
        F.when(x.isNull(), None).when(s.try_cast("bigint").isNotNull(), "Int64").when(s.try_cast("double").isNotNull(), "Double")
        .when(F.try_to_timestamp(s).isNotNull(), "DateTime").otherwise("String")
    )


def share(c):
    return F.format_string("%.2f %%", 100.0 * F.count_if(F.coalesce(c, F.lit(False))) / F.count(F.lit(1)))


def shape(x):
    s = x.cast("string")
    return F.when(F.length(s) < 50, F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")).when(s.isNotNull(), "Too long")


def distinct(x):
    n = F.count_distinct(F.coalesce(x.cast("string"), F.lit("Null")))
    return F.when(n == F.count(F.lit(1)), "Unique").otherwise(n.cast("string"))


#: name: (summary, class of a value or None)
PROFILES = {
    "BestDataType": (lambda x: F.mode(best_type(x)), best_type),
    "Nulls": (lambda x: share(x.isNull()), None),
    "Blanks": (lambda x: share(F.coalesce(x.cast("string"), F.lit("")) == ""), None),
    "Zeros": (lambda x: share(x.cast("string").try_cast("double") == 0), None),
    "MaxLength": (lambda x: F.max(F.length(x.cast("string"))).cast("string"), lambda x: F.length(x.cast("string")).cast("string")),
    "MaxValue": (lambda x: F.max(x.cast("string").try_cast("double")).cast("string"), None),
    "DistinctValues": (distinct, lambda x: F.coalesce(x.cast("string"), F.lit("Null"))),
    "Patterns": (lambda x: F.count_distinct(shape(x)).cast("string"), shape),
}
add("profile", "profile", **{k: s for k, (s, _) in PROFILES.items()})
