"""What a plan does: for tests of shuffles, pushed filters and columns read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"\bExchange (?!.*Broadcast)", text(df)))


def broadcasts(df: DataFrame) -> int:
    return text(df).count("BroadcastExchange")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\](?:,|$)", text(df), re.M)


def read_columns(df: DataFrame) -> list[str]:
    return [re.sub(r":[^,>]+", "", x) for x in re.findall(r"ReadSchema: struct<(.*?)>(?:$|\n|,)", text(df), re.M)]


def uses_python(df: DataFrame) -> bool:
    return bool(re.search(r"Python|Pandas|Arrow", text(df)))
