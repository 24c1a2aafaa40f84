"""Validation and profiling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import call
from tessera.functions.profiles import PROFILES

PASS, CLEAN, REJECT_CLEAN, REJECT, DISCARD, ABEND = 1, 2, 3, 4, 5, 6
STATUS = {PASS: "passed", CLEAN: "cleaned", REJECT_CLEAN: "rejected-cleaned", REJECT: "rejected", DISCARD: "discarded"}


@dataclass(frozen=True)
class Rule:
    """A validation function over a column (struct ok, cleaned) or a condition (boolean), and what happens where it fails."""

    column: str
    function: str | object
    arguments: Sequence = ()
    action: int = REJECT
    options: dict = field(default_factory=dict)
    name: str | None = None


def type_rules(df: DataFrame, target: T.StructType) -> tuple[DataFrame, list[tuple[Column, str]]]:
    """Casts columns to the target's types where they can be; failures, too long texts and forbidden nulls as (failed, reason)."""
    failures = []
    for f in target.fields:
        if f.name not in df.columns:
            continue
        x = F.col(f"`{f.name}`")
        if df.schema[f.name].dataType != f.dataType:
            new = x.try_cast(f.dataType)
            failures.append((x.isNotNull() & new.isNull(), f"{f.name} is not a {f.dataType.simpleString()}"))
        if (most := f.metadata.get("max_length")) is not None:
            failures.append((F.length(x.cast("string")) > most, f"{f.name} is longer than {most}"))
        if not f.nullable:
            failures.append((x.isNull(), f"{f.name} is null"))
    return df, failures


def validate(df: DataFrame, rules: Sequence[Rule] = (), target: T.StructType | None = None) -> DataFrame:
    """Adds validation_status, reject_reason, operation ('C', or 'R' for rejects).

    The highest action among failing rules decides: CLEAN puts cleaned values in, REJECT_CLEAN gives two rows (cleaned, and the original as a
    reject), DISCARD drops the row, ABEND fails when rows are read. Type failures reject.
    """
    cols = df.columns
    _, typed = type_rules(df, target) if target is not None else (df, [])
    action, reasons, cleaned = F.lit(PASS), [], {}
    for r in rules:
        x = F.col(f"`{r.column}`")
        out = call(r.function, x, *r.arguments, **r.options) if isinstance(r.function, str) else r.function(x, *r.arguments)
        boolean = isinstance(df.select(out.alias("x")).schema["x"].dataType, T.BooleanType)
        failed = ~F.coalesce(out if boolean else out["ok"], F.lit(False))
        action = F.greatest(action, F.when(failed, r.action).otherwise(PASS))
        name = r.name or (r.function if isinstance(r.function, str) else getattr(r.function, "__name__", "rule"))
        reasons.append(F.when(failed, F.lit(f"{r.column}: {name} failed")))
        if not boolean and r.action in (CLEAN, REJECT_CLEAN):
            cleaned[r.column] = F.when(failed, out["cleaned"]).otherwise(cleaned.get(r.column, x))
    for failed, reason in typed:
        failed = F.coalesce(failed, F.lit(False))
        action = F.greatest(action, F.when(failed, REJECT).otherwise(PASS))
        reasons.append(F.when(failed, F.lit(reason)))
    reason = F.nullif(F.concat_ws("; ", *reasons), F.lit("")) if reasons else F.lit(None).cast("string")
    work = df.withColumn("__action", action).withColumn("__reason", reason)
    work = work.filter(F.col("__action") != DISCARD)
    if any(r.action == ABEND for r in rules):
        work = work.withColumn("__action", F.when(F.col("__action") == ABEND, F.raise_error(F.concat(F.lit("validation failed: "), "__reason")).cast("int")).otherwise(F.col("__action")))

    def version(values: dict, status: Column, operation: str) -> Column:
        return F.struct(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in cols], status.alias("validation_status"), F.col("__reason").alias("reject_reason"), F.lit(operation).alias("operation"))

    a = F.col("__action")
    status = F.element_at(F.create_map(*[F.lit(v) for k, s in STATUS.items() for v in (k, s)]), a)
    good = version(cleaned, F.when(a == REJECT_CLEAN, STATUS[CLEAN]).otherwise(status), "C")
    same = version({}, status, "C")
    bad = version({}, status, "R")
    out = F.when(a == PASS, F.array(same)).when(a == CLEAN, F.array(good)).when(a == REJECT_CLEAN, F.array(good, bad)).otherwise(F.array(bad))
    return work.select(F.explode(out).alias("__row")).select("__row.*")


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("operation = 'C'")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter("operation = 'R'")


def profile(df: DataFrame, functions: dict[str, Sequence[str]] | None = None, detail: bool = True, audit_key: int = 0, top: int | None = None) -> DataFrame:
    """audit_key, function, column, is_summary, value, count: one scan for all summaries, one more for the values' counts.

    functions: by name, the columns; all of them over all columns without it. top: keep the most frequent values only.
    """
    functions = functions or {n: df.columns for n in PROFILES}
    pairs = [(f, c) for f, cs in functions.items() for c in cs]
    one = df.agg(*[PROFILES[f][0](F.col(f"`{c}`")).cast("string").alias(f"v{i}") for i, (f, c) in enumerate(pairs)], F.count(F.lit(1)).alias("n"))
    lines = F.array(*[F.struct(F.lit(f).alias("function"), F.lit(c).alias("column"), F.lit(True).alias("is_summary"), F.col(f"v{i}").alias("value"), F.col("n").alias("count")) for i, (f, c) in enumerate(pairs)])
    out = one.select(F.inline(lines))
    wide = [(f, c) for f, c in pairs if PROFILES[f][1] is not None]
    if detail and wide:
        each = F.array(*[F.struct(F.lit(f).alias("function"), F.lit(c).alias("column"), PROFILES[f][1](F.col(f"`{c}`")).alias("value")) for f, c in wide])
        counts = df.select(F.inline(each)).filter("value IS NOT NULL").groupBy("function", "column", "value").agg(F.count("*").alias("count"))
        if top is not None:
            from pyspark.sql import Window

            w = Window.partitionBy("function", "column").orderBy(F.desc("count"), "value")
            counts = counts.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= top).drop("__r")
        out = out.unionByName(counts.withColumn("is_summary", F.lit(False)))
    return out.select(F.lit(audit_key).alias("audit_key"), "function", "column", "is_summary", "value", "count")
