"""Change data capture: compares a source with a target and gives rows with their operation.

operation is C (create), U (update), D (delete), T (truncate) or R (reject, from validation). Strategies: reload, append, append_update,
append_update_delete, append_update_preserve, append_update_delete_preserve; the preserving ones close the old row and open a new one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("reload", "append", "append_update", "append_update_delete", "append_update_preserve", "append_update_delete_preserve")
END = "2099-12-31 23:59:59"
BEGIN = "1900-01-01"


@dataclass(frozen=True)
class Columns:
    """Names of the audit columns in the target; None leaves one out."""

    surrogate: str | None = "surrogate_key"
    valid_from: str | None = "valid_from"
    valid_to: str | None = "valid_to"
    current: str | None = "is_current"
    version: str | None = "version"
    created: str | None = "create_date"
    updated: str | None = "update_date"


def _named(df: DataFrame, names) -> list[str]:
    return [n for n in names if n is not None]


def delta(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str] | None = None,
    strategy: str = "append_update",
    now: str = "1970-01-01 00:00:00",
    columns: Columns = Columns(),
    untracked: Sequence[str] = (),
    source_valid_from: str | None = None,
    first_key: int | None = None,
    default_row: bool = False,
    reason: bool = True,
) -> DataFrame:
    """Rows to apply to the target: the target's columns, operation, update_reason.

    tracked            columns whose change matters (null-safe); by default all but the keys and `untracked`
    now                time of the run, written to audit columns
    source_valid_from  a source column that says since when a row holds; of rows that repeat a key the last wins, or all become history
                       when preserving; rows older than the target's current row are left alone
    default_row        adds a row with surrogate key 0, once, if the target has none
    """
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    c = columns
    keys, untracked = list(keys), list(untracked)
    preserve, delete = strategy.endswith("preserve"), "delete" in strategy
    tracked = list(tracked) if tracked is not None else [x for x in source.columns if x not in keys and x not in untracked and x != source_valid_from]
    payload = [*keys, *tracked, *untracked]
    stamp = F.lit(now).cast("timestamp_ntz")
    start = F.col(source_valid_from).cast("timestamp_ntz") if source_valid_from else stamp
    src = source.select(*payload, start.alias("__from"))
    w = Window.partitionBy(*keys).orderBy("__from", *tracked, *untracked)
    if strategy not in ("reload", "append"):
        n = F.count("*").over(Window.partitionBy(*keys))
        src = src.withColumn("__n", F.row_number().over(w)).withColumn("__last", F.col("__n") == n)
        if not preserve or source_valid_from is None:
            src = src.filter("__last").withColumn("__n", F.lit(1))
        src = src.withColumn("__next", F.lead("__from").over(Window.partitionBy(*keys).orderBy("__n")))
    else:
        src = src.withColumns({"__n": F.lit(1), "__last": F.lit(True), "__next": F.lit(None).cast("timestamp_ntz")})

    if strategy in ("reload", "append"):
        creates = src.withColumns({"__op": F.lit("C"), "__version": F.lit(1), "__why": F.lit(None).cast("string")})
        closes = None
    else:
        tgt = target.filter(F.col(c.current)) if c.current and c.current in target.columns else target
        keep = [x for x in payload if x in target.columns]
        extra = _named(tgt, (c.surrogate, c.valid_from, c.valid_to, c.version, c.created))
        extra = [x for x in extra if x in target.columns]
        tgt = tgt.select(*[F.col(x).alias(f"__t_{x}") for x in dict.fromkeys([*keep, *extra])], F.lit(True).alias("__in"))
        cond = None
        for k in keys:
            e = F.col(k).eqNullSafe(F.col(f"__t_{k}"))
            cond = e if cond is None else cond & e
        both = src.join(tgt, cond, "full_outer" if delete else "left")
        differs = F.lit(False)
        reasons = []
        for x in tracked:
            d = ~F.col(x).eqNullSafe(F.col(f"__t_{x}"))
            differs = differs | d
            reasons.append(F.when(d, F.format_string("Column %s source %s target %s", F.lit(x), F.coalesce(F.col(x).cast("string"), F.lit("null")), F.coalesce(F.col(f"__t_{x}").cast("string"), F.lit("null")))))
        late = F.lit(False)
        if source_valid_from and c.valid_from and c.valid_from in target.columns:
            late = F.coalesce(F.col("__from") < F.col(f"__t_{c.valid_from}"), F.lit(False))
        new = F.col("__in").isNull()
        op = F.when(F.col("__n").isNull(), "D").when(new | ((F.col("__n") > 1) & ~late), "C").when(differs & ~late, "U")
        both = both.withColumn("__op", op).withColumn("__why", F.concat_ws("; ", *reasons) if reason else F.lit(None).cast("string")).filter("__op IS NOT NULL")
        has_version = c.version and c.version in target.columns
        base = F.coalesce(F.col(f"__t_{c.version}"), F.lit(0)) if has_version else F.lit(0)
        both = both.withColumn("__version", base + F.coalesce("__n", F.lit(0)))
        back = [F.col(f"__t_{x}").alias(x) if x in keep else F.lit(None).cast(source.schema[x].dataType).alias(x) for x in payload]
        audit = [F.col(f"__t_{x}").alias(x) for x in extra]
        if preserve:
            opened = both.filter("__op IN ('C', 'U')").withColumn("__op", F.lit("C"))
            first = F.when(F.col("__op") == "D", stamp).otherwise(F.col("__from"))
            gone = both.filter("__op IN ('U', 'D')").select(*back, *[a for a, x in zip(audit, extra, strict=True) if x != c.valid_to], first.alias("__closed"), F.col("__why"))
            closes = gone.withColumn("operation", F.lit("U"))
            creates = opened
        else:
            changed = both.filter("__op IN ('U', 'D')")
            values = [F.when(F.col("__op") == "U", F.col(x)).otherwise(F.col(f"__t_{x}") if x in keep else F.lit(None)).alias(x) for x in payload]
            closes = changed.select(*values, *audit, F.lit(None).cast("timestamp_ntz").alias("__closed"), "__why", F.col("__op").alias("operation"))
            creates = both.filter("__op = 'C'")
        creates = creates.select(*payload, "__from", "__next", "__last", "__version", "__why", F.lit("C").alias("__op"))

    made = creates.select(*payload, F.col("__from"), F.col("__next"), F.col("__version"), F.lit(None).cast("string").alias("update_reason"), F.lit("C").alias("operation"))
    if c.surrogate:
        # max + rank over the natural key, numbered within buckets and offset by the counts of the buckets before: no single-task sort
        top = first_key
        if top is None:
            top = 0 if strategy == "reload" or c.surrogate not in target.columns else int(target.agg(F.coalesce(F.max(c.surrogate), F.lit(0))).first()[0])
        made = number(made, [*keys, "__from", "__version"], c.surrogate, top)
    cols = {}
    cols[c.valid_from], cols[c.valid_to] = F.col("__from"), F.coalesce(F.col("__next"), F.lit(END).cast("timestamp_ntz"))
    cols[c.current], cols[c.version] = F.col("__next").isNull(), F.col("__version").cast("int")
    cols[c.created], cols[c.updated] = stamp, stamp
    made = made.withColumns({k: v for k, v in cols.items() if k}).drop("__from", "__next", "__version")
    out = made
    if closes is not None:
        is_close = preserve
        upd = {}
        if is_close:
            if c.valid_to:
                upd[c.valid_to] = F.col("__closed")
            if c.current:
                upd[c.current] = F.lit(False)
        else:
            if c.current:
                upd[c.current] = F.lit(True)
        if c.updated:
            upd[c.updated] = stamp
        closes = closes.withColumns(upd).withColumn("update_reason", F.nullif("__why", F.lit(""))).drop("__closed", "__why")
        out = made.unionByName(closes, allowMissingColumns=True)
    if strategy == "reload":
        cut = made.limit(0).select([F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema.fields])
        truncate = made.sparkSession.range(1).select(*[(F.lit("T") if f.name == "operation" else F.lit(None).cast(f.dataType)).alias(f.name) for f in cut.schema.fields])
        out = truncate.unionByName(made)
    if default_row and c.surrogate and not (c.surrogate in target.columns and strategy != "reload" and target.filter(F.col(c.surrogate) == 0).limit(1).count()):
        special = {c.surrogate: F.lit(0), c.valid_from: F.lit(BEGIN).cast("timestamp_ntz"), c.valid_to: F.lit(END).cast("timestamp_ntz"), c.current: F.lit(True), c.version: F.lit(1), c.created: stamp, c.updated: stamp, "operation": F.lit("C")}
        row = out.sparkSession.range(1).select(*[special.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in out.schema.fields])
        out = out.unionByName(row)
    return out


def number(df: DataFrame, order: Sequence[str], target: str, start: int = 0, buckets: int | None = None) -> DataFrame:
    """Numbers from start + 1, in the order of hash buckets of `order`, then of `order`: as many buckets as the session has shuffle partitions, 200 at least."""
    buckets = buckets or max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    size = b.groupBy("__b").agg(F.count("*").alias("__c"))
    offset = size.select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    n = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return b.withColumn("__r", n).join(F.broadcast(offset), "__b").withColumn(target, F.col("__o") + F.col("__r") + start).drop("__b", "__r", "__o")


def apply(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The target after the changes, matched by a key (the surrogate key): truncates, deletes and updates take effect, creates are added."""
    cols = target.columns
    if changes.filter("operation = 'T'").limit(1).count():
        return changes.filter("operation = 'C'").select(*cols)
    gone = changes.filter("operation IN ('U', 'D')").select(key).distinct()
    fresh = changes.filter("operation IN ('C', 'U')").select(*[F.col(x) if x in changes.columns else F.lit(None).cast(target.schema[x].dataType).alias(x) for x in cols])
    return target.join(gone, key, "left_anti").select(*cols).unionByName(fresh)


def parent_child(parent_changes: DataFrame, children: DataFrame, parent_keys: Sequence[str], surrogate: str, parent_surrogate: str = "parent_key") -> DataFrame:
    """Child source rows with the surrogate key and operation of their parent's change, to be compared with the child target."""
    p = parent_changes.filter("operation IN ('C', 'U', 'D')").select(*parent_keys, F.col(surrogate).alias(parent_surrogate), F.col("operation").alias("parent_operation"))
    return children.join(p, list(parent_keys), "inner")
