"""Writers: target actions, delta application, rejects, audit, and JSON and CSV forms of results."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.delta import apply


@dataclass
class Target:
    """A folder of files. action: none (append), truncate, drop_create, create_not_exists; folders for rejects and processed files beside."""

    path: str
    kind: str = "parquet"
    action: str = "none"
    partition: tuple = ()
    rejects: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Audit:
    """What a run did."""

    audit_key: str
    started: str
    ended: str | None = None
    status: str = "running"
    rows_read: int = 0
    created: int = 0
    updated: int = 0
    deleted: int = 0
    rejected: int = 0
    high_water: str | None = None
    message: str | None = None


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def move(spark: SparkSession, source: str, target: str) -> bool:
    fs = spark._jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    system = a.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(b.getParent())
    return system.rename(a, b)


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write(df: DataFrame, target: Target) -> None:
    """Bulk write by the target's action."""
    spark = df.sparkSession
    mode = {"none": "append", "truncate": "overwrite", "drop_create": "overwrite", "create_not_exists": "append"}[target.action]
    if target.action == "create_not_exists" and exists(spark, target.path):
        mode = "append"
    w = df.write.mode(mode).options(**target.options)
    if target.partition:
        w = w.partitionBy(*target.partition)
    w.format(target.kind).save(target.path)


def replace(df: DataFrame, target: Target) -> None:
    """A new version beside the old one, with the target's partitions and options, then two renames; df may read from the target itself.

    Between the renames, for a moment, nothing stands at the path; if the second one fails, the old version is put back.
    """
    spark, path = df.sparkSession, target.path
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(df, Target(fresh, target.kind, "none", target.partition, options=target.options))
    if exists(spark, path):
        move(spark, path, old)
    if not move(spark, fresh, path):
        if exists(spark, old):
            move(spark, old, path)
        raise OSError(f"{path} could not be replaced")
    if exists(spark, old):
        delete(spark, old)


def run(df: DataFrame, target: Target, key: str | None = None, incremental: str | None = None, counted: bool = True) -> Audit:
    """Writes a DataFrame, with an operation column or without, and tells what was done.

    Operations are counted in the table of changes that is written first. Rows without operations are counted by a second pass over df, unless
    `counted` is False. (An Observation would count in the same pass, but once one is used, a session can't be sent to tasks, as pyspark.ml does.)

    With operations, creates are appended, and updates and deletes applied by `key` to the whole target, which is replaced at once; rejects go
    to the target's folder for them.
    """
    spark = df.sparkSession
    audit = Audit(uuid.uuid4().hex, dt.datetime.now(dt.UTC).isoformat())
    seen: dict = {}
    op = F.col("operation") if "operation" in df.columns else F.lit("C")
    marks = [F.count(F.lit(1)).alias("rows_read"), *[F.count_if(op == o).alias(n) for o, n in (("C", "created"), ("U", "updated"), ("D", "deleted"), ("R", "rejected"))]]
    if incremental:
        marks.append(F.max(incremental).cast("string").alias("high_water"))
    try:
        if "operation" not in df.columns:
            write(df, target)
            if counted:
                seen = df.agg(*marks).first().asDict()
        else:
            # one pass over the changes, kept for the writes that follow
            held = f"{target.path}.changes-{audit.audit_key}"
            df.write.parquet(held)
            changes = spark.read.schema(df.schema).parquet(held)
            seen = changes.agg(*marks).first().asDict()
            try:
                if target.rejects:
                    changes.filter("operation = 'R'").write.mode("append").parquet(target.rejects)
                body = changes.filter("operation <> 'R'")
                drop = [c for c in ("operation", "update_reason", "reject_reason", "validation_status") if c in df.columns]
                if exists(spark, target.path) and target.action not in ("truncate", "drop_create"):
                    if body.filter("operation <> 'C'").limit(1).count():
                        replace(apply(spark.read.format(target.kind).options(**target.options).load(target.path), body, key), target)
                    else:
                        write(body.drop(*drop), Target(target.path, target.kind, "none", target.partition, options=target.options))
                else:
                    write(body.filter("operation = 'C'").drop(*drop), target)
            finally:
                delete(spark, held)
        for k, v in seen.items():
            setattr(audit, k, v)
        audit.status = "passed"
    except Exception as e:
        audit.status, audit.message = "failed", str(e)[:2000]
        raise
    finally:
        audit.ended = dt.datetime.now(dt.UTC).isoformat()
    return audit


def audit_frame(spark: SparkSession, *audits: Audit) -> DataFrame:
    return spark.createDataFrame([asdict(a) for a in audits], "audit_key string, started string, ended string, status string, rows_read long, created long, updated long, deleted long, rejected long, high_water string, message string")


def jdbc(df: DataFrame, url: str, table: str, mode: str = "append", truncate: bool = False, batch: int = 1000, **options) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, truncate=truncate, batchsize=batch, **options).save()


def csv_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """value: the rows as CSV text, quoted where needed."""
    flat = df.select(*[(F.to_json(f"`{f.name}`") if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
    return flat.select(F.to_csv(F.struct("*"), {"sep": delimiter}).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def json_page(df: DataFrame, rows: int = 100, name: str = "table") -> str:
    """One page of results as a JSON object: name, columns, data. For display; it holds at most `rows` rows."""
    data = [json.loads(r["value"]) for r in json_lines(df.limit(rows)).collect()]
    return json.dumps({"name": name, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], "data": data})


def json_compact(df: DataFrame, rows: int = 100, name: str = "table") -> str:
    """The same with rows as arrays."""
    page = json.loads(json_page(df, rows, name))
    page["data"] = [[r.get(f.name) for f in df.schema.fields] for r in page["data"]]
    return json.dumps(page)
