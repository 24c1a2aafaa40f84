"""Readers: memory, objects, generated rows, files, databases, stores."""

from __future__ import annotations

import csv as csv_module
import dataclasses
import io
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def memory(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def objects(spark: SparkSession, items: Iterable) -> DataFrame:
    """A row for each dataclass instance."""
    return spark.createDataFrame([dataclasses.asdict(i) for i in items])


def row_creator(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """RowNumber from start to end, both included."""
    return spark.range(start, end + (1 if step > 0 else -1), step).withColumnRenamed("id", "RowNumber")


def dynamic(spark: SparkSession, values: dict) -> DataFrame:
    """One row, of the values that lookups filter by."""
    return spark.createDataFrame([tuple(values.values())], list(values))


def json_array(spark: SparkSession, text: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON array given as text."""
    one = spark.createDataFrame([(text,)], "j string")
    kind = f"array<struct<{schema}>>" if schema else one.select(F.schema_of_json(F.lit(text))).first()[0]
    return one.select(F.inline(F.from_json("j", kind)))


def from_reader(spark: SparkSession, cursor, batch: int = 10_000) -> DataFrame:
    """Rows of a DB-API cursor that has run its query; they pass through this process, so it is for small results."""
    names = [d[0] for d in cursor.description]
    out = None
    while part := cursor.fetchmany(batch):
        df = spark.createDataFrame([tuple(r) for r in part], names if out is None else out.schema)
        out = df if out is None else out.union(df)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))


def convert_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


# --- files ----------------------------------------------------------------------------------------------------------


def _file_columns(df: DataFrame, names: dict) -> DataFrame:
    """file_name, file_date columns of a file source, and row numbers within files where asked for."""
    meta = {"name": F.col("_metadata.file_name"), "date": F.col("_metadata.file_modification_time"), "path": F.col("_metadata.file_path")}
    return df.select("*", *[meta[k].alias(v) for k, v in names.items() if k in meta])


def csv(spark: SparkSession, path: str, schema=None, header: bool = True, delimiter: str = ",", quote: str = '"', skip: int = 0, blank_as_null: bool = True, encoding: str = "UTF-8",
        file_columns: dict | None = None, strict: bool = False) -> DataFrame:
    """CSV files. Headers are matched by name where a schema is given; skip: lines at the top of each file, before the header."""
    opts = {"header": header, "sep": delimiter, "quote": quote, "encoding": encoding, "enforceSchema": False if header and schema is not None else True, "mode": "FAILFAST" if strict else "PERMISSIVE"}
    if blank_as_null:
        opts |= {"nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if skip:
        return _csv_after(spark, path, schema, header, delimiter, quote, skip, blank_as_null, encoding, file_columns or {}, strict)
    r = spark.read.options(**opts)
    df = (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    return _file_columns(df, file_columns) if file_columns else df


def _csv_after(spark, path, schema, header, delimiter, quote, skip, blank_as_null, encoding, file_columns, strict) -> DataFrame:
    """CSV files without their first lines. Each file is parsed by one task, that holds it; each has a header of its own, matched by name."""
    files = spark.read.format("binaryFile").load(path)

    def records(raw: bytes):
        text, at = raw.decode(encoding), 0
        for _ in range(skip):
            at = text.find("\n", at) + 1
            if not at:
                return
        yield from (r for r in csv_module.reader(io.StringIO(text[at:], newline=""), delimiter=delimiter, quotechar=quote) if r)

    if schema is None:

        def heads(batches):
            for b in batches:
                out = [next(records(c.as_py()), []) for c in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["path", "head"])

        head = files.select("path", "content").mapInArrow(heads, "path string, head array<string>").agg(F.min_by("head", "path")).first()[0] or []
        schema = T.StructType([T.StructField(h.strip() if header else f"_c{k}", T.StringType()) for k, h in enumerate(head)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.names

    def run(batches):
        for b in batches:
            for k, content in enumerate(b.column(2)):
                rows = records(content.as_py())
                if header:
                    own = [h.strip() for h in next(rows, [])]
                    at = [own.index(n) if n in own else -1 for n in names]
                else:
                    at = list(range(len(names)))
                part: list[list] = [[] for _ in names]

                def batch(part, k=k, b=b):
                    n = len(part[0])
                    meta = [pa.repeat(b.column(i)[k], n) for i in (0, 1)]
                    return pa.RecordBatch.from_arrays([*meta, *[pa.array(p, pa.string()) for p in part]], ["path", "date", *[f"c{i}" for i in range(len(names))]])

                for r in rows:
                    for p, i in zip(part, at, strict=True):
                        v = r[i] if 0 <= i < len(r) else None
                        if v is not None and blank_as_null:
                            v = v.strip(" \t") or None
                        p.append(v)
                    if len(part[0]) == 10_000:
                        yield batch(part)
                        part = [[] for _ in names]
                if names and part[0]:
                    yield batch(part)

    kinds = ", ".join(f"c{i} string" for i in range(len(names)))
    found = files.select("path", "modificationTime", "content").mapInArrow(run, f"path string, date timestamp, {kinds}")
    value = lambda i, f: (F.col(f"c{i}").cast if strict else F.col(f"c{i}").try_cast)(f.dataType).alias(f.name)
    meta = {"name": F.element_at(F.split("path", "/"), -1), "date": F.col("date"), "path": F.col("path")}
    return found.select(*[value(i, f) for i, f in enumerate(schema.fields)], *[meta[k].alias(v) for k, v in file_columns.items() if k in meta])


def json(spark: SparkSession, path: str, row_path: str | None = None, schema=None, file_columns: dict | None = None, lines: bool = False) -> DataFrame:
    """JSON files; row_path: a dotted path to the array whose elements are rows."""
    r = spark.read.option("multiLine", not lines)
    df = (r.schema(schema) if schema is not None else r).json(path)
    if file_columns:
        df = _file_columns(df, file_columns)
    if row_path:
        keep = list(file_columns.values()) if file_columns else []
        df = df.select(*keep, F.explode_outer(row_path).alias("__r"))
        df = df.select(*keep, "__r.*") if isinstance(df.schema["__r"].dataType, T.StructType) else df.select(*keep, F.col("__r").alias("value"))
    return df


def xml(spark: SparkSession, path: str, row_tag: str, schema=None, **options) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(*paths)


def excel(spark: SparkSession, path: str, sheet=0, header: int = 0, schema=None) -> DataFrame:
    """One sheet, through pandas on the driver: a sheet has at most 1,048,576 rows. Needs openpyxl."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, header=header), schema)


def remote(spark: SparkSession, url: str, kind: str = "csv", **options) -> DataFrame:
    """Files of any Hadoop file system, by scheme: ftp, sftp, abfss, s3a, hdfs, file."""
    return spark.read.format(kind).options(**options).load(url)


# --- databases ------------------------------------------------------------------------------------------------------

DRIVERS = {
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "oracle": "oracle.jdbc.OracleDriver",
    "db2": "com.ibm.db2.jcc.DB2Driver", "sqlite": "org.sqlite.JDBC",
}


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: str | None = None, bounds: tuple | None = None, parts: int = 8, **options) -> DataFrame:
    """A table or query; filters, limits, sorts and aggregates are pushed down. `partition`, a number or date column, and its bounds make it
    read in parallel; without them one task reads all."""
    r = spark.read.format("jdbc").option("url", url).options(pushDownPredicate=True, pushDownAggregate=True, pushDownLimit=True, pushDownTableSample=True, fetchsize=10_000)
    kind = url.split(":")[1]
    if kind in DRIVERS:
        r = r.option("driver", DRIVERS[kind])
    r = r.option("dbtable", table) if table else r.option("query", query)
    if partition and bounds:
        r = r.options(partitionColumn=partition, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=parts)
    return r.options(**options).load()


# --- incremental ----------------------------------------------------------------------------------------------------


def since(df: DataFrame, column: str, last) -> DataFrame:
    """Rows above the high-water mark; all of them where there is none."""
    return df if last is None else df.filter(F.col(column) > F.lit(last))


def high_water(df: DataFrame, column: str):
    return df.agg(F.max(column)).first()[0]
