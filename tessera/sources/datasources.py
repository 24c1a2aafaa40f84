"""Data sources in Python: SQLite files, web services, and stores that list pages of items.

Each is registered with `register(spark)` and then read by name. They partition their work; a `query` does what should be done at the source.
"""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T


class SqliteSource(D.DataSource):
    """format "sqlite_file": path, and table or query; parts: how many ranges of rowid a table is read in."""

    @classmethod
    def name(cls):
        return "sqlite_file"

    def _query(self):
        return self.options.get("query") or f'SELECT * FROM "{self.options["table"]}"'

    def schema(self):
        with sqlite3.connect(self.options["path"]) as con:
            cur = con.execute(f"SELECT * FROM ({self._query()}) LIMIT 100")
            names = [d[0] for d in cur.description]
            rows = cur.fetchall()
        kinds = []
        for i, _ in enumerate(names):
            seen = {type(r[i]) for r in rows if r[i] is not None}
            kinds.append(T.LongType() if seen == {int} else T.DoubleType() if seen and seen <= {int, float} else T.BinaryType() if seen == {bytes} else T.StringType())
        return T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema):
        return SqliteReader(self.options, schema)

    def writer(self, schema, overwrite):
        return SqliteWriter(self.options, schema, overwrite)


class SqliteReader(D.DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.columns = dict(options), schema

    def partitions(self):
        parts = int(self.options.get("parts", 1))
        if parts < 2 or "query" in self.options:
            return [D.InputPartition(None)]
        with sqlite3.connect(self.options["path"]) as con:
            lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if lo is None:
            return [D.InputPartition(None)]
        step = max(1, -(-(hi - lo + 1) // parts))
        return [D.InputPartition((a, a + step)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        sql, args = (self.options.get("query") or f'SELECT * FROM "{self.options["table"]}"'), []
        where = []
        if partition.value:
            where.append("rowid >= ? AND rowid < ?")
            args += partition.value
        if "query" in self.options:
            sql = f"SELECT * FROM ({sql})"
        with sqlite3.connect(self.options["path"]) as con:
            cur = con.execute(sql + (" WHERE " + " AND ".join(where) if where else ""), args)
            at = {d[0]: i for i, d in enumerate(cur.description)}
            order = [at[f.name] for f in self.columns.fields]
            casts = [float if isinstance(f.dataType, T.DoubleType) else str if isinstance(f.dataType, T.StringType) else None for f in self.columns.fields]
            for row in cur:
                yield tuple(None if row[i] is None else c(row[i]) if c else row[i] for i, c in zip(order, casts, strict=True))


class SqliteWriter(D.DataSourceWriter):
    """One transaction a task, SQLite's lock being waited for; a failed task leaves nothing behind."""

    def __init__(self, options, schema, overwrite):
        self.options, self.names = dict(options), [f.name for f in schema.fields]
        kinds = ["INTEGER" if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.BooleanType)) else "REAL" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else "BLOB" if isinstance(f.dataType, T.BinaryType) else "TEXT" for f in schema.fields]
        with sqlite3.connect(self.options["path"]) as con:
            if overwrite:
                con.execute(f'DROP TABLE IF EXISTS "{self.options["table"]}"')
            con.execute(f'CREATE TABLE IF NOT EXISTS "{self.options["table"]}" ({", ".join(f"{json.dumps(n)} {k}" for n, k in zip(self.names, kinds, strict=True))})')

    def write(self, rows):
        with sqlite3.connect(self.options["path"], timeout=600, isolation_level=None) as con:
            con.execute("BEGIN IMMEDIATE")
            marks = ", ".join("?" * len(self.names))
            con.executemany(f'INSERT INTO "{self.options["table"]}" VALUES ({marks})', ((*[v if isinstance(v, (int, float, str, bytes, type(None))) else str(v) for v in r],) for r in rows))
            con.execute("COMMIT")
        return D.WriterCommitMessage()


class RestSource(D.DataSource):
    """format "rest_json": url with {page} where it has pages, pages, path (dotted, to the array of rows), and a schema."""

    @classmethod
    def name(cls):
        return "rest_json"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return RestReader(self.options, schema)


class RestReader(D.DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.columns = dict(options), schema

    def partitions(self):
        return [D.InputPartition(i) for i in range(int(self.options.get("first", 1)), int(self.options.get("first", 1)) + int(self.options.get("pages", 1)))]

    def read(self, partition):
        import urllib.request

        request = urllib.request.Request(self.options["url"].replace("{page}", str(partition.value)))
        if "token" in self.options:
            request.add_header("Authorization", f"Bearer {self.options['token']}")
        with urllib.request.urlopen(request, timeout=60) as r:
            data = json.loads(r.read())
        for step in [p for p in self.options.get("path", "").split(".") if p]:
            data = data[step]
        names = [f.name for f in self.columns.fields]
        for item in data if isinstance(data, list) else [data]:
            if names == ["value"] and not (isinstance(item, dict) and "value" in item):
                yield (json.dumps(item),)
            else:
                yield tuple(item.get(n) if not isinstance(item.get(n), (dict, list)) or not isinstance(f.dataType, T.StringType) else json.dumps(item[n]) for n, f in zip(names, self.columns.fields, strict=True))


class StoreSource(D.DataSource):
    """format "key_value": items of a document or key-value store in `segments` parallel scans.

    `client` names an importable function client(options, segment, segments) that yields dicts; Azure tables, DynamoDB and MongoDB clients are each
    a few lines around their own packages, which this library doesn't need.
    """

    @classmethod
    def name(cls):
        return "key_value"

    def schema(self):
        return "item string"

    def reader(self, schema):
        return StoreReader(self.options, schema)


class StoreReader(D.DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.columns = dict(options), schema

    def partitions(self):
        return [D.InputPartition(i) for i in range(int(self.options.get("segments", 1)))]

    def read(self, partition):
        import importlib

        module, _, name = self.options["client"].rpartition(".")
        names = [f.name for f in self.columns.fields]
        for item in getattr(importlib.import_module(module), name)(self.options, partition.value, int(self.options.get("segments", 1))):
            yield (json.dumps(item),) if names == ["item"] else tuple(item.get(n) for n in names)


def register(spark: SparkSession) -> None:
    for s in (SqliteSource, RestSource, StoreSource):
        spark.dataSource.register(s)
