"""Queries that write tables and read them back, by file format and by target, and of file functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import get
from tessera.sources import readers as R
from tessera.sources import writers as W

C = F.col


def folder(spark) -> str:
    """A new folder: in the shared one that spark.checkpoint.dir names; a temporary one where that is unset and all runs on this machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared}/places-{spark._jvm.java.util.UUID.randomUUID()}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    d = tempfile.mkdtemp(prefix="tessera-places-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


_ORDERS = "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", C("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


def _schema(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@query("file_csv", _ORDERS)
def file_csv(spark, d):
    o, at = _orders(spark, d), folder(spark) + "/csv"
    W.write(o, W.Target(at, "csv", options={"header": True}))
    return R.csv(spark, at, _schema(o))


@query("file_csv_skip", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'a, \"b\" and a' || chr(10) || 'new line'")
def file_csv_skip(spark, d):
    """Files with two lines before the header, and a value of two lines."""
    at = folder(spark) + "/csv"
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    more = spark.createDataFrame([(-1, 'a, "b" and a\nnew line')], c.schema)
    W.write(c.union(more), W.Target(at, "csv", options={"header": False, "escape": '"', "quoteAll": True}))
    headed = get("file.ReadTextFile").build(spark, at, "*.csv").select(F.concat(F.lit('one,"\n'), F.lit('two"\nc_custkey,c_name\n'), "content").alias("value"))
    headed.write.option("lineSep", "\n").text(at + "-headed")
    return R.csv(spark, at + "-headed", "c_custkey bigint, c_name string", skip=2)


@query("file_json", _ORDERS)
def file_json(spark, d):
    o, at = _orders(spark, d), folder(spark) + "/json"
    W.write(o, W.Target(at, "json"))
    return R.json(spark, at, schema=_schema(o), lines=True)


@query("file_json_path", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def file_json_path(spark, d):
    """One object a file, its rows in an array inside."""
    at = folder(spark) + "/json"
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    whole = n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_regionkey", "n_nationkey", "n_name")).alias("rows")).select(F.struct("rows").alias("data"))
    W.write(whole, W.Target(at, "json"))
    return R.json(spark, at, "data.rows", lines=True).select("n_regionkey", "n_nationkey", "n_name")


@query("file_xml", _ORDERS)
def file_xml(spark, d):
    o, at = _orders(spark, d), folder(spark) + "/xml"
    W.write(o, W.Target(at, "xml", options={"rowTag": "order", "rootTag": "orders"}))
    return R.xml(spark, at, "order", _schema(o))


@query("file_orc", _ORDERS)
def file_orc(spark, d):
    o, at = _orders(spark, d), folder(spark) + "/orc"
    W.write(o, W.Target(at, "orc"))
    return R.orc(spark, at)


@query("file_partitions", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0")
def file_partitions(spark, d):
    """Loads, updates and deletes of a partitioned target, which keeps its partitions."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    target = W.Target(folder(spark) + "/customers", partition=("c_mktsegment",))
    W.write(c, target)
    op = F.when(C("c_custkey") % 5 == 0, "D").when(C("c_custkey") % 3 == 0, "U")
    changed = c.withColumn("operation", op).filter("operation IS NOT NULL").withColumn("c_acctbal", C("c_acctbal") + 1)
    audit = W.run(changed, target, "c_custkey")
    parts = {r["name"] for r in get("file.GetFileList").build(spark, target.path, "*.parquet", recursive=True).select(F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1).alias("name")).distinct().collect()}
    if audit.status != "passed" or "" in parts:
        raise ValueError("the target has lost its partitions")
    return spark.read.parquet(target.path).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("file_rejects", "SELECT 'kept' AS place, c_custkey FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'rejected', c_custkey FROM customer WHERE c_acctbal < 0")
def file_rejects(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(C("c_acctbal") < 0, "R").otherwise("C").alias("operation"))
    at = folder(spark)
    W.run(c, W.Target(f"{at}/kept", rejects=f"{at}/rejected"), "c_custkey")
    read = lambda place: spark.read.parquet(f"{at}/{place}").select(F.lit(place).alias("place"), "c_custkey")
    return read("kept").union(read("rejected"))


@query("file_audit", "SELECT 'passed' AS status, count(*) AS rows_read, count(*) AS created, 0::BIGINT AS rejected, max(o_orderkey)::VARCHAR AS high_water FROM orders")
def file_audit(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return W.audit_frame(spark, W.run(o, W.Target(folder(spark) + "/orders", action="truncate"), incremental="o_orderkey")).select("status", "rows_read", "created", "rejected", "high_water")


@query("file_high_water", "SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def file_high_water(spark, d):
    o = table(spark, d, "orders")
    return R.since(o, "o_orderkey", R.high_water(o.filter("o_orderdate < TIMESTAMP'1998-01-01'"), "o_orderkey")).select("o_orderkey")


@query("file_sqlite", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_sqlite(spark, d):
    """Written to a database file and read from it."""
    from tessera.sources import datasources

    at = Path(folder(spark))
    at.mkdir(parents=True, exist_ok=True)
    datasources.register(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.coalesce(1).write.format("sqlite_file").mode("append").options(path=str(at / "nations.db"), table="nation").save()
    found = spark.read.format("sqlite_file").options(path=str(at / "nations.db"), table="nation", parts=3).load()
    return R.convert_types(found.select(*n.columns), n.schema)


@query("fn_files", "SELECT n_name || '.txt' AS name, length(n_name) AS length, n_name AS content FROM nation UNION ALL SELECT n_name || '.bin', length(n_name), n_name FROM nation")
def fn_files(spark, d):
    """A text and a binary file for each nation: saved, listed, read."""
    at = folder(spark) + "/nations"
    n = table(spark, d, "nation")
    saved = get("file.SaveTextFile").build(n.select(F.concat("n_name", F.lit(".txt")).alias("name"), "n_name"), at, "name", "n_name").count()
    saved += get("file.SaveBinaryFile").build(n.select(F.concat("n_name", F.lit(".bin")).alias("name"), F.encode("n_name", "UTF-8").alias("data")), at, "name", "data").count()
    files = get("file.GetFileList").build(spark, at)
    if saved != files.count() or get("file.GetFileListInfo").build(spark, at, "*.txt").count() != get("file.GetFileInformation").build(spark, at, "*.bin").count():
        raise ValueError("files are missing")
    name = F.element_at(F.split("path", "/"), -1)
    texts = get("file.ReadTextFile").build(spark, at, "*.txt").select(name.alias("name"), "content")
    raw = get("file.ReadBinaryFile").build(spark, at, "*.bin").select(name.alias("name"), F.decode("content", "UTF-8").alias("content"))
    return texts.union(raw).join(files.select("name", "length"), "name").select("name", "length", "content")


@query("fn_throttle", "SELECT n_nationkey FROM nation")
def fn_throttle(spark, d):
    return get("throttle.Throttle").build(table(spark, d, "nation").select("n_nationkey"), 100, 0.01)
