"""Operators: join policies, series goldens, validation, change capture, sources, writers, plans, streams."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import plans, streaming
from tessera.operators import delta as D
from tessera.operators import groups as G
from tessera.operators import joins as J
from tessera.operators import quality as Q
from tessera.operators import series as S
from tessera.operators.filters import Filter, where
from tessera.operators.mapping import MapAggregate
from tessera.sources import datasources, readers, writers


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(f"value{i:02}", i) for i in range(1, 11)], "s string, i int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(f"value{i:02}", i, f"lookup{i}") for i in range(1, 10)] + [("value04", 4, "lookup4a")], "s string, i int, v string")


def test_missing(left, right):
    assert J.join(left, right, ["s"], missing="filter", duplicates="first", order="v").count() == 9
    assert J.join(left, right, ["s"], duplicates="first", order="v", alias="r").filter("r__v IS NULL").count() == 1
    with pytest.raises(Exception, match="no match"):
        J.join(left, right, ["s"], missing="abend").collect()


def test_duplicates(left, right):
    assert J.join(left, right, ["s"]).count() == 11
    last = J.join(left, right, ["s"], duplicates="last", order="v", alias="r")
    assert last.filter("s = 'value04'").first()["r__v"] == "lookup4a"
    assert J.join(left, right, ["s"], duplicates="last", order="v", alias="r", condition=lambda a, b: b["v"] != "lookup4a").filter("s = 'value04'").first()["r__v"] == "lookup4"
    with pytest.raises(Exception, match="several matches"):
        J.join(left, right, ["s"], duplicates="abend").collect()
    assert J.join(left, right, ["s"], node="n").filter(F.size("n") == 2).count() == 1


def test_null_keys(spark):
    a = spark.createDataFrame([(None,), (1,)], "k int")
    assert J.join(a, a, ["k"], missing="filter", alias="r").count() == 1
    assert J.join(a, a, ["k"], missing="filter", alias="r", null_safe=True).count() == 2


def test_valid_dates(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    a = spark.createDataFrame([(1, d("2000-01-01"), d("2000-02-01")), (1, d("2000-02-01"), d("2000-03-01"))], "k int, f timestamp_ntz, t timestamp_ntz")
    b = spark.createDataFrame([(1, "1a", d("1999-01-01"), d("1999-06-30")), (1, "1b", d("1999-07-01"), d("2000-01-10")), (1, "1c", d("2000-01-10"), d("2000-02-10")), (1, "1d", d("2000-02-10"), d("2000-03-10"))], "k int, v string, f timestamp_ntz, t timestamp_ntz")
    got = [(r["r__v"], r["f"].strftime("%m-%d"), r["t"].strftime("%m-%d")) for r in J.valid_dates(a, b, ["k"], ("f", "t"), ("f", "t"), "r").orderBy("f").collect()]
    assert got == [("1b", "01-01", "01-10"), ("1c", "01-10", "02-01"), ("1c", "02-01", "02-10"), ("1d", "02-10", "03-01")]


def test_series_gaps(spark):
    rows = [(dt.datetime(2015, 1, d), d) for d in (1, 2, 5, 6, 7, 9, 10)]
    df = spark.createDataFrame(rows, "day timestamp_ntz, n int")
    out = S.series(df, "day", "day", aggregates=[MapAggregate("n", "n", "sum")])
    got = [r["n"] for r in out.orderBy("day").collect()]
    assert got == [1, 2, 0, 0, 5, 6, 7, 0, 9, 10]
    week = S.series(df, "day", "weekday", aggregates=[MapAggregate("n", "n", "sum")], project=2)
    assert [(r["day"].day, r["n"]) for r in week.filter("NOT is_forecast").orderBy("day").collect()] == [(1, 1), (2, 2), (5, 5), (6, 6), (7, 7), (8, 0), (9, 19)]
    assert [r["day"].day for r in week.filter("is_forecast").orderBy("day").collect()] == [12, 13]
    with pytest.raises(Exception, match="more than 5 points"):
        S.series(df, "day", "day", aggregates=[MapAggregate("n", "n", "sum")], most=5).collect()
    clipped = S.series(df, "day", "day", aggregates=[MapAggregate("n", "n", "sum")], start="2014-12-30", finish="2015-01-03")
    assert [r["n"] for r in clipped.orderBy("day").collect()] == [0, 0, 1, 2, 0]


def test_filters_fold_left(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 1, 1)], "a int, b int, c int")
    assert where(df, Filter("a", "=", 1), Filter("b", "=", 1, join="or"), Filter("c", "=", 1)).count() == 1
    assert where(spark.createDataFrame([(None,), (1,)], "a int"), Filter("a", ">", 5, allow_null=True)).count() == 1


def test_validation(spark):
    df = spark.createDataFrame([("5", "abcdef"), ("x", "ab"), (None, "abc")], "n string, s string")
    target = T.StructType([T.StructField("n", T.IntegerType(), False)])
    out = Q.validate(df, [Q.Rule("s", "validation.MaxLength", (4,), Q.REJECT_CLEAN)], target)
    got = sorted((r["n"] or "", r["s"], r["validation_status"], r["operation"]) for r in out.collect())
    assert got == [("", "abc", "rejected", "R"), ("5", "abcd", "cleaned", "C"), ("5", "abcdef", "rejected-cleaned", "R"), ("x", "ab", "rejected", "R")]
    assert Q.accepted(out).count() == 1 and Q.rejected(out).count() == 3
    with pytest.raises(Exception, match="validation failed"):
        Q.validate(df, [Q.Rule("s", lambda s: s == "z", (), Q.ABEND)]).collect()


def test_profile(spark):
    df = spark.createDataFrame([("A1",), ("b2",), (None,), ("",)], "x string")
    rows = {(r["function"], r["is_summary"], r["value"]): r["count"] for r in Q.profile(df).collect()}
    assert rows[("Nulls", True, "25.00 %")] == 4 and rows[("Blanks", True, "50.00 %")] == 4 and rows[("Patterns", False, "A9")] == 1 and rows[("DistinctValues", True, "Unique")] == 4


@pytest.fixture()
def source(spark):
    return spark.createDataFrame([(i, f"n{i}", i % 2) for i in range(1, 11)], "id int, name string, odd int")


@pytest.mark.parametrize("strategy", ["append_update", "append_update_delete", "append_update_preserve", "append_update_delete_preserve"])
def test_delta_twice_changes_nothing(spark, source, strategy):
    empty = D.delta(source.limit(0), spark.createDataFrame([], "surrogate_key long"), ["id"], strategy="append")
    first = D.delta(source, empty.drop("operation", "update_reason"), ["id"], strategy=strategy)
    assert {r["operation"] for r in first.collect()} == {"C"} and sorted(r["surrogate_key"] for r in first.collect()) == list(range(1, 11))
    target = first.drop("operation", "update_reason")
    assert D.delta(source, target, ["id"], strategy=strategy).count() == 0


def test_delta_preserves(spark, source):
    target = D.delta(source, spark.createDataFrame([], "surrogate_key long"), ["id"], strategy="append", now="2020-01-01 00:00:00").drop("operation", "update_reason")
    changed = source.withColumn("name", F.when(F.col("id") == 3, "new").otherwise(F.col("name"))).filter("id <> 7").unionByName(spark.createDataFrame([(11, "x", 1)], source.schema))
    out = D.delta(changed, target, ["id"], strategy="append_update_delete_preserve", now="2021-01-01 00:00:00")
    rows = sorted((r["id"], r["operation"], r["is_current"], r["version"], r["valid_to"].year) for r in out.collect())
    assert rows == [(3, "C", True, 2, 2099), (3, "U", False, 1, 2021), (7, "U", False, 1, 2021), (11, "C", True, 1, 2099)]
    after = D.apply(target, out, "surrogate_key")
    assert after.count() == 12 and after.filter("is_current").count() == 10


def test_delta_history_in_source(spark):
    rows = [(1, "a", "2020-01-01"), (1, "b", "2020-02-01")]
    src = spark.createDataFrame(rows, "id int, name string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    none = D.delta(src.drop("at").limit(0), spark.createDataFrame([], "surrogate_key long"), ["id"], strategy="append").drop("operation", "update_reason")
    out = D.delta(src, none, ["id"], tracked=["name"], strategy="append_update_preserve", source_valid_from="at").orderBy("version").collect()
    assert [(r["name"], r["version"], r["is_current"]) for r in out] == [("a", 1, False), ("b", 2, True)] and out[0]["valid_to"] == out[1]["valid_from"]
    last = D.delta(src, none, ["id"], tracked=["name"], strategy="append_update", source_valid_from="at").collect()
    assert [r["name"] for r in last] == ["b"]


def test_default_row_and_reload(spark, source):
    out = D.delta(source, spark.createDataFrame([], "surrogate_key long"), ["id"], strategy="reload", default_row=True)
    ops = [r["operation"] for r in out.collect()]
    assert ops.count("T") == 1 and ops.count("C") == 11 and out.filter("surrogate_key = 0").count() == 1


def test_nodes(spark):
    df = spark.createDataFrame([(0, [(1, "a"), (2, "b")]), (1, [])], "id int, kids array<struct<k:int,n:string>>")
    out = G.ungroup(df, "kids")
    assert out.columns == ["id", "kids.k", "kids.n"] and out.count() == 3


def test_global_running(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    out = {r["o"]: (r["s"], r["n"]) for r in G.global_running(df, "o", "v", "s", "n").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert out[i] == (total, i + 1)


def test_hierarchy(spark):
    from tessera.functions.hierarchy import flatten

    df = spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "c int, p int")
    assert {(r["c"], r["level_depth"], tuple(r["levels"])) for r in flatten(df, "c", "p").collect()} == {(1, 0, (1,)), (2, 1, (1, 2)), (3, 2, (1, 2, 3)), (4, 2, (1, 2, 4))}
    with pytest.raises(ValueError):
        flatten(spark.createDataFrame([(2, 1), (2, 3)], "c int, p int"), "c", "p")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nid,name\n1, x \n2,\n")
    assert [(r["id"], (r["name"] or "").strip()) for r in readers.csv(spark, str(tmp_path / "a.csv"), skip=1).collect()] == [("1", "x"), ("2", "")]
    (tmp_path / "b.csv").write_text("id,name\n1,x\n2,\n")
    assert readers.csv(spark, str(tmp_path / "b.csv"), file_columns={"name": "file"}).filter("name IS NULL AND file = 'b.csv'").count() == 1
    (tmp_path / "t.json").write_text('[{"id": 1, "items": [{"k": 1}, {"k": 2}]}]')
    assert readers.json(spark, str(tmp_path / "t.json"), "items").count() == 2
    (tmp_path / "t.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert readers.xml(spark, str(tmp_path / "t.xml"), "row").agg(F.sum("a")).first()[0] == 3


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(100)])
    datasources.register(spark)
    df = spark.read.format("sqlite_file").options(path=path, table="t", parts=3).load()
    assert df.filter("id >= 90").count() == 10 and df.agg(F.count_distinct("id")).first()[0] == 100
    df.filter("id < 5").write.format("sqlite_file").mode("append").options(path=path, table="u").save()
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT count(*) FROM u").fetchone()[0] == 5
        assert readers.from_reader(spark, con.execute("SELECT * FROM t"), 30).count() == 100


def test_writer(spark, tmp_path, source):
    t = writers.Target(str(tmp_path / "t"), rejects=str(tmp_path / "rejects"))
    first = D.delta(source, spark.createDataFrame([], "surrogate_key long"), ["id"], strategy="append")
    a = writers.run(first, t, "surrogate_key")
    assert (a.status, a.rows_read, a.created) == ("passed", 10, 10)
    now = spark.read.parquet(t.path)
    b = writers.run(D.delta(source.withColumn("name", F.lit("z")).filter("id > 2"), now, ["id"], strategy="append_update_delete"), t, "surrogate_key")
    assert (b.updated, b.deleted) == (8, 2)
    assert spark.read.parquet(t.path).filter("name = 'z'").count() == 8 and writers.audit_frame(spark, a, b).count() == 2
    assert '"data": [[1, "n1", 1]]' in writers.json_compact(source, 1)


def test_plans(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).select(F.col("id"), (F.col("id") % 5).alias("k"), F.lit("x").alias("s")).write.parquet(path)
    df = spark.read.parquet(path)
    q = where(df, Filter("k", "=", 3)).select("id")
    assert "EqualTo(k,3)" in plans.pushed_filters(q)[0] and plans.read_columns(q) == ["id,k"] and plans.shuffles(q) == 0
    assert plans.shuffles(G.group(df, ["k"], [MapAggregate("id", "n", "count")])) == 1 and not plans.uses_python(q)


def test_stream(spark, tmp_path):
    path, done = str(tmp_path / "in"), []
    spark.range(10).write.parquet(path)
    q = streaming.run(streaming.files(spark, path, "id long"), lambda b, n: done.append(b.count()), str(tmp_path / "check"))
    q.awaitTermination()
    q = streaming.run(streaming.files(spark, path, "id long"), lambda b, n: done.append(b.count()), str(tmp_path / "check"))
    q.awaitTermination()
    assert sum(done) == 10


def test_last_of_hot_keys(spark):
    """A key with many rows on either side: its rows never meet each other's."""
    left = spark.range(30_000).select(F.lit(1).alias("k"), "id")
    right = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    out = J.join(left, right, ["k"], duplicates="last", order="o", alias="r")
    assert out.agg(F.count("*"), F.min("r__v"), F.max("r__v")).first()[:] == (30_000, 59_998, 59_998)
    both = J.join(left.limit(3), right.limit(4), ["k"], alias="r", node="rows")
    assert [len(r["rows"]) for r in both.collect()] == [4, 4, 4]
    none = J.join(left.limit(3), right.limit(0), ["k"], alias="r", node="rows")
    assert [r["rows"] for r in none.collect()] == [[], [], []] and J.join(left, right.limit(0), ["k"], node="rows", missing="filter").count() == 0
