"""Queries of the operators: sources, mappings, filters, joins, groups, series, quality, change capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import call
from tessera.operators import delta as D
from tessera.operators import groups as G
from tessera.operators import joins as J
from tessera.operators import quality as Q
from tessera.operators import security as S
from tessera.operators import series as T
from tessera.operators.filters import Filter, SelectQuery, bind, column_values, from_json, where
from tessera.operators.mapping import MapAggregate, MapColumn, MapFunction, MapGroup, MapInputColumn, MapJoin, MapSort, project
from tessera.sources import readers as R
from tessera.sources import writers as W

# --- sources --------------------------------------------------------------------------------------------------------


@query("row_creator", 'SELECT range AS "RowNumber" FROM range(1, 1001, 3)')
def row_creator(spark, d):
    return R.row_creator(spark, 1, 1000, 3)


@query("memory_reader", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(k, v)")
def memory_reader(spark, d):
    return R.memory(spark, [(1, "a"), (2, "b"), (3, None)], "k int, v string")


@query("json_array_reader", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2::BIGINT, 'y')) t(a, b)")
def json_array_reader(spark, d):
    return R.json_array(spark, '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')


@query("incremental_rows", "SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) * 0.9")
def incremental_rows(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg((F.max("event_id") * 0.9).alias("mark")))).filter("event_id > mark").select("event_id", "user_id")


@query("column_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, d):
    return column_values(table(spark, d, "orders"), "o_orderpriority")


@query("json_stream", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def json_stream(spark, d):
    return W.json_lines(table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("csv_stream", "SELECT n_nationkey || ',' || n_name AS value FROM nation")
def csv_stream(spark, d):
    return W.csv_lines(table(spark, d, "nation").select("n_nationkey", "n_name"))


# --- mappings and filters -------------------------------------------------------------------------------------------


@query("map_columns", "SELECT c_mktsegment, c_custkey AS id, c_name, upper(c_name) AS shout, 7 AS seven, 'run' AS tag FROM customer")
def map_columns(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return project(c, [MapColumn("c_custkey", "id"), MapColumn("c_name"), MapFunction("string.ToUpper", ["c_name"], "shout"), MapColumn(value=7, target="seven"), MapInputColumn("tag", inputs={"tag": "run"})], pass_through=True)


@query("filter_and", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag IN ('A', 'R')")
def filter_and(spark, d):
    return where(table(spark, d, "lineitem"), Filter("l_quantity", ">=", 30), Filter("l_discount", "<", 0.05), Filter("l_returnflag", "in", ["A", "R"])).select("l_orderkey", "l_linenumber")


@query("filter_left_to_right", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 100000")
def filter_left_to_right(spark, d):
    return where(table(spark, d, "orders"), Filter("o_orderstatus", "=", "F"), Filter("o_orderstatus", "=", "P", join="or"), Filter("o_totalprice", ">", 100000)).select("o_orderkey")


@query("filter_json", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11'")
def filter_json(spark, d):
    return where(table(spark, d, "part"), *from_json({"p_size": {"ge": 10, "lt": 20}, "p_brand": {"ne": "Brand#11"}})).select("p_partkey")


@query("filter_parameters", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000 AND s_nationkey = s_nationkey")
def filter_parameters(spark, d):
    return where(table(spark, d, "supplier"), *bind([Filter("s_acctbal", ">", "{least}"), Filter("s_nationkey", "=", other="s_nationkey")], {"least": 1000})).select("s_suppkey")


@query("filter_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1' AND c_mktsegment IS NOT NULL")
def filter_like(spark, d):
    return where(table(spark, d, "customer"), Filter("c_name", "like", "%1"), Filter("c_mktsegment", "not null")).select("c_custkey")


@query("select_query", "SELECT o_orderpriority, count(o_orderkey) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(o_orderkey) > 10 ORDER BY n DESC, 1 LIMIT 3")
def select_query(spark, d):
    q = SelectQuery(filters=[Filter("o_orderstatus", "!=", "P")], groups=["o_orderpriority"], aggregates=[MapAggregate("o_orderkey", "n", "count"), MapAggregate("o_totalprice", "top", "max")], having=[Filter("n", ">", 10)], sorts=[MapSort("n", True), MapSort("o_orderpriority")], rows=3)
    return q.run(table(spark, d, "orders"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_name AS c__c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name")
    return J.join(o, c, [MapJoin("o_custkey", "c_custkey")], missing="filter", alias="c").select("o_orderkey", "c__c_name")


@query("join_left", "SELECT c_custkey, o_orderkey AS o__o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def join_left(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    return J.join(c, o, [MapJoin("c_custkey", "o_custkey")], alias="o", right_filter=F.col("o_totalprice") > 300000).select("c_custkey", "o__o_orderkey")


@query("join_first", "SELECT c_custkey, min(o_orderkey) AS o__o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_first(spark, d):
    return J.join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), [MapJoin("c_custkey", "o_custkey")], duplicates="first", order="o_orderkey", alias="o").select("c_custkey", "o__o_orderkey")


@query("join_last", "SELECT c_custkey, max(o_orderkey) AS o__o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice < 200000 GROUP BY 1")
def join_last(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.join(table(spark, d, "customer").select("c_custkey"), o, [MapJoin("c_custkey", "o_custkey")], missing="filter", duplicates="last", order="o_orderkey", alias="o", condition=lambda a, b: b["o_totalprice"] < 200000).select("c_custkey", "o__o_orderkey")


@query("join_theta", "SELECT a.n_nationkey, b.n_nationkey AS b__n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return J.join(n, n, ["n_regionkey", MapJoin("n_nationkey", "n_nationkey", "<")], missing="filter", alias="b", strategy="hash").select("n_nationkey", "b__n_nationkey")


@query("join_node", "SELECT c_custkey, count(o_orderkey) AS n, sum(o_orderkey) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_node(spark, d):
    out = J.join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey"), [MapJoin("c_custkey", "o_custkey")], node="orders")
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.when(F.size("orders") > 0, F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + x["o_orderkey"])).alias("s"))


@query("join_valid_dates", """WITH p AS (SELECT user_id, ts AS f, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2099-01-01') AS t, event_id FROM events WHERE event_type = 'purchase'),
 q AS (SELECT user_id, ts AS f, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2099-01-01') AS t, event_id FROM events WHERE event_type = 'click')
 SELECT p.event_id AS id, q.event_id AS r__id, CASE WHEN q.event_id IS NULL THEN p.f ELSE greatest(p.f, q.f) END AS f, CASE WHEN q.event_id IS NULL THEN p.t ELSE least(p.t, q.t) END AS t FROM p LEFT JOIN q ON p.user_id = q.user_id AND q.f < p.t AND q.t > p.f""")
def join_valid_dates(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("f"), F.coalesce(F.lead("ts").over(w), F.lit("2099-01-01").cast("timestamp_ntz")).alias("t"))
    return J.valid_dates(side("purchase"), side("click"), ["user_id"], ("f", "t"), ("f", "t"), alias="r").select("id", "r__id", "f", "t")


@query("join_as_of", """SELECT p.event_id, c.ts AS r__ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_as_of(spark, d):
    e = table(spark, d, "events")
    out = J.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("user_id", "ts"), ["user_id"], "ts", "ts", alias="r")
    return out.select("event_id", "r__ts")


@query("join_range", "SELECT p_partkey, lo FROM part JOIN (SELECT range * 100.0 AS lo, range * 100.0 + 37 AS hi FROM range(0, 40)) ON p_retailprice >= lo AND p_retailprice < hi")
def join_range(spark, d):
    r = spark.range(40).select((F.col("id") * 100.0).alias("lo"), (F.col("id") * 100.0 + 37).alias("hi"))
    return J.range_join(table(spark, d, "part"), r, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


@query("join_lookup", "SELECT s_suppkey, n_name AS lookup__n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def join_lookup(spark, d):
    return J.lookup(table(spark, d, "supplier"), table(spark, d, "nation"), [MapJoin("s_nationkey", "n_nationkey")], order="n_nationkey").select("s_suppkey", "lookup__n_name")


@query("join_cross_static", "SELECT r_regionkey, n_nationkey AS n__n_nationkey FROM region, nation WHERE n_regionkey = 1")
def join_cross_static(spark, d):
    return J.join(table(spark, d, "region").select("r_regionkey"), table(spark, d, "nation"), [MapJoin(None, "n_regionkey", left_value=1)], missing="filter", alias="n").select("r_regionkey", "n__n_nationkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, d):
    return J.semi(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, d):
    return J.anti(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("join_full", "SELECT k, s_suppkey, c_custkey FROM (SELECT s_nationkey AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS k, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) USING (k)")
def join_full(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("s_suppkey"))
    return J.outer(a, table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("c_custkey")), ["k"])


# --- groups, windows, sets ------------------------------------------------------------------------------------------


@query("group_aggregates", """SELECT l_returnflag AS flag, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi,
 min_by(l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS first_part, max_by(l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS last_part FROM lineitem GROUP BY 1""")
def group_aggregates(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey"))
    out = G.group(li, [MapGroup("l_returnflag", "flag")], [MapAggregate("l_orderkey", "n", "count"), MapAggregate("l_quantity", "s", "sum"), MapAggregate("l_quantity", "a", "average"), MapAggregate("l_tax", "lo", "min"), MapAggregate("l_tax", "hi", "max"), MapAggregate("l_partkey", "first_part", "first", "o"), MapAggregate("l_partkey", "last_part", "last", "o")])
    return out.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def group_having(spark, d):
    return G.group(table(spark, d, "orders"), ["o_custkey"], [MapAggregate("o_orderkey", "n", "count")], having=[Filter("n", ">=", 12)])


@query("group_empty", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0")
def group_empty(spark, d):
    return G.group(table(spark, d, "orders").filter("o_orderkey < 0"), [], [MapAggregate("o_orderkey", "n", "count")], empty_row=False)


@query("aggregate_rows", "SELECT c_custkey, c_nationkey, count(c_custkey) OVER (PARTITION BY c_nationkey) AS n, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top FROM customer")
def aggregate_rows(spark, d):
    return G.analytic(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [MapAggregate("c_custkey", "n", "count"), MapAggregate("c_acctbal", "top", "max")]).drop("c_acctbal")


@query("group_node", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_node(spark, d):
    out = G.group_node(table(spark, d, "nation"), ["n_regionkey"], "nations", ["n_name"])
    return out.select("n_regionkey", F.size("nations").cast("long").alias("n"), F.array_join(F.transform("nations", lambda s: s["n_name"]), ",").alias("names"))


@query("ungroup_node", 'SELECT n_regionkey, n_name AS "nations.n_name" FROM nation WHERE n_name > \'F\'')
def ungroup_node(spark, d):
    nodes = G.group_node(table(spark, d, "nation"), ["n_regionkey"], "nations", ["n_name"])
    return G.ungroup(G.filter_node(nodes, "nations", lambda s: s["n_name"] > "F").filter(F.size("nations") > 0), "nations")


@query("map_node", "SELECT n_regionkey, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS names FROM nation GROUP BY 1")
def map_node(spark, d):
    nodes = G.group_node(table(spark, d, "nation"), ["n_regionkey"], "names", ["n_name"])
    return G.map_node(nodes, "names", lambda s: F.lower(s["n_name"])).select("n_regionkey", F.array_join(F.array_sort("names"), ",").alias("names"))


@query("rows_generate", "SELECT n_nationkey, unnest(range(0, n_nationkey % 4 + 1)) AS step FROM nation")
def rows_generate(spark, d):
    return G.rows(table(spark, d, "nation").select("n_nationkey"), call("rows.GenerateSequence", F.lit(0), F.col("n_nationkey") % 4), "step").select("n_nationkey", F.col("step").cast("long"))


@query("pivot", "SELECT l_linestatus, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'A') AS \"A\", max_by(l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'N') AS \"N\", max_by(l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def pivot(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.pivot(li, ["l_linestatus"], "l_returnflag", "l_orderkey", ["A", "N", "R"], "o")


@query("unpivot", "SELECT s_suppkey, 'a' AS \"columnName\", s_nationkey::BIGINT AS item FROM supplier UNION ALL SELECT s_suppkey, 'b', s_suppkey FROM supplier")
def unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"))
    return G.unpivot(s, ["s_suppkey"], ["a", "b"])


@query("sort_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top(spark, d):
    return G.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, MapSort("o_totalprice", True), MapSort("o_orderkey"))


@query("top_each", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2")
def top_each(spark, d):
    return G.top_each(table(spark, d, "customer"), ["c_nationkey"], 2, MapSort("c_acctbal", True), MapSort("c_custkey")).select("c_nationkey", "c_custkey")


@query("concatenate", "SELECT n_nationkey AS k, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def concatenate(spark, d):
    return G.concatenate(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("extra")))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return G.intersect(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_subtract", "SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_subtract(spark, d):
    return G.subtract(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("running_global", "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey) AS run, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders")
def running_global(spark, d):
    return G.global_running(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "run", "n").drop("o_custkey")


@query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# --- series ---------------------------------------------------------------------------------------------------------


@query("series_day_fill", """WITH a AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
 b AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM a GROUP BY 1)
 SELECT event_type, day, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM b LEFT JOIN a USING (event_type, day)""")
def series_day_fill(spark, d):
    e = table(spark, d, "events").withColumn("one", F.lit(1))
    return T.series(e, "ts", "day", aggregates=[MapAggregate("one", "n", "count"), MapAggregate("value", "v", "sum")], group=["event_type"], target="day").withColumn("v", F.round("v", 2))


@query("series_week", "SELECT date_trunc('day', ts)::TIMESTAMP - to_days(dayofweek(ts)::INTEGER) AS week, count(*) AS n FROM events GROUP BY 1")
def series_week(spark, d):
    return T.series(table(spark, d, "events").withColumn("one", F.lit(1)), "ts", "week", aggregates=[MapAggregate("one", "n", "count")], fill=False, target="week")


@query("series_number", """WITH a AS (SELECT round_even(p_retailprice / 100, 0)::DOUBLE AS x, count(*) AS n FROM part GROUP BY 1), b AS (SELECT unnest(range(min(x)::BIGINT, max(x)::BIGINT + 1))::DOUBLE AS x FROM a)
 SELECT x, coalesce(n, 0) AS n FROM b LEFT JOIN a USING (x)""")
def series_number(spark, d):
    p = table(spark, d, "part").select((F.col("p_retailprice") / 100).alias("x"), F.lit(1).alias("one"))
    return T.series(p, "x", "number", aggregates=[MapAggregate("one", "n", "count")])


@query("series_project", """WITH a AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT unnest(generate_series(min(m), max(m) + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS m, max(m) AS e FROM a)
 SELECT b.m AS m, coalesce(n, 0) AS n, b.m > e AS is_forecast FROM b LEFT JOIN a ON a.m = b.m""")
def series_project(spark, d):
    o = table(spark, d, "orders").withColumn("one", F.lit(1))
    return T.series(o, "o_orderdate", "month", aggregates=[MapAggregate("one", "n", "count")], project=3, target="m")


@query("series_moving_average", """WITH a AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM orders GROUP BY 1)
 SELECT m, n, round(avg(n) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM a""")
def series_moving_average(spark, d):
    o = T.series(table(spark, d, "orders").withColumn("one", F.lit(1)), "o_orderdate", "month", aggregates=[MapAggregate("one", "n", "count")], target="m")
    return T.moving_average(o, "m", "n", 2).withColumn("moving_average", F.round("moving_average", 6))


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    from tessera.streaming import tumbling

    return tumbling(table(spark, d, "events"), "ts", "1 hour", [F.count("*").alias("n")], ["event_type"]).select(F.col("window_start").cast("timestamp_ntz"), "event_type", "n")


@query("window_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events),
 s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def window_sessions(spark, d):
    from tessera.streaming import sessions

    return sessions(table(spark, d, "events"), "ts", "6 hours", [F.count("*").alias("n")], ["user_id"]).select("user_id", F.col("session_start").cast("timestamp_ntz"), "n")


# --- quality and change capture -------------------------------------------------------------------------------------


@query("validate_rules", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'cleaned' ELSE 'passed' END AS validation_status, 'C' AS operation FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal <= 9000
 UNION ALL SELECT c_custkey, c_acctbal, 'rejected', 'R' FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 9000""")
def validate_rules(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    rules = [Q.Rule("c_acctbal", "validation.MinValue", (0.0,), Q.CLEAN), Q.Rule("c_acctbal", "condition.LessThanOrEqual", (9000.0,), Q.REJECT), Q.Rule("c_mktsegment", lambda x: x != "MACHINERY", (), Q.DISCARD)]
    return Q.validate(c, rules).select("c_custkey", "c_acctbal", "validation_status", "operation")


@query("validate_reject_clean", """SELECT s_suppkey, least(s_acctbal, 5000) AS s_acctbal, CASE WHEN s_acctbal > 5000 THEN 'cleaned' ELSE 'passed' END AS validation_status, 'C' AS operation FROM supplier
 UNION ALL SELECT s_suppkey, s_acctbal, 'rejected-cleaned', 'R' FROM supplier WHERE s_acctbal > 5000""")
def validate_reject_clean(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return Q.validate(s, [Q.Rule("s_acctbal", "validation.MaxValue", (5000.0,), Q.REJECT_CLEAN)]).drop("reject_reason")


@query("validate_types", """SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'rejected' ELSE 'passed' END AS validation_status FROM events""")
def validate_types(spark, d):
    from pyspark.sql import types as Ty

    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return Q.validate(e, target=Ty.StructType([Ty.StructField("k", Ty.IntegerType(), False)])).select("event_id", "validation_status")


@query("profile_summary", """SELECT 0 AS audit_key, 'MaxLength' AS function, 'n_name' AS "column", true AS is_summary, max(length(n_name))::VARCHAR AS value, count(*) AS count FROM nation
 UNION ALL SELECT 0, 'DistinctValues', 'n_regionkey', true, count(DISTINCT n_regionkey)::VARCHAR, count(*) FROM nation UNION ALL SELECT 0, 'Nulls', 'n_name', true, '0.00 %', count(*) FROM nation""")
def profile_summary(spark, d):
    return Q.profile(table(spark, d, "nation"), {"MaxLength": ["n_name"], "DistinctValues": ["n_regionkey"], "Nulls": ["n_name"]}, detail=False)


@query("profile_detail", """SELECT 'DistinctValues' AS function, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY o_orderstatus
 UNION ALL SELECT 'Patterns', regexp_replace(regexp_replace(regexp_replace(o_orderpriority, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g'), count(*) FROM orders GROUP BY 2""")
def profile_detail(spark, d):
    return Q.profile(table(spark, d, "orders"), {"DistinctValues": ["o_orderstatus"], "Patterns": ["o_orderpriority"]}).filter("NOT is_summary").select("function", "value", "count")


def _delta_tables(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = c.filter("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal")))
    stamp = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    old = old.select(F.col("c_custkey").alias("surrogate_key"), "c_custkey", "c_name", "c_acctbal", stamp.alias("valid_from"), F.lit(D.END).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"), F.lit(1).alias("version"), stamp.alias("create_date"), stamp.alias("update_date"))
    return c.filter("c_custkey % 7 <> 0"), old


_OPS = "CASE WHEN c_custkey % 5 = 0 THEN 'C' WHEN c_custkey % 3 = 0 THEN 'U' END"


@query("delta_append_update", f"SELECT c_custkey, {_OPS} AS operation FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 = 0)")
def delta_append_update(spark, d):
    s, t = _delta_tables(spark, d)
    return D.delta(s, t, ["c_custkey"], strategy="append_update", now="2024-01-01 00:00:00").select("c_custkey", "operation")


@query("delta_append_update_delete", f"""SELECT c_custkey, {_OPS} AS operation FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 = 0)
 UNION ALL SELECT c_custkey, 'D' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0""")
def delta_append_update_delete(spark, d):
    s, t = _delta_tables(spark, d)
    return D.delta(s, t, ["c_custkey"], strategy="append_update_delete", now="2024-01-01 00:00:00").select("c_custkey", "operation")


@query("delta_preserve", """SELECT c_custkey, 'C' AS operation, true AS is_current, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END AS version, TIMESTAMP '2024-01-01' AS valid_from, TIMESTAMP '2099-12-31 23:59:59' AS valid_to FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 = 0)
 UNION ALL SELECT c_custkey, 'U', false, 1, TIMESTAMP '2020-01-01', TIMESTAMP '2024-01-01' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, 'U', false, 1, TIMESTAMP '2020-01-01', TIMESTAMP '2024-01-01' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0""")
def delta_preserve(spark, d):
    s, t = _delta_tables(spark, d)
    return D.delta(s, t, ["c_custkey"], strategy="append_update_delete_preserve", now="2024-01-01 00:00:00").select("c_custkey", "operation", "is_current", "version", "valid_from", "valid_to")


@query("delta_reload", "SELECT NULL::BIGINT AS c_custkey, 'T' AS operation UNION ALL SELECT c_custkey, 'C' FROM customer WHERE c_custkey % 7 <> 0")
def delta_reload(spark, d):
    s, t = _delta_tables(spark, d)
    return D.delta(s, t, ["c_custkey"], strategy="reload").select("c_custkey", "operation")


@query("delta_append_keys", "SELECT (SELECT max(c_custkey) FROM customer WHERE c_custkey % 5 <> 0) + row_number() OVER () AS surrogate_key FROM customer WHERE c_custkey % 7 <> 0")
def delta_append_keys(spark, d):
    s, t = _delta_tables(spark, d)
    return D.delta(s, t, ["c_custkey"], strategy="append").select("surrogate_key")


@query("delta_apply", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def delta_apply(spark, d):
    s, t = _delta_tables(spark, d)
    return D.apply(t, D.delta(s, t, ["c_custkey"], strategy="append_update_delete"), "c_custkey").select("c_custkey", "c_acctbal")


@query("delta_reasons", "SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 = 0")
def delta_reasons(spark, d):
    s, t = _delta_tables(spark, d)
    return D.delta(s, t, ["c_custkey"]).filter("update_reason LIKE 'Column c_acctbal source % target %'").select("c_custkey")


@query("secure_mask", "SELECT c_custkey, '(Encrypted)' AS c_name, '(Hidden)' AS c_mktsegment FROM customer")
def secure_mask(spark, d):
    return S.secure(S.flag(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), c_name="strong_encrypt", c_mktsegment="hide"), mode="mask")


@query("secure_round_trip", "SELECT n_nationkey, n_name FROM nation")
def secure_round_trip(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    once = S.secure(S.flag(n, n_name="strong_encrypt"), "key")
    return S.secure(S.flag(once, n_name="strong_decrypt"), "key")


@query("coerce_types", "SELECT n_nationkey, (n_nationkey > 20)::INTEGER AS big, '[' || n_nationkey || ']' AS list FROM nation")
def coerce_types(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") > 20).alias("big"), F.array("n_nationkey").alias("list"))
    return S.coerce(n, arrays=False, booleans=False)


@query("flatten_hierarchy", """WITH RECURSIVE e AS (SELECT n_nationkey AS c, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS p FROM nation), h AS (SELECT c, 0 AS level_depth, c::VARCHAR AS path FROM e WHERE p IS NULL UNION ALL
 SELECT e.c, level_depth + 1, path || '/' || e.c FROM e JOIN h ON e.p = h.c) SELECT * FROM h""")
def flatten_hierarchy(spark, d):
    from tessera.functions.hierarchy import flatten

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 3).cast("int")).alias("p"))
    return flatten(n, "c", "p").select("c", "level_depth", F.array_join("levels", "/").alias("path"))
