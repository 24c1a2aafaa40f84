"""Queries of aggregates, windows, series functions, generators, learning and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import call as f
from tessera.functions import get

C = F.col


@query("fn_aggregates", """SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS s, round(avg(l_tax), 8) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) FILTER (l_linestatus = 'F') AS t, count(*) FILTER (l_linestatus <> 'F') AS fa,
 count(*) FILTER (l_returnflag = l_linestatus) AS e, count(DISTINCT l_partkey) AS d, median(l_quantity) AS m, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, min_by(l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) FILTER (l_linestatus = 'F') AS fw,
 max_by(l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) FILTER (l_linestatus = 'F') AS lw FROM lineitem GROUP BY 1""")
def fn_aggregates(spark, d):
    o = (C("l_orderkey") * 10 + C("l_linenumber")) * 100000 + C("l_partkey")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        f("aggregate.Count").alias("n"), F.round(f("aggregate.Sum", C("l_tax")), 4).alias("s"), F.round(f("aggregate.Average", C("l_tax")), 8).alias("a"), f("aggregate.Min", C("l_quantity")).alias("lo"), f("aggregate.Max", C("l_quantity")).alias("hi"),
        f("aggregate.CountTrue", C("l_linestatus") == "F").alias("t"), f("aggregate.CountFalse", C("l_linestatus") == "F").alias("fa"), f("aggregate.CountEqual", C("l_returnflag"), C("l_linestatus")).alias("e"), f("aggregate.CountDistinct", C("l_partkey")).alias("d"),
        f("aggregate.Median", C("l_quantity")).alias("m"), F.round(f("aggregate.StdDev", C("l_quantity")), 6).alias("sd"), F.round(f("aggregate.Variance", C("l_quantity")), 6).alias("v"), f("aggregate.FirstWhen", C("l_linestatus") == "F", C("l_partkey"), o).alias("fw"),
        f("aggregate.LastWhen", C("l_linestatus") == "F", C("l_partkey"), o).alias("lw"),
    )


@query("fn_concat_aggregate", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS keys, min(n_nationkey) AS first, max(n_nationkey) AS last FROM nation GROUP BY 1")
def fn_concat_aggregate(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(f("aggregate.ConcatAgg", C("n_name"), ";").alias("names"), F.array_join(f("aggregate.CreateArray", C("n_nationkey")), ",").alias("keys"), f("aggregate.First", C("n_nationkey"), C("n_nationkey")).alias("first"), f("aggregate.Last", C("n_nationkey"), C("n_nationkey")).alias("last"))


@query("fn_pivot_columns", "SELECT l_linestatus, max_by(l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) FILTER (l_returnflag = 'A') AS \"A\", max_by(l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def fn_pivot_columns(spark, d):
    o = (C("l_orderkey") * 10 + C("l_linenumber")) * 100000 + C("l_partkey")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(f("aggregate.PivotToColumns", C("l_returnflag"), C("l_partkey"), o, ["A", "R"]).alias("p")).select("l_linestatus", "p.*")


@query("fn_geometry_aggregates", "SELECT n_regionkey, count(*)::INTEGER AS points, (count(*) + 1)::INTEGER AS ring FROM nation GROUP BY 1")
def fn_geometry_aggregates(spark, d):
    n = table(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.size(f("geometry.CreateLineString", C("n_nationkey"), C("n_regionkey"), order=C("n_nationkey"))).alias("points"), F.size(f("geometry.CreatePolygon", C("n_nationkey"), C("n_regionkey"), order=C("n_nationkey"))).alias("ring"))


@query("fn_geometry_rows", "SELECT n_regionkey, n_nationkey::DOUBLE AS x FROM nation")
def fn_geometry_rows(spark, d):
    lines = table(spark, d, "nation").groupBy("n_regionkey").agg(f("geometry.CreateMultiPointXYZ", C("n_nationkey"), C("n_regionkey")).alias("g"))
    return lines.select("n_regionkey", f("geometry.ExtractMultiPoint", C("g")).alias("p")).select("n_regionkey", "p.x")


@query("fn_analytic", """SELECT c_custkey, round(c_custkey * 100.0::DOUBLE / sum(c_custkey) OVER (PARTITION BY c_nationkey), 8) AS pct, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk,
 round(avg(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS ma, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ms FROM customer""")
def fn_analytic(spark, d):
    g = {"group": ["c_nationkey"]}
    return table(spark, d, "customer").select("c_custkey", F.round(f("analytic.PercentTotal", C("c_custkey"), percent=True, **g), 8).alias("pct"), f("analytic.Rank", C("c_mktsegment"), **g).cast("long").alias("rk"),
        F.round(f("analytic.MovingAverage", C("c_acctbal"), "c_custkey", 3, 1, **g), 4).alias("ma"), F.round(f("analytic.MovingSum", C("c_acctbal"), "c_custkey", 3, **g), 2).alias("ms"))


_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"


@query("fn_row_cache", f"""SELECT o_orderkey, lag(o_totalprice, 1) {_W}) AS p, row_number() {_W}) AS n, round(sum(o_totalprice) {_W}), 2) AS rs, round(avg(o_totalprice) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS ra,
 round(coalesce(o_totalprice - lag(o_totalprice) {_W}), 0), 2) AS ch, round(coalesce(o_totalprice / lag(o_totalprice) {_W}), 0), 6) AS rt, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) {_W}) AS ff FROM orders""")
def fn_row_cache(spark, d):
    g = {"group": ["o_custkey"]}
    return table(spark, d, "orders").select(
        "o_orderkey", f("row.PreviousGroupRow", C("o_totalprice"), "o_orderkey", **g).alias("p"), f("row.GroupRowNumber", "o_orderkey", **g).cast("long").alias("n"), F.round(f("row.RunningGroupSum", C("o_totalprice"), "o_orderkey", **g), 2).alias("rs"),
        F.round(f("row.RunningGroupAverage", C("o_totalprice"), "o_orderkey", 3, **g), 4).alias("ra"), F.round(f("row.PreviousGroupRowChange", C("o_totalprice"), "o_orderkey", **g), 2).alias("ch"), F.round(f("row.PreviousGroupRowRatio", C("o_totalprice"), "o_orderkey", **g), 6).alias("rt"),
        f("row.PreviousGroupRowIfNull", F.when(C("o_orderstatus") == "F", C("o_orderkey")), "o_orderkey", **g).alias("ff"),
    )


@query("fn_row_cache_global", "SELECT n_nationkey, lag(n_nationkey, 2) OVER (ORDER BY n_nationkey) AS p, row_number() OVER (ORDER BY n_nationkey) AS n, sum(n_regionkey) OVER (ORDER BY n_nationkey)::BIGINT AS s, coalesce(n_regionkey - lag(n_regionkey) OVER (ORDER BY n_nationkey), 0) AS c FROM nation")
def fn_row_cache_global(spark, d):
    return table(spark, d, "nation").select("n_nationkey", f("row.PreviousRow", C("n_nationkey"), "n_nationkey", 2).alias("p"), f("row.RowNumber", "n_nationkey").cast("long").alias("n"), f("row.RunningSum", C("n_regionkey"), "n_nationkey").alias("s"), f("row.PreviousRowChange", C("n_regionkey"), "n_nationkey").alias("c"))


@query("fn_series", """WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM orders GROUP BY 1)
 SELECT m, round(avg(n) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma, lag(n) OVER (ORDER BY m) AS pv, (SELECT max(b.m) FROM m b WHERE b.m < m.m AND b.n > m.n) AS hs, (SELECT max(b.m) FROM m b WHERE b.m < m.m AND b.n < m.n) AS ls FROM m""")
def fn_series(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(F.count("*").alias("n"))
    return m.select("m", F.round(f("series.MovingSeriesAverage", "m", C("n"), 2), 6).alias("ma"), f("series.PreviousSeriesValue", "m", C("n"))["value"].alias("pv"), f("series.HighestSince", "m", C("n"))["series"].alias("hs"), f("series.LowestSince", "m", C("n"))["series"].alias("ls"))


@query("fn_generate_rows", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS item FROM nation")
def fn_generate_rows(spark, d):
    return table(spark, d, "nation").select("n_nationkey", f("rows.SplitColumnToRows", "A", C("n_name")).alias("item"))


@query("fn_generate_dates", "SELECT n_nationkey, unnest(generate_series(DATE '2020-01-01', DATE '2020-01-01' + n_regionkey::INTEGER, INTERVAL 1 DAY))::DATE AS day FROM nation")
def fn_generate_dates(spark, d):
    start = F.lit("2020-01-01").cast("date")
    return table(spark, d, "nation").select("n_nationkey", f("rows.GenerateDateSequence", start, F.date_add(start, C("n_regionkey").cast("int"))).alias("day")).withColumn("day", C("day").cast("date"))


@query("fn_json_rows", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")
def fn_json_rows(spark, d):
    return table(spark, d, "events").select("event_id", f("rows.JsonPivotElementToRows", C("props"), None).alias("name", "value"))


@query("fn_columns_to_rows", "SELECT n_nationkey, 'n_nationkey' AS \"columnName\", n_nationkey AS item FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey FROM nation")
def fn_columns_to_rows(spark, d):
    return table(spark, d, "nation").select("n_nationkey", f("rows.ColumnsToRows", "n_nationkey", "n_regionkey"))


@query("fn_json_elements", "SELECT n_nationkey, unnest(['1', '2', n_regionkey::VARCHAR]) AS item FROM nation")
def fn_json_elements(spark, d):
    j = F.concat(F.lit('{"a":[1,2,'), C("n_regionkey"), F.lit("]}"))
    return table(spark, d, "nation").select("n_nationkey", f("rows.JsonElementsToRows", j, "a").alias("item"))


@query("fn_xpath_rows", "SELECT n_nationkey, unnest(['x', n_name]) AS node FROM nation")
def fn_xpath_rows(spark, d):
    x = F.concat(F.lit("<r><b>x</b><b>"), C("n_name"), F.lit("</b></r>"))
    return table(spark, d, "nation").select("n_nationkey", f("rows.XPathNodesToRows", x, "r/b").alias("node"))


@query("fn_linear_regression", """WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*)::DOUBLE AS n FROM orders GROUP BY 1), i AS (SELECT m, n, (row_number() OVER (ORDER BY m) - 1)::DOUBLE AS x FROM m)
 SELECT m, n, round((SELECT regr_intercept(n, x) FROM i) + (SELECT regr_slope(n, x) FROM i) * x, 6) AS fit FROM i""")
def fn_linear_regression(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(F.count("*").cast("double").alias("n"))
    return get("curve.LinearRegression").build(m, "m", "n").select("m", "n", F.round("fit", 6).alias("fit"))


@query("fn_estimates", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS stddev FROM customer GROUP BY 1")
def fn_estimates(spark, d):
    out = table(spark, d, "customer").groupBy("c_nationkey").agg(f("distribution.NormalDistributionEstimate", C("c_acctbal")).alias("e"))
    return out.select("c_nationkey", F.round("e.mean", 4).alias("mean"), F.round("e.stddev", 4).alias("stddev"))


@query("fn_npv", "SELECT c_nationkey, round(sum(c_acctbal / pow(1.1::DOUBLE, i)), 4) AS npv FROM (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) GROUP BY 1")
def fn_npv(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(f("financial.Npv", 0.1, C("c_acctbal"), C("c_custkey")), 4).alias("npv"))


@query("fn_irr")
def fn_irr(spark, d):
    flows = table(spark, d, "customer").withColumn("v", F.when(C("c_custkey") % 5 == 0, -1000.0).otherwise(F.abs("c_acctbal") / 10))
    return flows.groupBy("c_nationkey").agg(f("financial.Irr", C("v"), C("c_custkey")).alias("irr"))


@query("ml_kmeans")
def ml_kmeans(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return get("ml.ClusteringKMeansRun").build(p, ["p_size", "p_retailprice"], k=3).select("p_partkey", "prediction")


@query("ml_regression")
def ml_regression(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    model = get("ml.RegressionSdcaTrain").build(li, "l_extendedprice", ["l_quantity", "l_discount"])
    return get("ml.RegressionPredict").build(model, li).select("l_orderkey", "l_linenumber", "prediction")


@query("ml_forecast")
def ml_forecast(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(F.count("*").cast("double").alias("n"))
    ahead = m.agg(F.max("m").alias("top")).select(F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i"), "top").select((C("top") + F.make_ym_interval(F.lit(0), C("i"))).alias("m"), F.lit(None).cast("double").alias("n"), F.lit(True).alias("is_forecast"))
    return get("ml.ForecastTimeSeries").build(m.withColumn("is_forecast", F.lit(False)).unionByName(ahead), "m", "n")


@query("ml_spikes")
def ml_spikes(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.sum("value").alias("v"))
    return get("ml.SpikeDetection").build(h, "day", "v", ["event_type"])


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_tumbling(spark, d):
    """The events as a stream of files, folded by day into a table of its own."""
    import uuid

    from tessera import streaming

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    name = "stream_" + uuid.uuid4().hex
    src = streaming.files(spark, path.replace("events.parquet", "event[s].parquet"), schema).withColumn("ts", F.col("ts").cast("timestamp"))
    day = src.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"))
    q = day.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# --- shapes, times, positions, profiles, models -------------------------------------------------------------------------


@query("fn_geometry_shapes", "SELECT kind, n_regionkey, n_nationkey::DOUBLE AS x FROM nation, (SELECT unnest(['line', 'polygon', 'collection']) AS kind)")
def fn_geometry_shapes(spark, d):
    """Points made into lines or rings, these into collections, and all taken apart again."""
    n = table(spark, d, "nation").groupBy("n_regionkey", "n_nationkey")
    args = (C("n_nationkey"), C("n_regionkey"))

    def back(kind, shape, many, apart, inner):
        each = n.agg(f(f"geometry.{shape}", *args).alias("g")).groupBy("n_regionkey").agg(f(f"geometry.{many}", C("g")).alias("all"))
        shapes = each.select("n_regionkey", f(f"geometry.{apart}", C("all")).alias("g"))
        return shapes.select("n_regionkey", f(f"geometry.{inner}", C("g")).alias("p")).select(F.lit(kind).alias("kind"), "n_regionkey", "p.x")

    lines = back("line", "CreateLineString", "CreateMultiLineString", "ExtractMultiLinePoint", "ExtractLineString")
    rings = back("polygon", "CreatePolygon", "CreateMultiPolygon", "ExtractMultiPolygon", "ExtractPolygon")
    return lines.union(rings).union(back("collection", "CreateMultiPointXYZ", "CreateGeometryCollection", "ExtractGeometryCollection", "ExtractMultiPoint"))


@query("fn_times", """SELECT o_orderkey, epoch(TIMESTAMP '2020-02-03 04:05:06')::BIGINT - 3600 * (o_custkey % 10) AS instant, '+0' || (o_custkey % 10) || ':00' AS "offset", TIMESTAMP '2020-02-03' AS exact, o_orderdate::TIMESTAMP - INTERVAL 2 HOUR AS earlier,
 date_trunc('day', o_orderdate)::TIMESTAMP AS midnight, o_orderdate::TIMESTAMP AS sum, true AS now, 1990 + (year(o_orderdate) * 12 + month(o_orderdate) - 1990 * 12 - 7) // 12 AS fiscal_year, ((month(o_orderdate) + 5) % 12 // 3 + 1)::INTEGER AS fiscal_quarter,
 ((month(o_orderdate) + 5) % 12 + 1)::INTEGER AS fiscal_month FROM orders""")
def fn_times(spark, d):
    o = table(spark, d, "orders").withColumn("at", C("o_orderdate").cast("timestamp_ntz"))
    text = F.concat(F.lit("2020-02-03T04:05:06+0"), C("o_custkey") % 10, F.lit(":00"))
    start = F.lit("1990-01-01 06:00:00").cast("timestamp_ntz")
    fiscal = f("date.FiscalDateComponents", F.to_date("o_orderdate"), F.lit("1990-07-01"), "calendar")
    midnight = C("at") - f("date.TimeOnly", C("at"))
    gap = f("date.TimeBetweenTimes", f("date.TimeOnly", start), f("date.TimeOnly", C("at")))
    utc = F.abs(F.unix_timestamp(f("date.DateTimeNowUtc")) - F.unix_timestamp(F.to_timestamp(f("date.DateNowUtc")))) <= 86400
    now = utc & (f("date.TimeNow") >= F.expr("INTERVAL '0' DAY")) & (C("at") - gap - F.expr("INTERVAL '6' HOUR") == midnight)
    return o.select(
        "o_orderkey", F.unix_timestamp(f("date.ToDateOffset", text)["instant"]).alias("instant"), f("date.ToDateOffset", text)["offset"].alias("offset"), f("date.ToDateOffsetExact", F.lit("03/02/2020"), "dd/MM/yyyy")["instant"].cast("timestamp_ntz").alias("exact"),
        f("date.ToDateOffsetHour", C("at"), 2).cast("timestamp_ntz").alias("earlier"), midnight.alias("midnight"), (start + f("date.TimeBetweenDates", start, C("at"))).alias("sum"), now.alias("now"),
        fiscal["year"].cast("long").alias("fiscal_year"), fiscal["quarter"].alias("fiscal_quarter"), fiscal["month"].alias("fiscal_month"),
    )


@query("fn_row_cache_filled", """SELECT n_nationkey, last_value(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END IGNORE NULLS) OVER (ORDER BY n_nationkey) AS filled, round(avg(n_regionkey) OVER (ORDER BY n_nationkey), 6) AS mean,
 round(coalesce(n_regionkey / nullif(lag(n_regionkey) OVER (ORDER BY n_nationkey), 0), 0), 6)::DOUBLE AS ratio FROM nation""")
def fn_row_cache_filled(spark, d):
    """Over the 25 nations without a group, for which one task is enough."""
    return table(spark, d, "nation").select(
        "n_nationkey", f("row.PreviousRowIfNull", F.when(C("n_nationkey") % 3 == 0, C("n_nationkey")), "n_nationkey").alias("filled"), F.round(f("row.RunningAverage", C("n_regionkey"), "n_nationkey"), 6).alias("mean"),
        F.round(f("row.PreviousRowRatio", C("n_regionkey").cast("double"), "n_nationkey"), 6).alias("ratio"),
    )


@query("fn_series_filled", """WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, nullif(count(*) % 2, 0) * count(*) AS n FROM orders GROUP BY 1)
 SELECT m, last_value(n IGNORE NULLS) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_odd FROM m""")
def fn_series_filled(spark, d):
    n = F.count("*")
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(F.when(n % 2 == 1, n).alias("n"))
    return m.select("m", f("series.PreviousSeriesValueNull", "m", C("n"))["value"].alias("last_odd"))


@query("fn_profiles", """SELECT 'BestDataType' AS function, 'c_custkey' AS "column", 'Int64' AS value UNION ALL SELECT 'BestDataType', 'c_name', 'String' UNION ALL SELECT 'Blanks', 'c_name', printf('%.2f %%', 100.0 * count(*) FILTER (c_name = '') / count(*)) FROM customer
 UNION ALL SELECT 'Zeros', 'c_nationkey', printf('%.2f %%', 100.0 * count(*) FILTER (c_nationkey = 0) / count(*)) FROM customer UNION ALL SELECT 'MaxValue', 'c_custkey', max(c_custkey)::DOUBLE::VARCHAR FROM customer""")
def fn_profiles(spark, d):
    from tessera.operators import quality

    wanted = {"BestDataType": ["c_custkey", "c_name"], "Blanks": ["c_name"], "Zeros": ["c_nationkey"], "MaxValue": ["c_custkey"]}
    return quality.profile(table(spark, d, "customer"), wanted, detail=False).select("function", "column", "value")


@query("ml_clusters", "SELECT p_size % 2 AS side, count(*) AS n, 1::BIGINT AS run, 1::BIGINT AS trained FROM part GROUP BY 1")
def ml_clusters(spark, d):
    """Two groups far apart: each is one cluster, by a run at once and by a model that is trained and then applied."""
    p = table(spark, d, "part").select("p_partkey", (C("p_size") % 2).alias("side"), (C("p_size") % 2 * 1000 + C("p_size") / 100).alias("x"), (C("p_size") / 50).alias("y"))
    run = get("ml.ClusteringKMeansRun").build(p, ["x", "y"], k=2).select("p_partkey", "side", C("prediction").alias("run"))
    model = get("ml.ClusteringKMeansTrain").build(p, ["x", "y"], 2)
    trained = get("ml.ClusteringKMeansPredict").build(model, p).select("p_partkey", C("prediction").alias("trained"))
    return run.join(trained, "p_partkey").groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("run").alias("run"), F.count_distinct("trained").alias("trained"))


@query("ml_line", "SELECT p_partkey, round(3 * p_size + 0.5 * p_retailprice + 7, 2) AS worth FROM part")
def ml_line(spark, d):
    """Values on a plane, which a linear model gives back."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (3 * C("p_size") + 0.5 * C("p_retailprice") + 7).alias("worth"))
    model = get("ml.RegressionSdcaTrain").build(p, "worth", ["p_size", "p_retailprice"])
    return get("ml.RegressionPredict").build(model, p.drop("worth")).select("p_partkey", F.round("prediction", 2).alias("worth"))
