"""Compares registered queries with their SQL in DuckDB; `python tests/compare.py [sf] [name...]`."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 53 else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def compare(spark, con, name, q, sql, d):
    """None, or what differs."""
    df = q(spark, d)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {got[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)} of {len(got)} rows: " + ", ".join(f"{c}: {x} / {y}" for c, x, y in zip(cols, a, b, strict=True) if x != y)[:400]
    return None


def connect(d):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    d = f"{DATA}/{sf}"
    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, failed = connect(d), E.oracle_sql(), 0
    for name, q in E.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        if name not in oracles:
            if args:
                print(name, "no SQL; rows", q(spark, d).count())
            continue
        t = time.time()
        try:
            why = compare(spark, con, name, q, oracles[name], d)
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:500]}"
        failed += why is not None
        if why or args:
            print(name, why or "ok", f"{time.time() - t:.1f}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
