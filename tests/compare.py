"""Run registered queries next to their SQL and compare values (used by tests and by hand)."""
from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("pressgrid-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return int(f) if f == int(f) and abs(f) < 1e15 else round(f, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


def oracle_rows(sf_dir: str, sql: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def check(spark, sf_dir: str, name: str, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t
    if sql is None:
        return dt, len(got), "rows-only", ""
    cols, want = oracle_rows(sf_dir, sql)
    if sorted(cols) != sorted(df.columns):
        return dt, len(got), "COLUMNS", f"{sorted(df.columns)} vs {sorted(cols)}"
    gi = [df.columns.index(c) for c in sorted(cols)]
    wi = [cols.index(c) for c in sorted(cols)]
    a = Counter(tuple(canon(r[i]) for i in gi) for r in got)
    b = Counter(tuple(canon(r[i]) for i in wi) for r in want)
    if a == b:
        return dt, len(got), "ok", ""
    return dt, len(got), "DIFF", f"{sorted(cols)} spark-only {list((a - b).items())[:3]} sql-only {list((b - a).items())[:3]} n={len(got)}/{len(want)}"


if __name__ == "__main__":
    import __spark_entry__ as E
    sf = os.environ.get("SF", "0.01")
    names = sys.argv[1:]
    q, o = E.queries(), E.oracle_sql()
    spark = session()
    bad = 0
    for n in q:
        if names and not any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names):
            continue
        try:
            dt, rows, status, detail = check(spark, f"/root/testdata/sf{sf}", n, q[n], o.get(n))
        except Exception as exc:
            dt, rows, status, detail = 0, 0, "ERROR", str(exc)[:900]
        bad += status not in ("ok", "rows-only")
        print(f"{n:34s} {status:9s} {rows:7d} rows {dt:6.2f}s {detail[:1500]}", flush=True)
    print("bad:", bad)
