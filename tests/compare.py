"""Run registered queries against their oracle texts: ``python tests/compare.py DIR [name ...]``."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("spanquarry-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, build, sql):
    t0 = time.time()
    df = build(spark, sf_dir)
    left = table_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    right = table_of(cols, cur.fetchall())
    t2 = time.time()
    types = {c: t for c, t in df.dtypes}
    problems = []
    if left[0] != right[0]:
        problems.append(f"columns {left[0]} != {right[0]}")
    elif len(left[1]) != len(right[1]):
        problems.append(f"rows {len(left[1])} != {len(right[1])}")
    if not problems:
        bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        if bad:
            only = sorted(set(left[1]) - set(right[1]))[:3], sorted(set(right[1]) - set(left[1]))[:3]; problems.append(f"{len(bad)} of {len(left[1])} rows differ: {left[0]} spark-only {only[0]} sql-only {only[1]}")
    elif left[0] == right[0]:
        extra = sorted(set(left[1]) - set(right[1]))[:2], sorted(set(right[1]) - set(left[1]))[:2]
        problems.append(f"{left[0]} spark-only {extra[0]} sql-only {extra[1]}")
    return problems, len(left[1]), t1 - t0, t2 - t1, types


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = session()
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name, build in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            if name in sqls:
                problems, n, a, b, _ = compare(spark, sf_dir, name, build, sqls[name])
            else:
                t0 = time.time()
                n, problems = build(spark, sf_dir).count(), []
                a, b = time.time() - t0, 0
        except Exception as exc:  # noqa: BLE001
            problems, n, a, b = [str(exc)[:1500]], 0, 0, 0
        mark = "FAIL" if problems else ("ok" if name in sqls else "rows")
        print(f"\n{mark:5}{name:34} rows={n:<7} spark={a:.1f}s sql={b:.1f}s", *problems, flush=True)
        if problems:
            failed.append(name)
        if not n:
            print("     EMPTY", name)
    print("failed:", failed)
