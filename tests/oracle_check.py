"""Run registered queries and their SQL on the same tables and compare.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, entry):
    df = entry.queries()[name](spark, sf_dir)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {sum(got[1].values())}"
    res = con.execute(sql)
    want = _bag([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} <> {want[0]}"
    if got[1] != want[1]:
        more, less = got[1] - want[1], want[1] - got[1]
        return False, (f"rows {sum(got[1].values())} <> {sum(want[1].values())}; only Spark {sum(more.values())}: "
                       f"{list(more)[:2]}; only SQL {sum(less.values())}: {list(less)[:2]}")
    return True, f"{sum(got[1].values())} rows equal"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            ok, text = compare(spark, con, sf_dir, name, entry)
        except Exception as e:
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - t:6.1f}s {text}", flush=True)
    print("failed:", failed, "of", len(names))
    spark.stop()
