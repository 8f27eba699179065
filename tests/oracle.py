"""Compares queries with their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(name="tests"):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName(name)
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
    spark = b.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, query, sql, sf_dir):
    """The first difference, or nothing."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    theirs = rows(cols, res.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{sorted(cols)}: {a} and {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e

    sf, names = sys.argv[1], sys.argv[2:]
    q, o, spark, bad = e.queries(), e.oracle_sql(), session(), 0
    for n in names or list(q):
        t = time.time()
        try:
            said = compare(spark, q[n], o[n], sf) if n in o else f"no SQL, {q[n](spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"FAILED {type(x).__name__}: {str(x)[:1500]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{n}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("bad:", bad)
