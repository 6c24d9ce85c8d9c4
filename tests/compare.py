"""Runs registered queries next to their SQL equivalents in DuckDB and compares rows."""

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name, f, sql, sf_dir):
    """None, or what differs."""
    df = f(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    a, b = normal(got, df.columns), normal(want, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(os.environ.get("COMPARE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con, oracles, queries = connect(sf_dir), entry.oracle_sql(), entry.queries()
    for name in queries:
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracles[name], sf_dir) if name in oracles else f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:
            said = "ERROR " + str(e)[:600]
        print(f"@@ {name} {time.time() - t:.1f} s {said or 'equal'}", flush=True)
