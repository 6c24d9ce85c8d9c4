"""Queries over files that Spark writes from the tables and reads again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import r6 as R
from tickloom.operators import ledger as LG
from tickloom.operators import radar as RD
from tickloom.plans import radar as _radar  # noqa: F401  its common table expressions are used below
from tickloom.plans.ledger import events
from tickloom.plans.registry import query
from tickloom.plans.sqltext import r6, sql
from tickloom.plans.validation import records
from tickloom.sources import artifacts as A
from tickloom.sources import bars as B
from tickloom.sources.storage import shared_folder, stored

SHOWN = "symbol, horizon, dt, position, entry_dt, exit_dt"
SPOILT = "symbol LIKE '%-USD' AND position = -1"


@query(
    sql(
        f"""SELECT symbol, CAST(horizon AS DOUBLE) AS horizon, CASE WHEN symbol LIKE '^%' THEN NULL ELSE dt END AS dt, CASE WHEN {SPOILT} THEN NULL ELSE CAST(position AS DOUBLE) END AS position, entry_dt, exit_dt, {r6('ret', 'ret')} FROM records""",
        "records",
    )
)
def s04_records_scan(spark, sf):
    """A file of texts with broken dates and numbers, read with types."""
    path = shared_folder(spark, "records")
    rows = records(spark, sf).select("symbol", "horizon", F.when(F.col("symbol").startswith("^"), "soon").otherwise(F.concat(F.col("dt").cast("string"), F.lit("T00:00:00"))).alias("dt"), F.when(F.expr(SPOILT), "n/a").otherwise(F.col("position").cast("string")).alias("position"), "entry_dt", "exit_dt", "ret")
    rows.write.option("header", True).csv(path)
    return A.read_records(spark, path).select(*SHOWN.split(", "), R("ret").alias("ret"))


@query(sql("SELECT horizon, count(*) AS n FROM records WHERE position <> 0 GROUP BY horizon", "records"))
def s05_s07_newest_run(spark, sf):
    """Runs of several files are written, the second of active rows only, a third that was never finished; the newest finished one is read whole."""
    root, rows = shared_folder(spark, "runs"), stored(records(spark, sf).select("symbol", "horizon", "dt", "position"), "rows")
    A.write_run({"records": rows.repartition(3, "dt")}, root, "r1")
    A.write_run({"records": rows.where("position <> 0").repartition(3, "dt")}, root, "r2")
    rows.write.option("header", True).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).csv(f"{root}/records/run_id=r3")
    return A.read_records(spark, A.newest_run(spark, f"{root}/records")).groupBy(F.col("horizon").cast("int").alias("horizon")).agg(F.count("*").alias("n"))


@query(sql("SELECT 'records' AS artifact, 'r1' AS run_id, count(*) AS n_rows FROM records UNION ALL SELECT 'active', 'r1', count(*) FROM records WHERE position <> 0", "records"))
def s08_run_manifest(spark, sf):
    root, rows = shared_folder(spark, "runs"), stored(records(spark, sf).select("symbol", "horizon", "dt", "position"), "rows")
    A.write_run({"records": rows, "active": rows.where("position <> 0")}, root, "r1", rows.groupBy("horizon").count())
    return spark.read.json(f"{root}/manifest").select("artifact", "run_id", "n_rows")


@query(sql(f"SELECT ledger_id, seq, event_type, event_date, signal_id, entry_date, exit_date, {r6('strategy_return', 'strategy_return')} FROM events_l", "events_l"))
def s10_ledger_scan(spark, sf):
    path = shared_folder(spark, "ledger")
    events(spark, sf).write.json(path)
    return A.read_ledger(spark, path).select("ledger_id", "seq", "event_type", "event_date", "signal_id", "entry_date", "exit_date", R("strategy_return").alias("strategy_return"))


@query(sql(f"SELECT CAST(horizon AS VARCHAR) AS snapshot_id, 'complete' AS status, symbol, horizon, mode, {r6('deep_score', 'deep_score')} FROM fast", "fast"))
def s11_snapshot_records(spark, sf):
    """A snapshot is a document of one row for each instrument; here one for each horizon."""
    path = shared_folder(spark, "snapshots")
    rows = RD.fast_scan(B.brand_bars(spark, sf)).select("symbol", "horizon", "mode", "deep_score")
    rows.groupBy(F.col("horizon").cast("string").alias("snapshot_id")).agg(F.lit("complete").alias("status"), F.collect_list(F.struct("symbol", "horizon", "mode", "deep_score")).alias("records")).write.json(path)
    schema = "snapshot_id string, status string, records array<struct<symbol: string, horizon: int, mode: string, deep_score: double>>"
    return A.explode_snapshots(spark.read.schema(schema).json(path)).select("snapshot_id", "status", "symbol", "horizon", "mode", R("deep_score").alias("deep_score"))


#: Snapshots made of the events: a document's age and faults follow from its event.
NOW = "2024-01-20 00:00:00"
CASES = [
    "event_id % 7 AS fault",
    "CASE WHEN event_id % 7 = 1 THEN 'partial' ELSE 'complete' END AS status",
    "CASE WHEN event_id % 7 = 2 THEN 7 ELSE 8 END AS schema_version",
    "CASE WHEN event_id % 7 = 3 THEN 2 ELSE 3 END AS n_horizons",
    "CASE WHEN event_id % 7 = 4 THEN 'INVALID' ELSE 'COMPLETE' END AS coverage",
    "CASE WHEN event_id % 7 = 5 THEN 1 ELSE 0 END AS bad_records",
]


@query(
    f"""SELECT event_id AS snapshot_id, CASE WHEN fault = 1 THEN 'STATUS' WHEN fault = 2 THEN 'SCHEMA' WHEN fault = 4 THEN 'COVERAGE' WHEN fault = 3 THEN 'HORIZONS' WHEN fault = 5 THEN 'RECORDS'
    WHEN fault = 6 THEN 'NO_TIME' WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'AGE' ELSE 'FRESH' END AS verdict FROM (SELECT event_id, ts, event_id % 7 AS fault FROM events)"""
)
def l11_snapshot_staleness(spark, sf):
    rows = B.table(spark, sf, "events").selectExpr("event_id AS snapshot_id", "ts", *CASES)
    rows = rows.withColumn("updated_at", F.when(F.col("fault") != 6, F.col("ts").cast("timestamp")))
    return LG.staleness(rows, F.lit(NOW).cast("timestamp"), hours=6).select("snapshot_id", "verdict")

