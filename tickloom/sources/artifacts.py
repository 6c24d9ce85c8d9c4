"""Records, ledgers and snapshots as files: typed scans of text, sinks by run, the newest run of several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a records file by type; what can't be read as its type is null.
DATES = ("dt", "entry_dt", "exit_dt")
NUMBERS = ("horizon", "fold", "position", "entry_price", "exit_price", "ret", "cost", "buy_hold_return", "actual_up", "execution_up", "probability_up", "expected_return")
EVENT = "ledger_id string, seq int, event_type string, event_date date, signal_id string, symbol string, entry_date date, entry_price double, exit_date date, exit_price double, strategy_return double"


def typed_records(raw: DataFrame) -> DataFrame:
    """raw, a frame of texts, with dates cut to days and numbers coerced; other columns stay as they are."""
    dates = {c: F.expr(f"try_cast(substring(`{c}`, 1, 10) AS date)") for c in DATES if c in raw.columns}
    return raw.withColumns(dates | {c: F.expr(f"try_cast(`{c}` AS double)") for c in NUMBERS if c in raw.columns})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return typed_records(spark.read.option("header", True).csv(path))


def newest_run(spark: SparkSession, folder: str) -> str | None:
    """Path of the newest finished run below folder, all parts of it; of equally new ones the last by name.

    A run is finished once its writer has left its marker, `_SUCCESS`; the markers' times decide. Only file listings are read.
    """
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = paths.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = files.globStatus(paths.Path(f"{folder}/*/_SUCCESS")) or []
    found = [(m.getModificationTime(), m.getPath().getParent().toString()) for m in marks]
    return max(found)[1] if found else None


def write_run(tables: dict[str, DataFrame], root: str, run_id: str, report: DataFrame | None = None) -> None:
    """Each table as CSV in a folder of its own by run, never over an earlier one, the report as JSON, and one line on the run's log."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("errorifexists").option("header", True).csv(f"{root}/{name}/run_id={run_id}")
    if report is not None:
        report.write.mode("errorifexists").json(f"{root}/report/run_id={run_id}")
    # counted from what was written, so that the log tells what is there
    counts = [spark.read.option("header", True).csv(f"{root}/{name}/run_id={run_id}").agg(F.lit(name).alias("artifact"), F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns])).alias("checksum")) for name, table in tables.items()]
    log = counts[0]
    for c in counts[1:]:
        log = log.unionByName(c)
    log.withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{root}/manifest")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON Lines ledger; their order is the column seq, never that of the files. Lines that can't be read are an error."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def explode_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row for each record of each snapshot."""
    return snapshots.select("snapshot_id", "status", F.explode("records").alias("r")).select("snapshot_id", "status", "r.*")
