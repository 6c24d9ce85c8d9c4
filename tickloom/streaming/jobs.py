"""Structured Streaming forms of the bar builder, momentum windows, sessions and dedup; jobs that drain a stream, and tables that it refreshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import calendars
from tickloom.sources.storage import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; times as instants, which watermarks need."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    order = F.struct("ts", "event_id")
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")
    )


def sliding_momentum(stream: DataFrame, width: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    order = F.struct("ts", "event_id")
    w = F.window("ts", width, slide)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg((F.max_by("value", order) - F.min_by("value", order)).alias("move"), F.stddev_samp("value").alias("spread"))


def session_windows(stream: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's output once all input that is there has been read, as a table in the shared folder or the warehouse."""
    spark = stream.sparkSession
    at = shared_folder(spark, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:

        def write(df: DataFrame, epoch: int) -> None:
            df.write.mode("overwrite").parquet(f"{at}/out")

        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


#: A row of this time is behind all others: when it comes, the watermark passes all that is open.
END = "2200-01-01 00:00:00"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _run(writer, conf: dict[str, str], spark: SparkSession) -> None:
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained_in_parts(parts: list[DataFrame], of: Callable[[DataFrame], DataFrame], name: str, flush: bool = True, upsert: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What `of` makes of a stream to which the parts come one after the other; parts have a column ts.

    Each part is written to a folder and the query run until it has read it, from its checkpoint on. At last, if `flush`, a row at END
    closes what is open; it has nulls in all other columns, and its own group never comes out. With `upsert`, that is called with each
    batch and its number in place of a table of results.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    at = shared_folder(spark, name)
    if flush:
        last = spark.range(1).select(*[(F.lit(END).cast(f.dataType) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        parts = [*parts, last]
    made = None
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        made = of(spark.readStream.schema(schema).parquet(f"{at}/in"))
        writer = made.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state")
        _run(writer.foreachBatch(upsert) if upsert else writer.format("parquet").option("path", f"{at}/out"), ROCKS, spark)
    return None if upsert else spark.read.schema(made.schema).parquet(f"{at}/out")


class Refreshed:
    """A keyed table that batches bring up to date: each batch writes the rows of the keys that it touched to a folder of its number.

    A batch that is run again replaces its own folder, and so changes nothing. The table is, for each key, the rows of the newest batch that has any.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str]):
        self.spark, self.at, self.keys = spark, shared_folder(spark, name), keys

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.at}/epoch={epoch}")

    def batches(self, upto: int | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", self.at).parquet(self.at)
        return rows if upto is None else rows.where(F.col("epoch") <= upto)

    def table(self) -> DataFrame:
        rows = self.batches()
        newest = rows.groupBy(*self.keys).agg(F.max("epoch").alias("__newest")).withColumnsRenamed({k: f"__{k}" for k in self.keys})
        same = F.col("epoch") == F.col("__newest")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return rows.join(newest, same, "left_semi").drop("epoch")


def refreshed_scan(parts: list[DataFrame], scan: Callable[[DataFrame], DataFrame], name: str, replay: bool = False) -> DataFrame:
    """The scan of all bars, kept up to date by batches of new bars (symbol, ts and the bar): only the symbols of a batch are scanned again.

    replay: each batch is handled twice, as after a failure between its work and its commit.
    """
    spark = parts[0].sparkSession
    bars, radar = Refreshed(spark, f"{name}-bars", ["symbol", "ts"]), Refreshed(spark, f"{name}-radar", ["symbol"])

    def upsert(batch: DataFrame, epoch: int) -> None:
        for _ in range(1 + replay):
            bars.write(batch, epoch)
            known = bars.batches(epoch)
            touched = known.where(F.col("epoch") == epoch).select("symbol").distinct()
            radar.write(scan(known.drop("epoch").join(touched, "symbol", "left_semi").dropDuplicates(["symbol", "ts"])), epoch)

    drained_in_parts(parts, lambda s: s, name, flush=False, upsert=upsert)
    return radar.table()


def session_gaps(parts: list[DataFrame], calendar: DataFrame, target, name: str, lookback: int = 45, late: str = "1 day") -> DataFrame:
    """ledger_id, dt, action of a stream of trades (ts, symbol, kind): the sessions up to the target of which nothing has come, the newest to be run, the others missed.

    A day counts as come once the watermark has closed it; late trades of a closed day don't count. The last closed day of a ledger is an upsert by batch.
    """
    seen = Refreshed(parts[0].sparkSession, f"{name}-seen", ["ledger_id", "kind", "epoch"])

    def days(stream: DataFrame) -> DataFrame:
        return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "symbol", "kind").agg(F.count("*").alias("n"))

    def upsert(batch: DataFrame, epoch: int) -> None:
        closed = batch.where("symbol IS NOT NULL").groupBy(F.col("symbol").alias("ledger_id"), "kind").agg(F.max(F.to_date("window.start")).alias("last_audit"))
        seen.write(closed, epoch)

    drained_in_parts(parts, days, name, upsert=upsert)
    audits = seen.batches().groupBy("ledger_id", "kind").agg(F.max("last_audit").alias("last_audit"))
    return calendars.missing_sessions(audits, calendar, target, lookback)
