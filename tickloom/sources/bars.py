"""Bar tables: built from trades, cleaned, windowed, described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.storage import stored

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("dt", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
MIN_BARS = 320


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_symbol(brand: Column) -> Column:
    """An instrument's symbol; the brand number decides its market."""
    k = F.regexp_extract(brand, r"(\d+)", 1)
    kind = k.cast("int") % 5
    name = F.concat(F.lit("B"), k)
    return (
        F.when(kind == 0, F.concat(name, F.lit("-USD")))
        .when(kind == 1, F.concat(name, F.lit(".WA")))
        .when(kind == 2, F.concat(name, F.lit(".DE")))
        .when(kind == 3, F.concat(F.lit("^"), name))
        .otherwise(name)
    )


def trades(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """symbol, dt, px, volume, a total order of the day's trades and the order they belong to; px is the damped unit price."""
    line = table(spark, sf_dir, "lineitem")
    if by == "brand":
        parts = table(spark, sf_dir, "part").select("p_partkey", brand_symbol(F.col("p_brand")).alias("symbol"))
        line = line.join(parts, line.l_partkey == parts.p_partkey)
    else:
        nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        places = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("symbol"))
        line = line.join(places, line.l_suppkey == places.s_suppkey)
    px = F.round(F.pow(F.col("l_extendedprice") / F.col("l_quantity"), 0.02), 6)
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    out = line.select("symbol", F.to_date("l_shipdate").alias("dt"), px.alias("px"), F.col("l_quantity").alias("volume"), order.alias("ord"), F.col("l_orderkey").alias("order"))
    if by == "brand":  # crypto trades on all days, the other markets on weekdays
        out = out.where(F.col("symbol").endswith("-USD") | ~F.dayofweek("dt").isin(1, 7))
    return out


def bars_from_trades(ticks: DataFrame) -> DataFrame:
    """One row per symbol and day. Extremes are partial aggregates: a busy symbol is no single task's work.

    Those by the order of trades, whose state is a struct, can't be aggregated by hashing, only after a sort of all trades. So a first pass
    finds the rest by hashing, with each day's first and last order; the order of trades decides among the trades of these alone.
    """
    key = F.col("order")
    days = stored(
        ticks.groupBy("symbol", "dt").agg(
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.sum("volume").alias("volume"),
            F.when(~F.max(key.isNull()), F.min(key)).alias("first"),  # null comes before all
            F.max(key).alias("last"),
        ),
        "days",
    )
    # two orders for each symbol and day, however many trades there are
    ends = days.select(F.explode(F.array("first", "last")).alias("__order")).distinct()
    few = ticks.join(F.broadcast(ends), key.eqNullSafe(F.col("__order")), "left_semi")
    prices = few.groupBy(F.col("symbol").alias("__symbol"), F.col("dt").alias("__dt")).agg(F.min_by("px", "ord").alias("open"), F.max_by("px", "ord").alias("close"))
    bars = days.join(prices, F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("dt").eqNullSafe(F.col("__dt")))
    return bars.select("symbol", "dt", "open", "high", "low", "close", "volume")


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the instruments, written: a query reads them many times, and the trades behind them grow where the bars don't."""
    return stored(bars_from_trades(trades(spark, sf_dir)), "bars")


def clean_bars(raw: DataFrame, seq: str, min_bars: int = MIN_BARS) -> tuple[DataFrame, DataFrame]:
    """Bars without null closes, the last of a day's duplicates by `seq`, and the symbols with too few, as errors."""
    last = Window.partitionBy("symbol", "dt").orderBy(F.desc(seq))
    rows = raw.where(F.col("close").isNotNull()).withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    counts = rows.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    good = rows.join(counts.where(F.col("n_bars") >= min_bars).select("symbol"), "symbol", "left_semi")
    errors = counts.where(F.col("n_bars") < min_bars).withColumn("code", F.lit("TOO_FEW_BARS"))
    return good, errors


def history_window(bars: DataFrame, as_of: Column, years: float) -> DataFrame:
    return bars.where(F.col("dt") >= F.date_sub(as_of, int(years * 365.25 + 40)))


def history_metadata(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def benchmark_of(symbol: Column) -> Column:
    return (
        F.when(symbol == "B15-USD", None)
        .when(symbol.endswith("-USD"), "B15-USD")
        .when(symbol.endswith(".WA"), "B11.WA")
        .otherwise("^B13")
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, category, symbol, pos of each instrument."""
    symbols = table(spark, sf_dir, "part").select(brand_symbol(F.col("p_brand")).alias("symbol"), F.col("p_type").alias("category"), "p_partkey")
    return symbols.groupBy("symbol", "category").agg(F.min("p_partkey").alias("pos"))


def default_universe(catalog: DataFrame, first: int) -> DataFrame:
    """The first few of each category by position, each symbol once, in order of first appearance."""
    w = Window.partitionBy("category").orderBy("pos", "symbol")
    chosen = catalog.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first)
    return chosen.groupBy("symbol").agg(F.min("pos").alias("pos"))
