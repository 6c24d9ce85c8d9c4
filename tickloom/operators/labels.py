"""Forward labels and executions, by row position in each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio, series

def w():
    """Rows of one symbol in time order."""
    return series("symbol")


def forward_return(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("forward_return", ratio(F.lead("close", horizon).over(w()), "close") - 1)


def supervised(frame: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """Rows whose features and label are all known; y is 1 for a rise over `horizon` rows."""
    df = forward_return(frame, horizon).dropna(subset=[*features, "forward_return"])
    return df.withColumn("y", (F.col("forward_return") > 0).cast("int"))


def executions(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """One row per bar and horizon: label close to close, trade from the next open to the open `horizon` rows later."""
    out = {"entry_dt": F.lead("dt", 1).over(w()), "entry_price": F.lead("open", 1).over(w())}
    for h in horizons:
        out[f"exit_dt_{h}"] = F.lead("dt", h + 1).over(w())
        out[f"exit_price_{h}"] = F.lead("open", h + 1).over(w())
        out[f"forward_{h}"] = ratio(F.lead("close", h).over(w()), "close") - 1
    b = bars.withColumns(out)
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"exit_dt_{h}").alias("exit_dt"), F.col(f"exit_price_{h}").alias("exit_price"), F.col(f"forward_{h}").alias("forward_return")) for h in horizons])
    b = b.select("symbol", "dt", "close", "entry_dt", "entry_price", F.inline(rows))
    return b.withColumns(
        {
            "actual_up": F.when(F.col("forward_return").isNotNull(), (F.col("forward_return") > 0).cast("int")),
            "execution_return": ratio("exit_price", "entry_price") - 1,
        }
    )


def known_at(labelled: DataFrame, horizon: int) -> DataFrame:
    """label_dt: the last row whose label over `horizon` rows is known at each row: `horizon` rows back."""
    return labelled.withColumn("label_dt", F.lag("dt", horizon).over(w()))
