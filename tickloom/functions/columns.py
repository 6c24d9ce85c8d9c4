"""Column helpers: guarded rolling windows, rounding, null-safe ratios, exponential averages."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; adding zero turns a negative zero into zero."""
    return F.round(col(c), 6) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """Null instead of NaN and infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def series(*keys: str, order: str = "dt") -> WindowSpec:
    """Rows of one series in time order."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(agg: Column, value: Column | str, w: WindowSpec, n: int) -> Column:
    """agg over the last n rows, null until n values are there."""
    frame = trailing(w, n)
    return F.when(F.count(col(value)).over(frame) == n, agg.over(frame))


def change(c: Column | str, w: WindowSpec, n: int = 1) -> Column:
    """Simple return over n rows."""
    return ratio(c, F.lag(col(c), n).over(w)) - 1


def with_ewm(df: DataFrame, averages: dict[str, tuple], key: str = "symbol", order: str = "dt") -> DataFrame:
    """df with recursive averages y = a*x + (1-a)*y', each started by its first value; a missing x carries y on.

    averages maps a new column to (value, a), the value being a column or a function of the columns so far, as pandas series.
    One pass in time order over each series, all averages at once: linear in its rows.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in averages]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        known = {c: pd.Series(table.column(c).to_numpy()) for c in table.column_names if pa.types.is_floating(table.schema.field(c).type)}
        for name, (value, a) in averages.items():
            x = value(known) if callable(value) else known[value]
            known[name] = x.ewm(alpha=a, adjust=False, ignore_na=True).mean()
            table = table.append_column(name, pa.array(known[name], pa.float64(), from_pandas=True))
        return table

    return df.groupBy(key).applyInArrow(run, schema)
