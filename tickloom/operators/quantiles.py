"""Exact quantiles of groups of any size, by narrowing on the rank: no task holds a group.

A quantile lies between two order statistics. A pass over the rows counts, for each group, the rows below and inside a bracket of values, and a
mergeable sketch gives 501 evenly ranked values of those inside. The next bracket is the stretch of these that holds both ranks and a step more on either
side, ten times what the sketch may be off by. A pass leaves about a hundredth of a group's rows. Once few distinct values are inside,
their counts are summed and the statistics read off. A value that many rows share is one distinct value, so ties don't stop it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.storage import dropped, stored

#: Distinct values of a group that one task counts.
FEW = 4096
#: Ranks that the sketch is asked for, and its accuracy: off by a part in so many of the rows at most.
GRID, ACCURACY = [i / 500 for i in range(501)], 5000


def grouping_rows(rows: DataFrame, sets: list[list[str]], keys: list[str], also: list[str]) -> DataFrame:
    """rows once for each grouping set, keys that aren't in the set null, with level, the grouping's bits over keys, as grouping_id has them."""
    level = {tuple(s): sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets}
    each = [F.struct(*[(F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for k in keys], F.lit(v).cast("long").alias("level")) for s, v in level.items()]
    return rows.select(*also, F.inline(F.array(*each)))


def same_keys(by: list[str], renamed: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"{renamed}{i}")) for i, k in enumerate(by)], F.lit(True))


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group of rows (by, a, b, v)."""
    v = F.when(F.col("v").between(F.col("a"), F.col("b")), F.col("v"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") < F.col("a")).alias("below"),
        F.count(v).alias("inside"),
        F.approx_count_distinct(v, 0.02).alias("distinct"),
        F.percentile_approx(v, GRID, ACCURACY).alias("grid"),
        F.first("a").alias("a"),
        F.first("b").alias("b"),
    )


def _narrowed(state: DataFrame, q: float) -> DataFrame:
    at, last = (F.col("n") - 1) * F.lit(q), len(GRID) - 1
    place = lambda rank: (rank - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * F.lit(float(last))
    low, high = F.floor(place(F.floor(at))) - 1, F.ceil(place(F.ceil(at))) + 1
    a = F.when(low >= 0, F.element_at("grid", (F.least(low, F.lit(last)) + 1).cast("int"))).otherwise(F.col("a"))
    b = F.when(high <= last, F.element_at("grid", (F.greatest(high, F.lit(0)) + 1).cast("int"))).otherwise(F.col("b"))
    return state.withColumns({"a": a, "b": b})


def exact_quantile(rows: DataFrame, by: list[str], value: str, q: float = 0.5, name: str = "quantile", few: int = FEW) -> DataFrame:
    """by, name: the q-quantile of `value` in each group, interpolated between two order statistics; nulls and NaN play no part.

    rows is read once a pass: a stored table, or something cheap. Groups without a value have no row; null keys are a group.
    """
    end = F.lit(float("inf"))
    values = rows.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")

    def inside(state: DataFrame) -> DataFrame:
        bracket = state.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(by)], "a", "b", *[c for c in ("n", "below") if c in state.columns])
        return values.join(bracket, same_keys(by, "__k")).drop(*[f"__k{i}" for i in range(len(by))])

    state = stored(_counted(values.withColumns({"a": -end, "b": end}), by), "brackets")
    done, made = [], [state]
    while True:
        many = F.col("distinct") > few * 0.9  # the count is within a few hundredths
        done.append(state.where(~many).select(*by, "a", "b", "n", "below"))
        wide = state.where(many)
        if wide.isEmpty():
            break
        state = stored(_counted(inside(_narrowed(wide, q).select(*by, "a", "b")), by), "brackets")
        made.append(state)
    brackets = stored(reduce(DataFrame.unionByName, done), "brackets")
    dropped(*made)
    counts = inside(brackets).where(F.col("v").between(F.col("a"), F.col("b"))).groupBy(*by, "n", "below", "v").agg(F.count("*").alias("times"))
    # a window sees the `few` values of a group
    upto = F.col("below") + F.sum("times").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("n") - 1) * F.lit(q)
    steps = counts.withColumns({"upto": upto, "at": at})
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    out = steps.groupBy(*by, "at").agg(first(F.floor("at")).alias("x"), first(F.ceil("at")).alias("y"))
    return out.select(*by, (F.col("x") + (F.col("at") - F.floor("at")) * (F.col("y") - F.col("x"))).alias(name))
