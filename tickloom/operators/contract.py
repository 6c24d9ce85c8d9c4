"""The coverage contract of a radar snapshot: does what it says of itself agree with what was asked for and with its records?

A snapshot is rows of several tables, not one document: heads (one row each), asked symbols and horizons, shortlist, declared pairs, records. All that
concerns a pair meets in one aggregation by snapshot, symbol and horizon.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 8
MODES, KINDS = ("fast", "ml"), ("expected", "successful", "missing")


def _per_pair(symbols: DataFrame, horizons: DataFrame, shortlist: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """snapshot_id, symbol, horizon and, by mode, how often the pair is asked for, declared as each kind, and recorded."""
    every = horizons.groupBy("snapshot_id", "horizon").agg(F.lit(1).alias("one"))
    flags = [f"{m}_{k}" for m in MODES for k in ("asked", *KINDS, "recorded")]

    def marked(df: DataFrame, flag: Column) -> DataFrame:
        return df.select("snapshot_id", "symbol", "horizon", *[F.when(flag == f, 1).otherwise(0).alias(f) for f in flags])

    parts = [
        marked(symbols.distinct().join(every, "snapshot_id"), F.lit("fast_asked")),
        marked(shortlist.distinct().join(every, "snapshot_id"), F.lit("ml_asked")),
        marked(pairs, F.concat_ws("_", "mode", "kind")),
        marked(records, F.concat(F.lower("mode"), F.lit("_recorded"))),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("snapshot_id", "symbol", "horizon").agg(*[F.sum(f).alias(f) for f in flags])


def coverage_contract(heads: DataFrame, symbols: DataFrame, horizons: DataFrame, own_horizons: DataFrame, shortlist: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """snapshot_id, state: COMPLETE, PARTIAL or INVALID; whatever is missing or isn't known makes a snapshot invalid.

    heads: snapshot_id, schema_version, coverage_status, universe_total, n_errors; symbols, shortlist: snapshot_id, symbol; horizons (asked for) and
    own_horizons: snapshot_id, horizon; pairs: snapshot_id, mode, kind, symbol, horizon; records: snapshot_id, mode, symbol, horizon.
    """
    met = _per_pair(symbols, horizons, shortlist, pairs, records)
    n = {f: F.col(f) > 0 for f in met.columns[3:]}
    faults = [F.col("symbol").isNull() | (F.col("symbol") == ""), F.col("horizon").isNull() | (F.col("horizon") <= 0)]
    for m in MODES:
        faults += [F.col(f"{m}_{k}") > 1 for k in KINDS]
        faults += [n[f"{m}_asked"] != n[f"{m}_expected"], n[f"{m}_successful"] & ~n[f"{m}_asked"], n[f"{m}_missing"] != (n[f"{m}_asked"] & ~n[f"{m}_successful"]), n[f"{m}_recorded"] & ~n[f"{m}_successful"]]
    # a success of the model must be recorded as one; a fast success may have been replaced by it
    faults += [n["ml_successful"] & ~n["ml_recorded"], n["fast_successful"] & ~n["ml_successful"] & ~n["fast_recorded"]]
    bad = F.coalesce(reduce(lambda a, b: a | b, faults), F.lit(True))
    by_pair = met.groupBy("snapshot_id").agg(F.max(bad.cast("int")).alias("bad"), F.max((n["fast_missing"] | n["ml_missing"]).cast("int")).alias("open"))
    asked = symbols.groupBy("snapshot_id").agg(F.count("*").alias("n_symbols"))
    spans = horizons.groupBy("snapshot_id").agg(F.count("*").alias("n_horizons"), F.array_sort(F.collect_set("horizon")).alias("asked"))  # a handful for each
    own = own_horizons.groupBy("snapshot_id").agg(F.count("*").alias("n_own"), F.array_sort(F.collect_set("horizon")).alias("own"))
    strange = shortlist.join(symbols.select("snapshot_id", "symbol"), ["snapshot_id", "symbol"], "left_anti").groupBy("snapshot_id").agg(F.lit(1).alias("strange"))
    modes = records.where(~F.coalesce(F.lower("mode").isin(*MODES), F.lit(False))).groupBy("snapshot_id").agg(F.lit(1).alias("odd_mode"))
    rows = heads
    for part in (by_pair, asked, spans, own, strange, modes):
        rows = rows.join(part, "snapshot_id", "left")
    sound = (
        (F.col("schema_version") >= SCHEMA_VERSION) & (F.col("n_symbols") > 0) & (F.col("universe_total") == F.col("n_symbols")) & (F.col("n_horizons") == F.size("asked"))
        & (F.col("n_own") == F.col("n_horizons")) & (F.col("asked") == F.col("own")) & F.col("n_errors").isNotNull() & F.col("strange").isNull() & F.col("odd_mode").isNull() & (F.col("bad") == 0)
    )
    state = F.when((F.col("open") == 1) | (F.col("n_errors") > 0), "PARTIAL").otherwise("COMPLETE")
    valid = F.coalesce(sound & (F.col("coverage_status") == F.lower(state)), F.lit(False))
    return rows.select("snapshot_id", F.when(valid, state).otherwise("INVALID").alias("state"))
