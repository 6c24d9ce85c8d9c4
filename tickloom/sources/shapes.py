"""Frames of older shapes brought to a given one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def conform(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns it lacks, from their fallback expressions; columns that are there stay as they are."""
    return df.withColumns({name: value for name, value in defaults.items() if name not in df.columns})
