"""Checks of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself; ValueError if it lacks a column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; ValueError if two rows agree in ``keys``. Runs a job that stops at the first case."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").limit(1).count():
        raise ValueError(f"rows aren't unique by {keys}")
    return df


def assert_subset(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """``part`` itself; ValueError if one of its keys isn't in ``whole``."""
    if part.select(*keys).join(whole.select(*keys), keys, "left_anti").limit(1).count():
        raise ValueError(f"rows outside the allowed set by {keys}")
    return part
