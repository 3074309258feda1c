"""Text fields of items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_tags(column: str) -> Column:
    """Numbers of a list literal such as ``[27, 9]``; null or malformed text gives an empty array."""
    return F.coalesce(F.from_json(F.col(column), "array<bigint>"), F.array().cast("array<bigint>"))


def item_text(columns: list[str], fallback: str = "unknown item", unknown: str = "UNKNOWN") -> Column:
    """``name: value ; name: value`` of the columns that are set; null, blank and unknown values are left out."""
    value = lambda c: F.trim(F.col(c).cast("string"))
    parts = [F.when(F.col(c).isNotNull() & (value(c) != "") & (F.upper(value(c)) != unknown), F.concat(F.lit(f"{c}: "), value(c))) for c in columns]
    return F.coalesce(F.nullif(F.concat_ws(" ; ", *parts), F.lit("")), F.lit(fallback))


def text_field(column: str, name: str) -> Column:
    """Value of a field of :func:`item_text`; empty if it isn't there."""
    return F.trim(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), rf"(?:^|;\s*){re.escape(name)}:\s*([^;]+)", 1))


def to_number(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as numbers; rows where one isn't a number go."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in columns}).dropna(subset=list(columns))


def multi_hot(column: str, values: list[str], separator: str = "|") -> list[Column]:
    """A column per value: its presence in the separated list, divided by the list's length."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), re.escape(separator))
    return [(F.array_contains(parts, v).cast("double") / F.size(parts)).alias(f"has_{v}") for v in values]


def bucket(column: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the right-closed interval that holds the value; the last name is for values beyond all edges."""
    out = None
    for edge, name in zip(edges, names, strict=False):
        out = F.when(column <= edge, name) if out is None else out.when(column <= edge, name)
    return out.when(column.isNotNull(), names[len(edges)])
