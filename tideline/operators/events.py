"""The session event log: types, counted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raw and canonical names of event types.
TYPES = {"clicks": "clicks", "view": "clicks", "carts": "carts", "addtocart": "carts", "orders": "orders", "transaction": "orders"}
IDENTITY = ["session", "visitorid", "aid", "ts", "type", "transactionid"]


def mapped_type(column: str | Column = "type") -> Column:
    """Canonical type of a raw one, trimmed and without regard to case; null for foreign types and null."""
    raw = F.lower(F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(" \t\r\n")))
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for canonical in ("clicks", "carts", "orders"):
        expr = expr.when(raw.isin([k for k, v in TYPES.items() if v == canonical]), canonical)
    return expr


def typed_events(events: DataFrame) -> DataFrame:
    """Rows with an item and a known type, the type mapped; copies are still there."""
    return events.withColumn("type", mapped_type()).filter(F.col("aid").isNotNull() & F.col("type").isNotNull())


def counted_events(events: DataFrame) -> DataFrame:
    """:func:`typed_events`, each event once: rows that agree in :data:`IDENTITY` (null equals null) are one event."""
    return typed_events(events).select(*IDENTITY).distinct()
