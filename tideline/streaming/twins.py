"""Structured Streaming counterparts of operators that are naturally incremental.

Each takes a streaming (or batch) DataFrame with an event-time column ``event_time`` and returns one; the caller starts the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.indexes import weight


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per visitor as they close: bounds, events and items. As in the batch operator, events exactly ``gap`` apart stay together."""
    marked = events.withWatermark("event_time", late)
    rows = marked.groupBy("visitorid", F.session_window("event_time", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("aid").alias("items"), F.max("event_time").alias("end_time"))
    return rows.select("visitorid", F.col("s.start").alias("start_time"), "end_time", "events", "items")


def popularity(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and weighted events per item and window."""
    marked = events.withWatermark("event_time", late)
    frame = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    rows = marked.groupBy(frame.alias("w"), "aid").agg(F.count(F.lit(1)).alias("events"), F.sum(weight()).alias("score"))
    return rows.select(F.col("w.start").alias("window_start"), "aid", "events", "score")


def drop_copies(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events delivered again within the watermark go."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def with_latest_state(events: DataFrame, latest: DataFrame, key: str = "aid") -> DataFrame:
    """Stream-static join with the newest state per item; unknown items get -1."""
    return events.join(latest, key, "left").fillna(-1, [c for c in latest.columns if c != key])


def asof_state(changes_and_events: DataFrame) -> DataFrame:
    """Events with the last state of their item that came before them, kept as state per item.

    Input: one stream ``aid, ts, kind`` (state or event), ``value`` of both. Rows of one micro-batch are taken in the order of their times, states first.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(["ts", "kind"], ascending=[True, False], kind="stable")
        out = []
        for ts, kind, value in rows[["ts", "kind", "value"]].itertuples(index=False):
            if kind == "state":
                last = int(value)
            else:
                out.append((key[0], ts, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["aid", "ts", "value"])

    return changes_and_events.groupBy("aid").applyInPandasWithState(step, "aid long, ts long, value long", "last long", "append", GroupStateTimeout.NoTimeout)
