"""Sequence samples and sequence splits.

Histories are collected from bounded window frames or after a cut by rank, so that a long session or user never becomes one array
unless the caller asks for whole sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sessions import TYPE_IDS, _at_positions, number_rows


def type_id(column: str = "type") -> Column:
    """Id of a canonical type, null for others."""
    return F.create_map(*(F.lit(x) for pair in TYPE_IDS.items() for x in pair))[F.col(column)]


def _assemble(rows: DataFrame, history: str) -> DataFrame:
    h = F.col(history)
    return rows.withColumns(
        {
            "target_type_id": type_id("target_type"),
            "history_aids": F.transform(h, lambda x: x.aid),
            "history_type_ids": F.transform(h, lambda x: x.type_id),
            "history_time_deltas_ms": F.transform(h, lambda x: F.col("target_ts") - x.ts),
            "history_length_used": F.size(h).cast("long"),
        }
    ).drop(history)


def training_samples(events: DataFrame, min_history: int = 2, max_history: int = 30, max_samples: int = 50) -> DataFrame:
    """A sample per event with a time of its own and at least ``min_history`` earlier events: target and its last ``max_history`` events.

    Sessions with more than ``max_samples`` targets give evenly spaced ones. Since a target's time is its own, all rows before it
    are strictly earlier, so a frame of ``max_history`` rows holds its history.
    """
    w = Window.partitionBy("session").orderBy("ts", "event_order")
    item = F.struct("aid", type_id().alias("type_id"), "ts")
    rows = events.select("session", "aid", "ts", "type", "event_order").withColumns(
        {
            "__h": F.collect_list(item).over(w.rowsBetween(-max_history, -1)),
            "__pos": F.row_number().over(w) - 1,
            "__before": F.lag("ts").over(w),
            "__after": F.lead("ts").over(w),
        }
    )
    alone = ~F.col("ts").eqNullSafe(F.col("__before")) & ~F.col("ts").eqNullSafe(F.col("__after"))
    rows = rows.filter(alone & (F.col("__pos") >= min_history))
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    rows = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": n})
    step = F.sequence(F.lit(0), F.lit(max_samples - 1))
    chosen = F.transform(step, lambda k: F.rint(k * (F.col("__n") - 1) / F.lit(float(max(1, max_samples - 1)))).cast("int"))
    rows = rows.filter((F.col("__n") <= max_samples) | F.array_contains(chosen, F.col("__i")))
    named = rows.select("session", F.col("aid").alias("target_aid"), F.col("type").alias("target_type"), F.col("ts").alias("target_ts"), "event_order", F.col("__pos").cast("long").alias("history_length_full"), "__h")
    return _assemble(named, "__h")


def evaluation_samples(events: DataFrame, labels: DataFrame, min_history: int = 2, max_history: int = 30) -> DataFrame:
    """A sample per label with the last ``max_history`` strictly earlier events; labels with fewer than ``min_history`` give none."""
    rows = events.select("session", "aid", "ts", "type", "event_order").join(labels.select("session", "target_aid", "target_type", "target_ts"), "session").filter(F.col("ts") < F.col("target_ts"))
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_order"))
    rows = rows.withColumn("__back", F.row_number().over(w))
    sizes = rows.groupBy("session").agg(F.count(F.lit(1)).alias("history_length_full"))
    kept = rows.filter(F.col("__back") <= max_history).groupBy("session", "target_aid", "target_type", "target_ts").agg(F.array_sort(F.collect_list(F.struct("ts", "event_order", "aid", type_id().alias("type_id")))).alias("__h"))
    return _assemble(kept.join(sizes.filter(F.col("history_length_full") >= min_history), "session"), "__h")


def feedback_sequences(events: DataFrame, max_length: int | None = None, min_positive: int = 0, order: str = "event_order") -> DataFrame:
    """``user_id, items, positive``: each user's events in the order of ``timestamp, order``, the last ``max_length`` of them; users with
    fewer than ``min_positive`` positive ones among these go."""
    if max_length is not None:
        w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc(order))
        events = events.withColumn("__back", F.row_number().over(w)).filter(F.col("__back") <= max_length)
    rows = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", order, F.col("item_id").alias("item"), F.col("is_positive").alias("positive")))).alias("s"), F.sum("is_positive").alias("__p"))
    return rows.filter(F.col("__p") >= min_positive).select("user_id", F.transform("s", lambda x: x.item).alias("items"), F.transform("s", lambda x: x.positive).alias("positive"))


def interaction_sequences(events: DataFrame, min_length: int = 1, max_length: int | None = None, order: str = "event_order") -> DataFrame:
    """``user_id, items`` with items replaced by their dense rank from 0; users with fewer than ``min_length`` events go. Runs jobs."""
    ids = number_rows(events.select("item_id").distinct(), "__index", "item_id")
    rows = feedback_sequences(events.join(ids, "item_id").withColumns({"item_id": F.col("__index").cast("long"), "is_positive": F.lit(1)}), max_length, 0, order)
    return rows.filter(F.size("items") >= min_length).select("user_id", "items")


def leave_two_out(sequences: DataFrame, min_train: int = 3) -> DataFrame:
    """``train`` without the last two items, ``valid`` without the last one, ``test`` all; shorter sequences go."""
    n = F.size("items")
    return sequences.filter(n >= min_train + 2).select("user_id", F.slice("items", F.lit(1), n - 2).alias("train"), F.slice("items", F.lit(1), n - 1).alias("valid"), F.col("items").alias("test"))


def user_holdout(users: DataFrame, fraction: float) -> DataFrame:
    """``user_id, part``: the first ``floor(n * fraction)`` users by id are train, the others test. Runs jobs."""
    n = users.count()
    cut = int(n * fraction)
    if cut == 0 or n == 0:
        return users.select("user_id", F.lit("test").alias("part"))
    last = _at_positions(users.select("user_id", F.lit(1).cast("long").alias("n")), "user_id", [cut - 1])[0]
    return users.select("user_id", F.when(F.col("user_id") <= last, "train").otherwise("test").alias("part"))


def _pairs(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("__s", F.arrays_zip(F.col("items").alias("item"), F.col("positive").alias("flag")))


def positive_leave_two_out(sequences: DataFrame, min_train_positive: int = 3) -> DataFrame:
    """Prefixes ``train, valid, test`` (arrays of ``item, flag``) that end before the last but one positive item, at it and at the last one."""
    rows = _pairs(sequences).withColumn("__at", F.filter(F.transform("positive", lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull()))
    rows = rows.filter(F.size("__at") >= min_train_positive + 2).withColumns({"__v": F.element_at("__at", -2), "__t": F.element_at("__at", -1)})
    s = F.transform("__s", lambda x: F.struct(x["items"].alias("item"), x["positive"].alias("flag"))) if "items" in rows.schema["__s"].dataType.elementType.names else F.col("__s")
    rows = rows.withColumn("__s", s)
    return rows.select("user_id", F.slice("__s", F.lit(1), F.col("__v")).alias("train"), F.slice("__s", F.lit(1), F.col("__v") + 1).alias("valid"), F.slice("__s", F.lit(1), F.col("__t") + 1).alias("test"))


def left_pad(values: Column, length: int, fill: Column) -> Column:
    """``values`` filled up on the left to ``length``."""
    return F.concat(F.array_repeat(fill, F.lit(length) - F.size(values)), values)


def next_item_samples(sequences: DataFrame, history: int, last: int | None = None, last_only: bool = False) -> DataFrame:
    """``user_id, position, history, target``: for each item from the third on (the last ``last`` of them, or the last item only) the items before it, padded with 0."""
    n = F.size("items")
    low = n - 1 if last_only else (F.lit(2) if last is None else F.greatest(F.lit(2), n - last))
    rows = sequences.filter(n > (0 if last_only else 2)).withColumn("position", F.explode(F.sequence(low, n - 1)))
    return _before(rows, "items", history, "history").select("user_id", F.col("position").cast("long").alias("position"), "history", F.col("items")[F.col("position")].alias("target"))


def _before(rows: DataFrame, values: str, length: int, name: str) -> DataFrame:
    start = F.greatest(F.lit(0), F.col("position") - length)
    part = F.slice(values, start + 1, F.col("position") - start)
    return rows.withColumn(name, left_pad(part, length, F.lit(0).cast(rows.schema[values].dataType.elementType)))


def positive_samples(sequences: DataFrame, history: int, last: int | None = None) -> DataFrame:
    """``user_id, position, history, feedback, target``: for each positive item from the second on (the last ``last`` of them) what came
    before; feedback is 0 for padding, 1 for a negative and 2 for a positive item."""
    at = F.filter(F.transform("positive", lambda x, i: F.when((x == 1) & (i >= 1), i)), lambda x: x.isNotNull())
    rows = sequences.withColumns({"__at": at, "__f": F.transform("positive", lambda x: (x + 1).cast("long"))}).filter(F.size("__at") > 0)
    if last is not None:
        rows = rows.withColumn("__at", F.slice("__at", F.greatest(F.lit(1), F.size("__at") - last + 1), F.lit(last)))
    rows = rows.withColumn("position", F.explode("__at"))
    rows = _before(_before(rows, "items", history, "history"), "__f", history, "feedback")
    return rows.select("user_id", F.col("position").cast("long").alias("position"), "history", "feedback", F.col("items")[F.col("position")].alias("target"))


def last_positive_samples(sequences: DataFrame, history: int) -> DataFrame:
    """:func:`positive_samples` for each user's last positive item only, which may be the first item."""
    at = F.array_max(F.transform("positive", lambda x, i: F.when(x == 1, i)))
    rows = sequences.withColumns({"position": at, "__f": F.transform("positive", lambda x: (x + 1).cast("long"))}).filter(F.col("position").isNotNull())
    rows = _before(_before(rows, "items", history, "history"), "__f", history, "feedback")
    return rows.select("user_id", F.col("position").cast("long").alias("position"), "history", "feedback", F.col("items")[F.col("position")].alias("target"))


def masked_windows(sequences: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """``user_id, block_start, items, feedback, labels``: windows of ``length`` inputs whose targets are the items one step on.

    Blocks of ``stride`` targets follow each other, so no target counts twice; inputs are item + 1 with 0 as padding, labels are the
    target item where it is positive and in the block, -100 elsewhere.
    """
    step = stride or length
    if not 1 <= step <= length:
        raise ValueError("stride must be from 1 to length")
    n = F.size("items")
    rows = sequences.filter(n > 1).withColumn("block_start", F.explode(F.sequence(F.lit(1), n - 1, F.lit(step))))
    rows = rows.withColumn("__end", F.least(F.col("block_start") + step, n)).withColumn("__from", F.greatest(F.lit(0), F.col("__end") - (length + 1)))
    count = F.col("__end") - F.col("__from") - 1
    inputs = F.transform(F.slice("items", F.col("__from") + 1, count), lambda x: x + 1)
    flags = F.transform(F.slice("positive", F.col("__from") + 1, count), lambda x: (x + 1).cast("long"))
    targets, target_flags = F.slice("items", F.col("__from") + 2, count), F.slice("positive", F.col("__from") + 2, count)
    labels = F.transform(F.arrays_zip(targets.alias("t"), target_flags.alias("f")), lambda x, i: F.when((x["f"] == 1) & (F.col("__from") + 1 + i >= F.col("block_start")), x["t"]).otherwise(F.lit(-100)))
    zero = F.lit(0).cast("long")
    return rows.select("user_id", F.col("block_start").cast("long").alias("block_start"), left_pad(inputs, length, zero).alias("items"), left_pad(flags, length, zero).alias("feedback"), left_pad(labels, length, F.lit(-100).cast("long")).alias("labels"))
