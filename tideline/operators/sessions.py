"""Sessions, their dimension, labels and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.clean import drop_ambiguous, drop_copies, map_types
from tideline.session import settle

#: Canonical types in the order of their ids.
TYPE_IDS = {"clicks": 0, "carts": 1, "orders": 2}


def sessionise(events: DataFrame, gap_ms: int, visitor: str = "visitorid", time: str = "ts", order: str = "event_order", width: int = 100_000) -> DataFrame:
    """Add ``session = visitor * width + number``: a new one begins after a gap greater than ``gap_ms``.

    One shuffle by visitor; the number counts the visitor's sessions from 1. Rows with a null visitor or time go.
    """
    w = Window.partitionBy(visitor).orderBy(time, order)
    rows = events.dropna(subset=[visitor, time]).withColumn("__new", F.coalesce((F.col(time) - F.lag(time).over(w) > gap_ms).cast("int"), F.lit(1)))
    return rows.withColumn("session", F.col(visitor) * width + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def number_rows(df: DataFrame, name: str, *order) -> DataFrame:
    """Add ``name``, the place of each row in ``order`` from 0, without sorting in one task; runs two jobs.

    Rows are range-sorted and settled; the driver gets the number of rows of each range, and each task adds its offset.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = settle(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    starts, so_far = [], 0
    for row in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts += [F.lit(row["p"]), F.lit(so_far)]
        so_far += row["count"]
    offset = F.create_map(*starts)[part] if starts else F.lit(0)
    return rows.withColumn(name, (offset + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__at")


def dense_sessions(events: DataFrame) -> DataFrame:
    """Replace ``session`` by its dense rank from 0. The numbering is done on the sessions, not on the events; runs jobs."""
    numbered = number_rows(events.select("session").distinct(), "__dense", "session")
    return events.join(numbered, "session").withColumn("session", F.col("__dense")).drop("__dense").select(*events.columns)


def session_dimension(events: DataFrame, min_events: int = 3) -> DataFrame:
    """One row per session: sizes, bounds, how many events share the last time, and whether it can have a label, with the reason if not."""
    by_time = events.groupBy("session", "ts").agg(F.count(F.lit(1)).alias("__n"), F.first("visitorid").alias("visitorid"))
    sizes = by_time.groupBy("session").agg(
        F.first("visitorid").alias("visitorid"),
        F.sum("__n").alias("event_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max_by("__n", "ts").alias("last_timestamp_count"),
    )
    unique = events.select("session", "aid").distinct().groupBy("session").agg(F.count(F.lit(1)).alias("unique_item_count"))
    short, ambiguous = F.col("event_count") < min_events, F.col("last_timestamp_count") > 1
    reason = F.concat_ws("+", F.when(short, F.lit("too_short")), F.when(ambiguous, F.lit("ambiguous_last_timestamp")))
    rows = sizes.join(unique, "session")
    return rows.withColumns({"label_eligible": ~(short | ambiguous), "ineligible_reason": reason})


def last_event_labels(events: DataFrame) -> DataFrame:
    """``session, target_aid, target_type, target_ts`` of each session's last event; sessions with a tied last time have none."""
    rows = events.groupBy("session").agg(F.max_by(F.struct("aid", "type", "ts"), "ts").alias("l"), F.max("ts").alias("__t"))
    tied = events.groupBy("session", "ts").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("session", F.col("ts").alias("__t"))
    return rows.join(tied, ["session", "__t"], "left_anti").select("session", F.col("l.aid").alias("target_aid"), F.col("l.type").alias("target_type"), F.col("l.ts").alias("target_ts"))


def leave_last_out(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(history, labels)``: labels are the unique last events, histories all strictly earlier events of these sessions."""
    rows = drop_ambiguous(events)
    labels = last_event_labels(rows)
    history = rows.join(labels.select("session", "target_ts"), "session").filter(F.col("ts") < F.col("target_ts")).drop("target_ts")
    return history, labels


def time_splits(labels: DataFrame, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Add ``split`` train, validation or test by ``target_ts``; ties at a boundary go to the later part. Runs jobs.

    The boundaries are the times at the positions ``floor(n * ratio)``, read off the cumulated counts per time, so nothing is
    sorted in one task. Too few labels or an empty part raise ValueError.
    """
    n = labels.count()
    first, second = int(n * train), int(n * train) + int(n * valid)
    if not 0 < first < second < n:
        raise ValueError("too few labels to split")
    by_time = labels.groupBy("target_ts").agg(F.count(F.lit(1)).alias("n"))
    bounds = _at_positions(by_time, "target_ts", [first, second])
    split = F.when(F.col("target_ts") < bounds[0], "train").when(F.col("target_ts") < bounds[1], "validation").otherwise("test")
    low = labels.agg(F.min("target_ts")).first()[0]
    if not low < bounds[0] < bounds[1]:
        raise ValueError("ties leave a part empty")
    return labels.withColumn("split", split)


def _at_positions(counts: DataFrame, value: str, positions: list[int], buckets: int = 1024) -> list[int]:
    """Values at 0-based positions of the sorted rows, from counts per value: a histogram narrows each down, then its bucket is summed."""
    low, high = counts.agg(F.min(value), F.max(value)).first()
    width = max(1, (high - low) // buckets + 1)
    histogram = sorted((r.b, r.n) for r in counts.groupBy(F.floor((F.col(value) - low) / width).alias("b")).agg(F.sum("n").alias("n")).collect())
    out = []
    for position in positions:
        before = 0
        for b, n in histogram:
            if position < before + n:
                break
            before += n
        inside = counts.filter((F.col(value) >= low + b * width) & (F.col(value) < low + (b + 1) * width))
        w = Window.partitionBy(F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        out.append(inside.withColumn("__s", F.sum("n").over(w)).filter(F.col("__s") > position - before).agg(F.min(value)).first()[0])
    return out


def split_sessions(events: DataFrame, train: float = 0.7, valid: float = 0.15) -> dict[str, DataFrame]:
    """Events of the train, validation and test sessions."""
    labels = time_splits(last_event_labels(drop_ambiguous(events)), train, valid)
    return {part: events.join(labels.filter(F.col("split") == part).select("session"), "session", "left_semi") for part in ("train", "validation", "test")}


def preprocess(raw: DataFrame, gap_ms: int, min_events: int = 3, train: float = 0.7, valid: float = 0.15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(events, sessions, labels)`` of a raw log ``timestamp, visitorid, event, itemid, transactionid, event_order``.

    Unknown events and copies go, sessions are cut, eligible ones get the label and split of their last event.
    """
    rows = drop_copies(map_types(raw), ["timestamp", "visitorid", "type", "itemid", "transactionid"], "event_order")
    rows = rows.withColumnsRenamed({"timestamp": "ts", "itemid": "aid"})
    events = sessionise(rows, gap_ms)
    sessions = session_dimension(events, min_events)
    labels = time_splits(last_event_labels(events).join(sessions.filter("label_eligible").select("session"), "session", "left_semi"), train, valid)
    sessions = sessions.join(labels.select("session", "split"), "session", "left").fillna("reference_only", ["split"])
    return events, sessions, labels


def session_length_report(sessions: DataFrame) -> DataFrame:
    """One row: counts of sessions, mean, greatest and exact quantiles of the eligible lengths, and length classes."""
    fit = F.col("label_eligible")
    length = F.when(fit, F.col("event_count"))
    bounds = {"3_5": (3, 5), "6_10": (6, 10), "11_20": (11, 20), "21_50": (21, 50), "51_100": (51, 100)}
    aggs = [F.count(F.lit(1)).alias("all_sessions"), F.count_if(fit).alias("label_eligible_sessions"), F.count_if(~fit).alias("reference_only_sessions"), F.avg(length).alias("mean"), F.max(length).alias("max")]
    aggs += [F.percentile(length, p / 100).alias(f"p{p}") for p in (50, 75, 90, 95, 99)]
    aggs += [F.count_if(length.between(a, b)).alias(f"length_{name}") for name, (a, b) in bounds.items()]
    aggs += [F.count_if(length > 100).alias("length_over_100"), F.sum(length - 2).alias("prefix_training_samples")]
    aggs += [(F.sum(F.when(fit, F.greatest(F.least(length - 1, F.lit(cap)) - 1, F.lit(0)))) / F.sum(length - 2)).alias(f"covered_{cap}") for cap in (20, 50, 100)]
    return sessions.agg(*aggs)
