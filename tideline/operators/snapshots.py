"""Indexes as of many points in time at once.

Instead of building an index per snapshot, each event's contribution is written once, as a change at a day, and a snapshot sums the
changes of the days before it. Only the sources that some snapshot asks for are summed. A snapshot time is a multiple of the interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.asof import DAY_MS
from tideline.operators.indexes import ranked_within, session_pairs, weight


def floor_to(column: str, interval: int) -> Column:
    """Start of the interval that holds a time."""
    return F.col(column) - F.pmod(F.col(column), F.lit(interval))


def popularity_at(events: DataFrame, snapshots: DataFrame, n: int, interval: int = DAY_MS) -> DataFrame:
    """``snapshot_ts, aid, score, rank``: the most frequent items before each snapshot; counted per day, then summed up to it.

    Each item's days are cumulated once; a snapshot takes the item's last sum before it, as an interval join of (item, day) spans with the
    few snapshots.
    """
    daily = events.groupBy("aid", floor_to("ts", interval).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("aid").orderBy("day")
    spans = daily.select("aid", (F.col("day") + interval).alias("__from"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("score"), (F.lead("day").over(w) + interval).alias("__to"))
    points = snapshots.select("snapshot_ts").distinct()
    rows = spans.join(F.broadcast(points), (F.col("snapshot_ts") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("snapshot_ts") < F.col("__to"))))
    return ranked_within(rows.select("snapshot_ts", "aid", F.col("score").cast("double").alias("score")), ["snapshot_ts"], n)


def cf_changes(events: DataFrame, interval: int = DAY_MS, block: int = 2048) -> DataFrame:
    """``src, dst, day, delta``: changes of the co-occurrence sums at the end of each day.

    A session that goes on the next day and meets new items changes the weight of its old pairs too, since the weight falls with the
    number of items; so each of its days writes the difference to the day before. Pairs are formed by :func:`session_pairs`.
    """
    first = events.groupBy("session", "aid").agg(F.min(floor_to("ts", interval)).alias("day"))
    per_day = first.groupBy("session", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session").orderBy("day")
    size = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    value = F.lit(1.0) / F.log2(F.lit(2.0) + F.col("__size"))
    days = per_day.withColumn("__size", size).withColumn("now", value).withColumn("before", F.lag("now").over(w))
    days = days.groupBy("session").agg(F.collect_list(F.struct(F.col("day").alias("at"), "now", "before")).alias("days"))  # one entry a day
    pairs = session_pairs(first.join(days, "session"), ["day", "days"], block).filter(F.col("src") != F.col("dst"))
    met = F.greatest("__l_day", "__r_day")
    rows = pairs.select("src", "dst", met.alias("met"), F.explode(F.filter("__l_days", lambda d: d["at"] >= met)).alias("d"))
    delta = F.col("d.now") - F.when(F.col("d.at") > F.col("met"), F.col("d.before")).otherwise(0.0)
    return rows.groupBy("src", "dst", F.col("d.at").alias("day")).agg(F.sum(delta).alias("delta"))


def session_counts(events: DataFrame, interval: int = DAY_MS) -> DataFrame:
    """``aid, day, n``: sessions in which the item appears first on that day."""
    return events.groupBy("session", "aid").agg(F.min(floor_to("ts", interval)).alias("day")).groupBy("aid", "day").agg(F.count(F.lit(1)).alias("n"))


def itemcf_at(events: DataFrame, wanted: DataFrame, n: int, interval: int = DAY_MS) -> DataFrame:
    """``snapshot_ts, src, dst, score, rank`` for the pairs ``snapshot_ts, src`` of ``wanted``."""
    asked = wanted.select("snapshot_ts", "src").distinct()
    sums = asked.join(cf_changes(events, interval), "src").filter(F.col("day") < F.col("snapshot_ts")).groupBy("snapshot_ts", "src", "dst").agg(F.sum("delta").alias("s"))
    counts = session_counts(events, interval)
    items = sums.select("snapshot_ts", F.col("src").alias("aid")).unionByName(sums.select("snapshot_ts", F.col("dst").alias("aid"))).distinct()
    known = items.join(counts, "aid").filter(F.col("day") < F.col("snapshot_ts")).groupBy("snapshot_ts", "aid").agg(F.sum("n").alias("n"))
    rows = sums.join(known.select("snapshot_ts", F.col("aid").alias("src"), F.col("n").alias("a")), ["snapshot_ts", "src"]).join(known.select("snapshot_ts", F.col("aid").alias("dst"), F.col("n").alias("b")), ["snapshot_ts", "dst"])
    scored = rows.select("snapshot_ts", "src", "dst", (F.col("s") / F.sqrt((F.col("a") * F.col("b")).cast("double"))).alias("score"))
    return ranked_within(scored, ["snapshot_ts", "src"], n, "score", "dst")


def transitions_at(events: DataFrame, wanted: DataFrame, n: int, steps: int = 3, interval: int = DAY_MS) -> DataFrame:
    """As :func:`itemcf_at` for directed moves; a move belongs to the day of its later event."""
    w = Window.partitionBy("session").orderBy("ts", "event_order")
    nexts = F.array(*(F.struct(F.lit(d).alias("d"), F.lead("aid", d).over(w).alias("dst"), F.lead("ts", d).over(w).alias("t"), F.lead("type", d).over(w).alias("k")) for d in range(1, steps + 1)))
    rows = events.select(F.col("aid").alias("src"), "ts", nexts.alias("nexts")).select("src", "ts", F.explode("nexts").alias("n")).select("src", "ts", "n.*").filter((F.col("t") > F.col("ts")) & (F.col("src") != F.col("dst")))
    minutes = (F.col("t") - F.col("ts")) / F.lit(60_000.0)
    score = weight("k") * (F.exp(-minutes / F.lit(30.0)) + F.lit(0.2) * F.exp(-minutes / F.lit(1440.0))) / F.col("d")
    daily = rows.groupBy("src", "dst", floor_to("t", interval).alias("day")).agg(F.sum(score).alias("delta"))
    asked = wanted.select("snapshot_ts", "src").distinct()
    sums = asked.join(daily, "src").filter(F.col("day") < F.col("snapshot_ts")).groupBy("snapshot_ts", "src", "dst").agg(F.sum("delta").alias("score"))
    return ranked_within(sums, ["snapshot_ts", "src"], n, "score", "dst")


def point_in_time(events: DataFrame, samples: DataFrame, per_source: int = 50, interval: int = DAY_MS) -> DataFrame:
    """Candidates of each sample from indexes as of the start of its target's interval.

    ``samples``: ``session, target_ts, history_aids``. Routes: recent, popular, itemcf and transition, each cut at ``per_source``; columns
    ``session, snapshot_ts, aid, source, source_rank, source_score``. No event at or after a sample's snapshot takes part, except its own history.
    """
    rows = samples.withColumn("snapshot_ts", floor_to("target_ts", interval))
    recent = F.array_distinct(F.reverse("history_aids"))
    seeds = rows.select("session", "snapshot_ts", F.posexplode(F.slice(recent, 1, 5)).alias("recency", "src"))
    own = rows.select("session", "snapshot_ts", F.posexplode(F.slice(recent, 1, per_source)).alias("recency", "aid"))
    parts = [own.select("session", "snapshot_ts", "aid", F.lit("recent").alias("source"), (F.col("recency") + 1).cast("long").alias("source_rank"), (F.lit(1.0) / (F.col("recency") + 1)).alias("source_score"))]
    popular = popularity_at(events, rows, per_source, interval)
    parts.append(rows.select("session", "snapshot_ts").join(popular, "snapshot_ts").select("session", "snapshot_ts", "aid", F.lit("popular").alias("source"), F.col("rank").alias("source_rank"), (F.lit(1.0) / F.col("rank")).alias("source_score")))
    for source, index in (("itemcf", itemcf_at(events, seeds, 100, interval)), ("transition", transitions_at(events, seeds, 200, interval=interval))):
        sums = seeds.join(index, ["snapshot_ts", "src"]).groupBy("session", "snapshot_ts", F.col("dst").alias("aid")).agg(F.sum(F.col("score") / (F.col("recency") + 1)).alias("score"))
        parts.append(ranked_within(sums, ["session", "snapshot_ts"], per_source).select("session", "snapshot_ts", "aid", F.lit(source).alias("source"), F.col("rank").alias("source_rank"), F.col("score").alias("source_score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def snapshot_audit(events: DataFrame, samples: DataFrame, interval: int = DAY_MS) -> DataFrame:
    """``snapshot_ts, samples, reference_events, catalog_items, max_reference_ts`` per snapshot, to show that none sees a later event."""
    points = samples.select(floor_to("target_ts", interval).alias("snapshot_ts")).groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("samples"))
    daily = events.groupBy(floor_to("ts", interval).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t"))
    births = events.groupBy("aid").agg(F.min(floor_to("ts", interval)).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("b"))
    days = daily.join(births, "day", "left")
    rows = F.broadcast(points).join(days, F.col("day") < F.col("snapshot_ts"), "left").groupBy("snapshot_ts", "samples").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reference_events"), F.coalesce(F.sum("b"), F.lit(0)).alias("catalog_items"), F.coalesce(F.max("t"), F.lit(-1)).alias("max_reference_ts"))
    return rows
