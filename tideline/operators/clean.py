"""Cleaning, filtering and selecting event logs. All operators are lazy except where noted; empty inputs give empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.checks import require_columns
from tideline.session import settle

#: Names of raw events and their canonical types.
EVENT_TYPES = {"view": "clicks", "addtocart": "carts", "transaction": "orders"}


def map_types(events: DataFrame, raw: str = "event", mapping: dict[str, str] | None = None) -> DataFrame:
    """Replace the raw event name by the canonical ``type``; rows of unknown or null names go."""
    pairs = F.create_map(*(F.lit(x) for pair in (mapping or EVENT_TYPES).items() for x in pair))
    return events.withColumn("type", pairs[F.col(raw)]).filter(F.col("type").isNotNull()).drop(*({raw} - {"type"}))


def drop_copies(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that agree in ``keys`` (null equals null) the one with the least ``order`` stays.

    Copies are reduced before the shuffle: a struct minimum per key, so a group of copies never meets in one task.
    """
    rest = [c for c in events.columns if c not in keys and c != order]
    first = events.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__first")) if _ordered(events, rest) else None
    if first is not None:
        return first.select(*keys, "__first.*").select(*events.columns)
    w = Window.partitionBy(*keys).orderBy(order)
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _ordered(df: DataFrame, columns: list[str]) -> bool:
    return not any(df.schema[c].dataType.typeName() in ("map", "variant") for c in columns)


def clean_changes(changes: DataFrame, item: str = "itemid", time: str = "timestamp", value: str = "categoryid") -> DataFrame:
    """State changes without copies, without all rows of an item's instant with different values, and without repeats of the value before.

    Rows with a null in one of the three columns go. The clean-up by instant is pre-aggregated; the comparison with the value
    before runs per item.
    """
    rows = changes.select(item, time, value).dropna().groupBy(item, time).agg(F.min(value).alias(value), F.max(value).alias("__high"))
    rows = rows.filter(F.col(value) == F.col("__high")).drop("__high")
    w = Window.partitionBy(item).orderBy(time)
    return rows.withColumn("__before", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")


def drop_ambiguous(events: DataFrame, session: str = "session", time: str = "ts") -> DataFrame:
    """Without the sessions whose greatest time belongs to more than one event."""
    ends = events.groupBy(session, time).agg(F.count(F.lit(1)).alias("__n")).groupBy(session).agg(F.max_by("__n", time).alias("__n"))
    return events.join(ends.filter("__n > 1").select(session), session, "left_anti")


def top_items(events: DataFrame, n: int, item: str = "aid") -> DataFrame:
    """The ``n`` items with most rows, ties to the smaller one."""
    return events.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), item).limit(n).select(item)


def restrict_catalogue(events: DataFrame, n: int | None, item: str = "aid") -> DataFrame:
    """Events of the ``n`` most frequent items; all of them if ``n`` is None."""
    return events if n is None else events.join(top_items(events, n, item), item, "left_semi").select(*events.columns)


def min_session_length(events: DataFrame, n: int, session: str = "session") -> DataFrame:
    """Events of the sessions with ``n`` events or more; lengths are counted before the shuffle of the events."""
    kept = events.groupBy(session).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n).select(session)
    return events.join(kept, session, "left_semi").select(*events.columns)


def earliest_sessions(events: DataFrame, n: int, session: str = "session", time: str = "ts") -> DataFrame:
    """Events of the ``n`` sessions that start first, ties to the smaller session."""
    first = events.groupBy(session).agg(F.min(time).alias("__t")).orderBy("__t", session).limit(n).select(session)
    return events.join(first, session, "left_semi").select(*events.columns)


def prepare_events(events: DataFrame, catalogue: int | None, sessions: int, min_length: int) -> DataFrame:
    """Sessionised events cut to a catalogue, to sessions of some length with a unique last event, and to the first ``sessions`` by original start."""
    starts = events.groupBy("session").agg(F.min("ts").alias("__start"))
    rows = drop_ambiguous(min_session_length(restrict_catalogue(events, catalogue), min_length))
    first = starts.join(rows.select("session").distinct(), "session", "left_semi").orderBy("__start", "session").limit(sessions)
    return rows.join(first.select("session"), "session", "left_semi").select(*events.columns)


def k_core(pairs: DataFrame, user: str, item: str, min_user: int, min_item: int, max_rounds: int = 50) -> DataFrame:
    """Rows left when users with fewer than ``min_user`` and items with fewer than ``min_item`` rows are removed until none is left to remove.

    Runs a job a round. Only the counted (user, item) pairs iterate, each round settled in the shared folder; the rows are joined once.
    """
    core = settle(pairs.groupBy(user, item).agg(F.count(F.lit(1)).alias("__n")))
    left = core.count()
    for _ in range(max_rounds):
        for key, least in ((user, min_user), (item, min_item)):
            kept = core.groupBy(key).agg(F.sum("__n").alias("__s")).filter(F.col("__s") >= least).select(key)
            core = core.join(kept, key, "left_semi")
        core = settle(core.select(user, item, "__n"))
        now = core.count()
        if now == left:
            return pairs.join(core.select(user, item), [user, item], "left_semi").select(*pairs.columns)
        left = now
    raise RuntimeError("no fix-point within max_rounds")


def limit_catalogue(pairs: DataFrame, user: str, item: str, items: int, users: int, min_user: int, min_item: int) -> DataFrame:
    """The most frequent items, of these rows the most active users, and the k-core of what is left."""
    rows = restrict_catalogue(pairs, items, item)
    rows = restrict_catalogue(rows, users, user)
    return k_core(rows, user, item, min_user, min_item)


def threshold_events(events: DataFrame, ratio: str, min_ratio: float, duration: str, min_duration: float) -> DataFrame:
    """Rows that reach both thresholds; nulls don't."""
    return events.filter((F.col(ratio) >= min_ratio) & (F.col(duration) >= min_duration))


def label_feedback(events: DataFrame, positive: Column, user: str, item: str, min_user: int, min_item: int) -> DataFrame:
    """Events of the users and items of the positives' k-core, with ``is_positive``; negatives stay as context."""
    core = k_core(events.filter(positive), user, item, min_user, min_item)
    rows = events.join(core.select(user).distinct(), user, "left_semi").join(core.select(item).distinct(), item, "left_semi")
    return rows.withColumn("is_positive", F.coalesce(positive, F.lit(False)).cast("int")).select(*events.columns, *(["is_positive"] if "is_positive" not in events.columns else []))


def warmup_split(events: DataFrame, label_start: int, days: int, day_length: int, max_sessions: int | None = None) -> DataFrame:
    """``part`` formal: events of sessions that end at ``label_start`` or later (the first ``max_sessions`` of them by end);
    warm-up: of sessions that lie wholly in the ``days`` before it. Other events go."""
    ends = events.groupBy("session").agg(F.min("ts").alias("__from"), F.max("ts").alias("__to"))
    formal = ends.filter(F.col("__to") >= label_start)
    if max_sessions is not None:
        formal = formal.orderBy("__to", "session").limit(max_sessions)
    warm = ends.filter((F.col("__from") >= label_start - days * day_length) & (F.col("__to") < label_start))
    parts = formal.select("session", F.lit("formal").alias("part")).unionByName(warm.select("session", F.lit("warmup").alias("part")))
    return events.join(parts, "session")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Null, NaN and infinite numbers become 0."""
    clean = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.col(c)) for c in columns}
    return df.withColumns(clean)


def fill_routes(df: DataFrame, sources: list[str], missing_rank: int = 10_000) -> DataFrame:
    """Presence flags ``source_present_<s>`` and sentinels for missing ranks and scores."""
    out = {}
    for s in sources:
        out[f"source_present_{s}"] = F.col(f"source_rank_{s}").isNotNull().cast("int")
        out[f"source_rank_{s}"] = F.coalesce(F.col(f"source_rank_{s}"), F.lit(missing_rank))
        out[f"source_score_{s}"] = F.coalesce(F.col(f"source_score_{s}"), F.lit(0.0))
    return df.withColumns(out)


def subsample_frequent(events: DataFrame, threshold: float, seed: int, item: str = "aid", keys: tuple[str, ...] = ("event_order",)) -> DataFrame:
    """Keep each event with the probability ``min(1, sqrt(t / f) + t / f)``, ``f`` the share of its item; the draw is a hash of ``keys``."""
    counts = events.groupBy(item).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    share = F.col("__n") / F.col("__all")
    keep = counts.join(F.broadcast(total)).select(item, F.least(F.lit(1.0), F.sqrt(F.lit(threshold) / share) + F.lit(threshold) / share).alias("__keep"))
    return events.join(keep, item).filter(uniform(seed, *keys) < F.col("__keep")).select(*events.columns)


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mask_columns(df: DataFrame, raw_means: dict[str, float]) -> DataFrame:
    """Columns replaced by the raw value that standardises to zero."""
    return df.withColumns({c: F.lit(float(v)) for c, v in raw_means.items()})


def hash_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows drawn by the hash of their keys; the same rows each time."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def check_events(events: DataFrame) -> DataFrame:
    """ValueError unless the four canonical columns are there."""
    return require_columns(events, "session", "aid", "ts", "type")
