"""Features of candidates, labels of tasks, and the statistics that scale them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import fusion
from tideline.operators.asof import DAY_MS
from tideline.operators.clean import fill_routes
from tideline.operators.sessions import number_rows


def item_statistics(events: DataFrame) -> DataFrame:
    """Per item: events, sessions, last time, events by action and the rates of carts and orders."""
    by_session = events.groupBy("aid", "session").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t"), *(F.count_if(F.col("type") == a).alias(a) for a in ("clicks", "carts", "orders")))
    rows = by_session.groupBy("aid").agg(F.sum("n").alias("item_events"), F.count("session").alias("item_sessions"), F.max("t").alias("item_last_ts"), *(F.sum(a).alias(f"item_{a}") for a in ("clicks", "carts", "orders")))
    return rows.withColumns({"cart_rate": F.col("item_carts") / F.greatest("item_events", F.lit(1)), "order_rate": F.col("item_orders") / F.greatest("item_events", F.lit(1))})


def candidate_features(history: DataFrame, recalled: DataFrame, sources: list[str], reference: DataFrame | None = None) -> DataFrame:
    """One row per candidate: ranks and scores by source, fusion, item statistics, session and pair context; missing is 0.

    ``ms_since_seen`` is the time between the session's last event and its last one with the item.
    """
    rows = fusion.wide(recalled, sources)
    session = history.groupBy("session", "aid").agg(F.count(F.lit(1)).alias("in_session_count"), F.max("ts").alias("__pair"))
    totals = session.groupBy("session").agg(F.sum("in_session_count").alias("session_length"), F.count(F.lit(1)).alias("session_unique_items"), F.max("__pair").alias("session_last_ts"))
    rows = rows.join(item_statistics(history if reference is None else reference), "aid", "left").join(totals, "session", "left").join(session, ["session", "aid"], "left")
    rows = rows.withColumn("ms_since_seen", F.col("session_last_ts") - F.col("__pair")).drop("__pair")
    return rows.fillna(0)


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``target_type`` and ``label``, 1 where the item is the session's target."""
    rows = features.join(labels.select("session", "target_aid", "target_type"), "session", "left")
    return rows.withColumn("label", F.coalesce((F.col("aid") == F.col("target_aid")).cast("int"), F.lit(0))).drop("target_aid")


def task_targets(labelled: DataFrame) -> DataFrame:
    """Add cumulative labels: an order is also a cart and a click. A positive of an unknown type is an error when the row is computed."""
    kind = F.col("target_type")
    known = F.when((F.col("label") == 1) & ~F.coalesce(kind.isin("clicks", "carts", "orders"), F.lit(False)), F.raise_error(F.concat(F.lit("unknown type "), F.coalesce(kind, F.lit("null")))).cast("int")).otherwise(F.col("label"))
    return labelled.withColumns({"label_clicks": known.cast("int"), "label_carts": (F.col("label") * kind.isin("carts", "orders").cast("int")).cast("int"), "label_orders": (F.col("label") * (kind == "orders").cast("int")).cast("int")})


def session_features(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample: length, different items, last item and type, and the span of its history in minutes."""
    return samples.select(
        key,
        "target_ts",
        "target_aid",
        "target_type",
        F.size("history_aids").cast("long").alias("history_length"),
        F.size(F.array_distinct("history_aids")).cast("long").alias("history_unique_items"),
        F.try_element_at("history_aids", F.lit(-1)).alias("last_aid"),
        F.try_element_at("history_type_ids", F.lit(-1)).alias("last_type_id"),
        (F.array_max("history_time_deltas_ms") / F.lit(60_000.0)).alias("session_span_minutes"),
    )


def pair_features(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample and item of its history: how often it occurs and how many places back it occurs first."""
    rows = samples.select(key, F.posexplode(F.reverse("history_aids")).alias("__p", "aid"))
    return rows.groupBy(key, "aid").agg(F.count(F.lit(1)).alias("history_candidate_count"), (F.min("__p") + 1).cast("long").alias("history_candidate_recency"))


def enrich(candidates: DataFrame, session: DataFrame, pairs: DataFrame, items: DataFrame, sources: list[str], training: bool = False, key: str = "sample_id") -> DataFrame:
    """Candidates (wide, with ``label``) with features of their session, pair and item, flags, sentinels and cumulative labels.

    ``training`` removes samples whose target was first seen at the target's time or later, or never.
    """
    base = [c for c in candidates.columns if c not in session.columns or c == key]
    rows = candidates.select(*base)
    known = items.select("aid", "categoryid", "first_seen_ts")
    last = known.select(F.col("aid").alias("last_aid"), F.coalesce("categoryid", F.lit(-1)).alias("last_categoryid"))
    own = session.join(last, "last_aid", "left").fillna(-1, ["last_categoryid"])
    if training:
        seen = known.select(F.col("aid").alias("target_aid"), F.col("first_seen_ts").alias("__f"))
        own = own.join(seen, "target_aid", "left").filter(F.col("__f") < F.col("target_ts")).drop("__f")
    rows = rows.join(own, key, "inner" if training else "left").join(pairs, [key, "aid"], "left").join(items, "aid", "left")
    category = F.coalesce("categoryid", F.lit(-1))
    rows = rows.withColumns(
        {
            "candidate_is_last": F.coalesce((F.col("aid") == F.col("last_aid")).cast("int"), F.lit(0)),
            "candidate_in_history": F.col("history_candidate_count").isNotNull().cast("int"),
            "same_category_as_last": F.coalesce(((category == F.col("last_categoryid")) & (category != -1)).cast("int"), F.lit(0)),
            "history_candidate_count": F.coalesce("history_candidate_count", F.lit(0)),
            "history_candidate_recency": F.coalesce("history_candidate_recency", F.lit(0)),
        }
    )
    return task_targets(fill_routes(rows, sources))


def moments(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """One row: mean and population deviation (at least 1e-4) of each column, rows, positives and their weight."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives")]
    for c in columns:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.greatest(F.stddev_pop(c), F.lit(math.sqrt(1e-8))).alias(f"std_{c}")]
    rows = df.agg(*aggs)
    negatives = F.col("rows") - F.col("positives")
    return rows.withColumn("pos_weight", F.least(F.lit(50.0), F.sqrt(negatives / F.greatest("positives", F.lit(1)))))


def standardise(df: DataFrame, columns: list[str], logs: list[str] | None = None) -> DataFrame:
    """Columns scaled by mean and population deviation; those in ``logs`` as ``log1p`` of their non-negative part. One row of statistics is broadcast."""
    logs = logs or []
    value = {c: (F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if c in logs else F.col(c).cast("double")) for c in columns}
    stats = df.agg(*(a for c in columns for a in (F.avg(value[c]).alias(f"__m_{c}"), F.greatest(F.stddev_pop(value[c]), F.lit(1e-4)).alias(f"__s_{c}"))))
    rows = df.join(F.broadcast(stats))
    return rows.withColumns({c: (value[c] - F.col(f"__m_{c}")) / F.col(f"__s_{c}") for c in columns}).select(*df.columns)


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """``<column>, index``: values numbered from 1 in their order, without sorting in one task; runs jobs."""
    return number_rows(df.select(column).dropna().distinct(), "index", column).withColumn("index", F.col("index") + 1)


def encode(df: DataFrame, column: str, words: DataFrame, name: str) -> DataFrame:
    """Add the index of the value, 0 for unknown ones and null."""
    return df.join(words.withColumnRenamed("index", name), column, "left").fillna(0, [name])


def action_grid(events: DataFrame, cutoff: int, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Per item: events by action and window before ``cutoff``, sessions of the last 30 days, days since first and last sight; one pass."""
    past = events.filter(F.col("ts") < cutoff)
    inside = lambda d: F.col("ts") >= cutoff - d * DAY_MS
    counts = [F.count_if((F.col("type") == a) & inside(d)).alias(f"{a}_{d}d") for a in ("clicks", "carts", "orders") for d in days]
    age = lambda c: (F.lit(cutoff) - c) / F.lit(float(DAY_MS))
    return past.groupBy("aid").agg(*counts, F.count_distinct(F.when(inside(30), F.col("session"))).alias("sessions_30d"), age(F.min("ts")).alias("age_first_days"), age(F.max("ts")).alias("age_last_days"))


def time_bucket(delta_ms: Column) -> Column:
    """Logarithmic class of a time difference, from 1 to 32."""
    seconds = F.greatest(F.floor(delta_ms / 1000), F.lit(0))
    return (F.least(F.lit(31), F.floor(F.log2(seconds + 1.0))) + 1).cast("long")


def category_relation(history_paths: str, path: str) -> Column:
    """How a target's category path relates to those of the history: exact, same_parent, same_root or other."""
    target = F.col(path)
    parent = lambda p: F.when(F.size(p) >= 2, F.element_at(p, -2))
    return (
        F.when(F.exists(history_paths, lambda p: F.element_at(p, -1) == F.element_at(target, -1)), "exact")
        .when(F.exists(history_paths, lambda p: F.coalesce(parent(p) == parent(target), F.lit(False))), "same_parent")
        .when(F.exists(history_paths, lambda p: p[0] == target[0]), "same_root")
        .otherwise("other")
    )
