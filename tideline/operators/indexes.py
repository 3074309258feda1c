"""Popularity, co-occurrence, transition and category indexes, frozen at a cut-off.

Ranks are by the score rounded to nine decimals, then the smaller item, so that equal sums rank alike in any order of addition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.asof import DAY_MS, latest_state

WEIGHTS = {"clicks": 1.0, "carts": 3.0, "orders": 6.0}
#: How many items of the click, cart and order lists each stage of a session takes.
STAGE_QUOTAS = {"click": (36, 18, 6), "cart": (12, 24, 24), "order": (6, 12, 42)}


def weight(column: str = "type", weights: dict[str, float] | None = None) -> Column:
    """Weight of an event's type."""
    return F.create_map(*(F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair))[F.col(column)]


def ranked(df: DataFrame, n: int, score: str = "score", item: str = "aid") -> DataFrame:
    """The ``n`` best rows with ``rank`` from 1, by a distributed top-n; only these few are numbered."""
    best = df.withColumn("__s", F.round(score, 9)).orderBy(F.desc("__s"), item).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__s"), item)).cast("long")).drop("__s")


def ranked_within(df: DataFrame, group: list[str], n: int, score: str = "score", item: str = "aid") -> DataFrame:
    """The ``n`` best rows of each group with ``rank`` from 1."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.round(score, 9)), item)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def popularity(events: DataFrame, n: int = 200) -> DataFrame:
    """``aid, score, rank``: the most frequent items."""
    return ranked(events.groupBy("aid").agg(F.count(F.lit(1)).cast("double").alias("score")), n)


def popularity_windows(events: DataFrame, cutoff: int, days: tuple[int | None, ...] = (1, 7, 30, None), n: int = 200) -> DataFrame:
    """``window, aid, events, rank``: the most frequent items of the last days before ``cutoff``; all windows are counted in one pass."""
    past = events.filter(F.col("ts") < cutoff)
    name = lambda d: "all" if d is None else f"{d}d"
    counts = past.groupBy("aid").agg(*(F.count_if(F.lit(True) if d is None else F.col("ts") >= cutoff - d * DAY_MS).alias(name(d)) for d in days))
    long = counts.select("aid", F.explode(F.array(*(F.struct(F.lit(name(d)).alias("window"), F.col(name(d)).alias("events")) for d in days))).alias("w")).select("w.window", "aid", "w.events").filter("events > 0")
    return ranked_within(long, ["window"], n, "events")


def _age_days(cutoff: int) -> Column:
    return (F.lit(cutoff) - F.col("ts")) / F.lit(float(DAY_MS))


def trend(events: DataFrame, cutoff: int, n: int = 200) -> DataFrame:
    """``aid, score, rank``: weighted events before ``cutoff`` that fade within days, with a slower tail."""
    age = _age_days(cutoff)
    score = weight() * (F.exp(-age) + F.lit(0.3) * F.exp(-age / F.lit(7.0)))
    return ranked(events.filter(F.col("ts") < cutoff).groupBy("aid").agg(F.sum(score).alias("score")), n)


def new_items(events: DataFrame, cutoff: int, n: int = 200, days: int = 30) -> DataFrame:
    """``aid, score, rank`` of the items first seen in the last ``days``: fading weighted events, divided by the root of the item's age.

    The first sight and the sum come from one aggregation: the divisor depends on the item only.
    """
    past = events.filter(F.col("ts") < cutoff)
    rows = past.groupBy("aid").agg(F.min("ts").alias("__first"), F.sum(weight() * F.exp(-_age_days(cutoff) / F.lit(7.0))).alias("__sum"))
    rows = rows.filter(F.col("__first") >= cutoff - days * DAY_MS)
    age = (F.lit(cutoff) - F.col("__first")) / F.lit(float(DAY_MS))
    return ranked(rows.select("aid", (F.col("__sum") / F.sqrt(age + F.lit(1.0))).alias("score")), n)


def weighted_popularity(events: DataFrame, cutoff: int, n: int = 200) -> DataFrame:
    """``aid, score, rank`` by weighted events before ``cutoff``."""
    return ranked(events.filter(F.col("ts") < cutoff).groupBy("aid").agg(F.sum(weight()).alias("score")), n)


def merge_with_budget(lists: DataFrame, budget: int) -> DataFrame:
    """``stage, aid, rank``: per stage the parts in order, each giving up to ``quota`` items that aren't there yet; the part with a
    null quota fills up to ``budget``.

    ``lists`` (``stage, part, rank, aid, quota``) are short ranked lists, of a few hundred items whatever the log holds, so one
    stage is merged in one piece.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, None] = {}
        for _, part in rows.sort_values(["part", "rank"]).groupby("part", sort=True):
            quota, added = part["quota"].iloc[0], 0
            for aid in part["aid"]:
                if len(out) >= budget or (pd.notna(quota) and added >= quota):
                    break
                if aid not in out:
                    out[aid] = None
                    added += 1
        return pd.DataFrame({"stage": rows["stage"].iloc[0], "aid": list(out), "rank": range(1, len(out) + 1)})

    return lists.groupBy("stage").applyInPandas(merge, "stage string, aid long, rank long")


def hybrid_popularity(events: DataFrame, cutoff: int, budget: int = 100, n: int = 200, days: int = 30) -> DataFrame:
    """``stage, aid, rank``: for sessions at the click, cart and order stage a mix of the lists by action, of :func:`trend` and of
    :func:`new_items`, filled up by :func:`weighted_popularity`. One aggregation per item gives the scores of all six lists."""
    age = _age_days(cutoff)
    sums = [F.count_if(F.col("type") == action).cast("double").alias(action) for action in WEIGHTS]
    sums += [F.sum(weight() * (F.exp(-age) + F.lit(0.3) * F.exp(-age / F.lit(7.0)))).alias("trend"), F.sum(weight() * F.exp(-age / F.lit(7.0))).alias("__fading"), F.sum(weight()).alias("all"), F.min("ts").alias("__first")]
    items = events.filter(F.col("ts") < cutoff).groupBy("aid").agg(*sums)
    fresh = F.col("__fading") / F.sqrt((F.lit(cutoff) - F.col("__first")) / F.lit(float(DAY_MS)) + F.lit(1.0))
    items = items.withColumn("new", F.when(F.col("__first") >= cutoff - days * DAY_MS, fresh))
    parts = [*WEIGHTS, "trend", "new", "all"]
    scores = F.array(*(F.struct(F.lit(i).alias("part"), (F.when(F.col(c) > 0, F.col(c)) if c in WEIGHTS else F.col(c)).alias("score")) for i, c in enumerate(parts)))
    long = items.select("aid", F.explode(scores).alias("s")).select("s.part", F.col("aid").cast("long").alias("aid"), "s.score").filter(F.col("score").isNotNull())
    quotas = [(stage, i, q[i] if i < 3 else 20 if i < 5 else None) for stage, q in STAGE_QUOTAS.items() for i in range(6)]
    stages = events.sparkSession.createDataFrame(quotas, "stage string, part int, quota int")
    return merge_with_budget(ranked_within(long, ["part"], n).join(F.broadcast(stages), "part").select("stage", "part", "rank", "aid", "quota"), budget)


def session_pairs(held: DataFrame, carried: list[str], block: int = 2048) -> DataFrame:
    """``src, dst`` and ``__l_<c>``, ``__r_<c>`` of the carried columns, for all ordered pairs of rows of one session (``session, aid`` unique).

    A session of more than ``block`` items is cut into blocks and each pair of blocks is a join key of its own, so that a long session's
    pairs are spread over many tasks; its rows are repeated as often as it has blocks.
    """
    sizes = held.groupBy("session").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("__parts"))
    cut = held.join(sizes, "session").withColumn("__own", F.pmod(F.xxhash64("aid"), F.col("__parts").cast("long")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    left = cut.select("session", F.col("__own").alias("__x"), every.alias("__y"), F.col("aid").alias("src"), *(F.col(c).alias(f"__l_{c}") for c in carried))
    right = cut.select("session", F.col("__own").alias("__y"), every.alias("__x"), F.col("aid").alias("dst"), *(F.col(c).alias(f"__r_{c}") for c in carried))
    return left.join(right, ["session", "__x", "__y"]).drop("__x", "__y", "session")


def item_cf(events: DataFrame, n: int = 100, block: int = 2048) -> DataFrame:
    """``src, dst, score, rank``: items of the same sessions, long sessions counting less, normalised by both items' numbers of sessions.

    Items are made distinct per session before they are paired (:func:`session_pairs`), and each unordered pair is summed once.
    """
    held = events.select("session", "aid").dropna().distinct()
    sizes = held.groupBy("session").agg((F.lit(1.0) / F.log2(F.lit(2.0) + F.count(F.lit(1)))).alias("__w"))
    counts = held.groupBy("aid").agg(F.count(F.lit(1)).alias("__n"))
    pairs = session_pairs(held.join(sizes, "session"), ["__w"], block)
    sums = pairs.filter(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.sum("__l___w").alias("__s"))
    a, b = counts.select(F.col("aid").alias("src"), F.col("__n").alias("__a")), counts.select(F.col("aid").alias("dst"), F.col("__n").alias("__b"))
    scored = sums.join(a, "src").join(b, "dst").withColumn("score", F.col("__s") / F.sqrt((F.col("__a") * F.col("__b")).cast("double")))
    both = scored.select(F.explode(F.array(F.struct("src", "dst", "score"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))).alias("e")).select("e.*")
    return ranked_within(both, ["src"], n, "score", "dst")


def transitions(events: DataFrame, n: int = 200, steps: int = 3) -> DataFrame:
    """``src, dst, score, rank``: directed moves to one of the next ``steps`` events of the session, if later and another item.

    The weight is the right event's, fading with the gap and divided by the distance. Done with ``lead``, not with a join.
    """
    w = Window.partitionBy("session").orderBy("ts", "event_order")
    nexts = F.array(*(F.struct(F.lit(d).alias("d"), F.lead("aid", d).over(w).alias("dst"), F.lead("ts", d).over(w).alias("t"), F.lead("type", d).over(w).alias("k")) for d in range(1, steps + 1)))
    rows = events.select(F.col("aid").alias("src"), "ts", nexts.alias("nexts")).select("src", "ts", F.explode("nexts").alias("n")).select("src", "ts", "n.*")
    rows = rows.filter((F.col("t") > F.col("ts")) & (F.col("src") != F.col("dst")))
    minutes = (F.col("t") - F.col("ts")) / F.lit(60_000.0)
    score = weight("k") * (F.exp(-minutes / F.lit(30.0)) + F.lit(0.2) * F.exp(-minutes / F.lit(1440.0))) / F.col("d")
    return ranked_within(rows.groupBy("src", "dst").agg(F.sum(score).alias("score")), ["src"], n, "score", "dst")


def category_popularity(enriched: DataFrame, cutoff: int, n: int = 200, category: str = "categoryid") -> DataFrame:
    """``category, aid, score, rank``: fading weighted events of the category known at the event, before ``cutoff``; -1 and null don't count."""
    age = _age_days(cutoff)
    score = weight() * (F.exp(-age / F.lit(7.0)) + F.lit(0.2) * F.exp(-age / F.lit(30.0)))
    rows = enriched.filter((F.col("ts") < cutoff) & (F.col(category) != -1)).groupBy(F.col(category).alias("category"), "aid").agg(F.sum(score).alias("score"))
    return ranked_within(rows, ["category"], n)


def skipgram_pairs(events: DataFrame, vocabulary: DataFrame | None = None, window: int = 5) -> DataFrame:
    """``center, context, weight`` of all ordered pairs at most ``window`` positions apart in a session, positions counted within the vocabulary.

    The weight is the geometric mean of the two events' weights. Done with ``lead`` on bounded frames.
    """
    rows = events if vocabulary is None else events.join(vocabulary, "aid", "left_semi")
    w = Window.partitionBy("session").orderBy("ts", "event_order")
    rows = rows.select("aid", weight().alias("__w"), F.collect_list(F.struct("aid", weight().alias("w"))).over(w.rowsBetween(1, window)).alias("__n"))
    pairs = rows.select("aid", "__w", F.explode("__n").alias("n")).select(F.col("aid").alias("a"), F.col("n.aid").alias("b"), F.sqrt(F.col("__w") * F.col("n.w")).alias("weight"))
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context"), "weight"), F.struct(F.col("b").alias("center"), F.col("a").alias("context"), "weight"))).alias("p")).select("p.*")


def adaptive_pairs(events: DataFrame) -> DataFrame:
    """``center, context, weight``: as :func:`skipgram_pairs`, the radius being half the session's length, from 5 to 10, and distances
    beyond 3 fading. Lengths are rounded half to even."""
    w = Window.partitionBy("session").orderBy("ts", "event_order")
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    rows = events.select("aid", n.alias("__len"), F.collect_list("aid").over(w.rowsBetween(1, 10)).alias("__n"))
    radius = F.least(F.lit(10), F.greatest(F.lit(5), F.bround(F.col("__len") * F.lit(0.5)).cast("int")))
    pairs = rows.select("aid", radius.alias("__r"), F.posexplode("__n").alias("p", "other")).filter(F.col("p") < F.col("__r"))
    d = F.col("p") + 1
    weighted = pairs.select(F.col("aid").alias("a"), F.col("other").alias("b"), F.when(d <= 3, F.lit(1.0)).otherwise(F.exp(F.lit(-0.2) * (d - 3))).alias("weight"))
    return weighted.select(F.explode(F.array(F.struct(F.col("a").alias("center"), F.col("b").alias("context"), "weight"), F.struct(F.col("b").alias("center"), F.col("a").alias("context"), "weight"))).alias("p")).select("p.*")


def session_matrix(events: DataFrame) -> DataFrame:
    """``session, aid, value``: summed weights of each item of a session."""
    return events.groupBy("session", "aid").agg(F.sum(weight()).alias("value"))


def freeze(events: DataFrame, enriched: DataFrame, categories: DataFrame, cutoff: int, n: int = 200) -> dict[str, DataFrame]:
    """All indexes of the events before ``cutoff``."""
    past = events.filter(F.col("ts") < cutoff)
    return {
        "catalog": past.select("aid").distinct(),
        "popularity": popularity_windows(past, cutoff, n=n),
        "hybrid_popularity": hybrid_popularity(past, cutoff),
        "itemcf": item_cf(past, n),
        "transition": transitions(past, n),
        "category_popularity": category_popularity(enriched, cutoff, n),
        "item_category": latest_state(categories, cutoff, "categoryid").select(F.col("itemid").alias("aid"), F.col("categoryid").alias("category")),
    }
