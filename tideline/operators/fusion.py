"""Union, pivot, fusion and cutting of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import settle

RRF_K = 60


def distinct_union(candidates: DataFrame) -> DataFrame:
    """One row per session, item and source: least rank, greatest score."""
    return candidates.groupBy("session", "aid", "source").agg(F.min("source_rank").alias("source_rank"), F.max("source_score").alias("source_score"))


def rrf_summary(candidates: DataFrame) -> DataFrame:
    """``session, aid, rrf_score, source_count, best_source_rank``: reciprocal ranks summed over the rows."""
    return candidates.groupBy("session", "aid").agg(
        F.sum(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("source_rank"))).alias("rrf_score"),
        F.count_distinct("source").alias("source_count"),
        F.min("source_rank").alias("best_source_rank"),
    )


def pivot(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """One row per session and item with ``source_rank_<s>`` (least) and ``source_score_<s>`` (greatest) of the listed sources.

    Conditional aggregates over a fixed list: one shuffle, no job to find the sources.
    """
    aggs = []
    for s in sources:
        own = F.col("source") == s
        aggs += [F.min(F.when(own, F.col("source_rank"))).alias(f"source_rank_{s}"), F.max(F.when(own, F.col("source_score"))).alias(f"source_score_{s}")]
    return candidates.groupBy("session", "aid").agg(*aggs)


def wide(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """:func:`rrf_summary` and :func:`pivot` in one aggregation."""
    aggs = []
    for s in sources:
        own = F.col("source") == s
        aggs += [F.min(F.when(own, F.col("source_rank"))).alias(f"source_rank_{s}"), F.max(F.when(own, F.col("source_score"))).alias(f"source_score_{s}")]
    return candidates.groupBy("session", "aid").agg(
        F.sum(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("source_rank"))).alias("rrf_score"),
        F.size(F.collect_set("source")).cast("long").alias("source_count"),
        F.min("source_rank").alias("best_source_rank"),
        *aggs,
    )


def merge_pools(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two pools with their fusion columns put together: scores and counts added, the better rank kept."""
    own = [c for c in left.columns if c not in [*keys, "rrf_score", "source_count", "best_source_rank"]]
    other = [c for c in right.columns if c not in [*keys, "rrf_score", "source_count", "best_source_rank"]]
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))
    return both.select(*keys, zero("rrf_score").alias("rrf_score"), zero("source_count").alias("source_count"), F.least("a.best_source_rank", "b.best_source_rank").alias("best_source_rank"), *(F.col(f"a.{c}") for c in own), *(F.col(f"b.{c}") for c in other if c not in own))


def compact(candidates: DataFrame, samples: DataFrame, sources: list[str], max_negatives: int, topk: int, inject: bool = True, prioritise: bool = True) -> DataFrame:
    """One wide row per candidate with ``label`` and ``target_type``, cut per session.

    ``prioritise``: the positive and the ``max_negatives`` best others; without it, labels don't matter and the ``max_negatives``
    best candidates stay. 0 keeps all. ``inject`` adds missing positives with a score and count of 0 and the rank ``topk + 1``. Order: fusion
    score (nine decimals), number of sources, smaller item.
    """
    targets = samples.select("session", "target_aid", "target_type").distinct()
    rows = wide(candidates, sources).join(targets.select("session", "target_aid"), "session", "left")
    rows = rows.withColumn("label", F.coalesce((F.col("aid") == F.col("target_aid")).cast("int"), F.lit(0))).drop("target_aid")
    if inject:
        there = rows.filter("label = 1").select("session")
        added = targets.join(there, "session", "left_anti").select("session", F.col("target_aid").alias("aid"), F.lit(0.0).alias("rrf_score"), F.lit(0).cast("long").alias("source_count"), F.lit(topk + 1).cast(rows.schema["best_source_rank"].dataType).alias("best_source_rank"), F.lit(1).alias("label"))
        rows = rows.unionByName(added, allowMissingColumns=True)
    if max_negatives > 0:
        best = [F.desc(F.round("rrf_score", 9)), F.desc("source_count"), "aid"]
        if prioritise:
            w = Window.partitionBy("session", "label").orderBy(*best)
            rows = rows.withColumn("__n", F.row_number().over(w)).filter((F.col("label") == 1) | (F.col("__n") <= max_negatives)).drop("__n")
        else:
            w = Window.partitionBy("session").orderBy(*best)
            rows = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_negatives).drop("__n")
    return rows.join(targets.select("session", "target_type"), "session", "left")


def heuristic_score(sources: list[str]) -> Column:
    """Sum of reciprocal ranks over the columns ``source_rank_<s>``; null and 0 mean that the source is missing."""
    parts = [F.coalesce(F.lit(1.0) / (F.lit(float(RRF_K)) + F.nullif(F.col(f"source_rank_{s}").cast("double"), F.lit(0.0))), F.lit(0.0)) for s in sources]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def probability_fusion(click: str = "p_click", cart: str = "p_cart", order: str = "p_order", weights: tuple[float, float, float] = (0.05, 0.30, 0.40)) -> Column:
    """Weighted sum of the three action probabilities."""
    return F.lit(weights[0]) * F.col(click) + F.lit(weights[1]) * F.col(cart) + F.lit(weights[2]) * F.col(order)


def cap_negatives(labelled: DataFrame, most: int, seed: int) -> DataFrame:
    """All positives and up to ``most`` negatives of each session, drawn by a hash."""
    w = Window.partitionBy("session", "label").orderBy(F.xxhash64("session", "aid", F.lit(seed)), "aid")
    return labelled.withColumn("__n", F.row_number().over(w)).filter((F.col("label") == 1) | (F.col("__n") <= most)).drop("__n")


def round_robin(pools: DataFrame, blocked: DataFrame, limit: int) -> DataFrame:
    """``sample_id, aid, place``: hard negatives of several pools (``sample_id, pool, ordinal, aid``) in turn, each item once and none
    that is ``blocked`` (``sample_id, aid``)."""
    rows = pools.select("sample_id", "aid", F.struct("ordinal", "pool").alias("o"))
    rows = rows.unionByName(blocked.select("sample_id", "aid").dropna().select("sample_id", "aid", F.lit(None).cast(rows.schema["o"].dataType).alias("o")))
    first = rows.repartition("sample_id").groupBy("sample_id", "aid").agg(F.min("o").alias("o"), F.count_if(F.isnull("o")).alias("__b")).filter("__b = 0")  # one shuffle for all
    w = Window.partitionBy("sample_id").orderBy("o", "aid")
    return first.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit).select("sample_id", "aid", "place")


#: How many items each pool of hard negatives gives at most, and the ranks that the vector neighbours are taken from.
POOL_QUOTAS = {"behaviour": 24, "category": 16, "popular": 12, "drawn": 12}
VECTOR_RANKS = (11, 42)


def negative_pools(routes: DataFrame) -> DataFrame:
    """``sample_id, pool, ordinal, aid`` from ranked routes (``sample_id, aid, source, rank``, ranks from 1 without gaps): neighbours by vectors
    of the middle ranks, co-occurrence and transition in turn as long as both last, the category's and the popular items."""
    rank, source = F.col("rank"), F.col("source")
    ends = routes.filter(source.isin("itemcf", "transition")).groupBy("sample_id").agg(F.least(F.max(F.when(source == "itemcf", rank)), F.max(F.when(source == "transition", rank))).alias("n"), F.count_distinct("source").alias("both"))
    turn = routes.filter(source.isin("itemcf", "transition")).join(ends.filter("both = 2"), "sample_id").filter(rank <= F.col("n"))
    turn = turn.withColumn("ordinal", 2 * (rank - 1) + (source == "transition").cast("long")).filter(F.col("ordinal") < POOL_QUOTAS["behaviour"])
    parts = [routes.filter((source == "item2vec") & rank.between(*VECTOR_RANKS)).withColumns({"ordinal": rank - VECTOR_RANKS[0], "pool": F.lit(0)}), turn.withColumn("pool", F.lit(1))]
    for i, name in ((2, "category"), (3, "popular")):
        parts.append(routes.filter((source == name) & (rank <= POOL_QUOTAS[name])).withColumns({"ordinal": rank - 1, "pool": F.lit(i)}))
    out = None
    for part in parts:
        part = part.select("sample_id", "pool", F.col("ordinal").cast("long").alias("ordinal"), "aid")
        out = part if out is None else out.unionByName(part)
    return out


def drawn_items(samples: DataFrame, counts: DataFrame, n: int, power: float = 0.75, seed: int = 7, max_items: int = 2_000_000) -> DataFrame:
    """``sample_id, ordinal, aid``: ``n`` items per sample drawn by a hash with chances of ``count ** power``; ``counts`` is ``aid, n``.

    The cumulated chances, a number per item, are broadcast; more than ``max_items`` items raise ValueError.
    """
    known = counts.dropna().orderBy("aid").limit(max_items + 1).select(F.col("aid").cast("long").alias("aid"), F.col("n").cast("double").alias("n"))
    parts = [(np.frombuffer(r["aid"], dtype=np.int64), np.frombuffer(r["n"])) for r in known.mapInPandas(_packed, "aid binary, n binary").toLocalIterator()]
    ids, often = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0))
    if len(ids) > max_items:
        raise ValueError("too many items for one table of chances")
    chance = often**power
    shared = samples.sparkSession.sparkContext.broadcast((ids, np.cumsum(chance) / max(chance.sum(), 1e-300)))
    uniform = F.shiftrightunsigned(F.xxhash64("sample_id", "ordinal", F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = samples.select("sample_id").distinct().repartition(2 * samples.sparkSession.sparkContext.defaultParallelism, "sample_id").withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("u", uniform)

    @F.pandas_udf("long")
    def pick(u: pd.Series) -> pd.Series:
        items, ends = shared.value
        return pd.Series(items[np.minimum(np.searchsorted(ends, u.to_numpy(), side="right"), len(items) - 1)])

    return rows.select("sample_id", "ordinal", pick("u").alias("aid")) if len(ids) else rows.select("sample_id", "ordinal", F.lit(None).cast("long").alias("aid")).limit(0)


def hard_negatives(routes: DataFrame, blocked: DataFrame, counts: DataFrame, samples: DataFrame, limit: int = 96, seed: int = 7) -> DataFrame:
    """``sample_id, aid, place``: the rows of :func:`negative_lists`."""
    lists = negative_lists(routes, blocked, counts, samples, limit, seed)
    return lists.select("sample_id", F.posexplode("negatives").alias("place", "aid")).select("sample_id", "aid", (F.col("place") + 1).cast("long").alias("place"))


def negative_lists(routes: DataFrame, blocked: DataFrame, counts: DataFrame, samples: DataFrame, limit: int = 96, seed: int = 7) -> DataFrame:
    """``sample_id, negatives``: the pools of :func:`negative_pools` and drawn items in turn, each item once and none that is ``blocked``; samples
    with fewer than ``limit`` are filled up with more drawn items, as far as the catalogue goes: ten rounds of ``limit`` draws are looked at.

    Later draws only come after earlier ones, so the last nine rounds are drawn for those samples only that aren't full after the first. Runs jobs.
    """
    drawn = lambda rows, n: drawn_items(rows, counts, n, seed=seed).select("sample_id", F.when(own, F.lit(4)).otherwise(F.lit(5)).alias("pool"), F.when(own, F.col("ordinal")).otherwise(F.col("ordinal") + 1_000_000).alias("ordinal"), "aid")
    own = F.col("ordinal") < POOL_QUOTAS["drawn"]
    pools = negative_pools(routes)
    listed = lambda rows: rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "aid"))), lambda x: x.aid).alias("negatives"))
    first = settle(listed(round_robin(pools.unionByName(drawn(samples, 2 * limit)), blocked, limit)))  # a list takes a fifth of its rows
    full = first.filter(F.size("negatives") >= limit).select("sample_id")
    short = settle(samples.select("sample_id").distinct().join(full, "sample_id", "left_anti"))
    if not short.count():
        return first
    named = short.withColumnRenamed("sample_id", "__s")
    again = F.col("sample_id").eqNullSafe(F.col("__s"))
    rest = listed(round_robin(pools.join(named, again, "left_semi").unionByName(drawn(short, 11 * limit)), blocked, limit))
    return first.join(named, again, "left_anti").unionByName(rest)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"aid": [frame["aid"].to_numpy(dtype=np.int64).tobytes()], "n": [frame["n"].to_numpy(dtype=np.float64).tobytes()]})
