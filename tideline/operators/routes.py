"""Routes that give candidates ``session, aid, source, source_rank, source_score`` for samples with a history."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.checks import assert_subset
from tideline.operators.indexes import ranked_within

LIMITS = {"recent": 30, "hybrid_popular": 100, "category": 150, "itemcf": 200, "transition": 150}
COLUMNS = ["session", "aid", "source", "source_rank", "source_score"]


def seeds(samples: DataFrame, n: int | None = None) -> DataFrame:
    """``session, seed, recency``: the different items of each history, the latest first, recency from 0."""
    recent = F.array_distinct(F.reverse("history_aids"))
    recent = recent if n is None else F.slice(recent, 1, n)
    return samples.select("session", F.posexplode(recent).alias("recency", "seed"))


def _route(df: DataFrame, source: str) -> DataFrame:
    return df.select("session", "aid", F.lit(source).alias("source"), F.col("rank").cast("long").alias("source_rank"), F.col("score").cast("double").alias("source_score"))


def recent(samples: DataFrame, limit: int = LIMITS["recent"]) -> DataFrame:
    """The latest different items of the history, scored by 1 / rank."""
    rows = seeds(samples, limit)
    return _route(rows.select("session", F.col("seed").alias("aid"), (F.col("recency") + 1).alias("rank"), (F.lit(1.0) / (F.col("recency") + 1)).alias("score")), "recent")


def stage() -> Column:
    """Stage of a session by the types in its history: order, cart or click."""
    return F.when(F.array_contains("history_type_ids", 2), "order").when(F.array_contains("history_type_ids", 1), "cart").otherwise("click")


def hybrid_popular(samples: DataFrame, lists: DataFrame, limit: int = LIMITS["hybrid_popular"]) -> DataFrame:
    """The popular list of the session's stage; the three lists are short and broadcast."""
    rows = samples.select("session", stage().alias("stage")).join(F.broadcast(lists.filter(F.col("rank") <= limit)), "stage")
    return _route(rows.withColumn("score", F.lit(1.0) / F.col("rank")), "hybrid_popular")


def popular(samples: DataFrame, popularity: DataFrame, limit: int = 50) -> DataFrame:
    """The same most frequent items for every session: a short list, sent as one array."""
    best = popularity.filter(F.col("rank") <= limit).agg(F.array_sort(F.collect_list(F.struct("rank", "aid"))).alias("__list"))
    rows = samples.select("session").join(F.broadcast(best)).select("session", F.explode("__list").alias("p")).select("session", "p.aid", "p.rank")
    return _route(rows.withColumn("score", F.lit(1.0) / F.col("rank")), "popular")


def by_neighbours(samples: DataFrame, edges: DataFrame, source: str, limit: int, seed_limit: int = 5, mode: str = "reciprocal") -> DataFrame:
    """Neighbours of the latest items (``edges``: ``src, dst, score``), summed with weights that fall with recency."""
    w = F.lit(1.0) / (F.col("recency") + 1) if mode == "reciprocal" else F.exp(F.lit(-0.1) * F.col("recency"))
    rows = seeds(samples, seed_limit).join(edges.select(F.col("src").alias("seed"), "dst", "score"), "seed")
    sums = rows.groupBy("session", F.col("dst").alias("aid")).agg(F.sum(F.col("score") * w).alias("score"))
    return _route(ranked_within(sums, ["session"], limit), source)


def itemcf(samples: DataFrame, edges: DataFrame, limit: int = LIMITS["itemcf"]) -> DataFrame:
    """Ten seeds with exponentially falling weights."""
    return by_neighbours(samples, edges, "itemcf", limit, 10, "exponential")


def transition(samples: DataFrame, edges: DataFrame, limit: int = LIMITS["transition"]) -> DataFrame:
    """Five seeds with reciprocal weights."""
    return by_neighbours(samples, edges, "transition", limit)


def category(samples: DataFrame, item_category: DataFrame, pools: DataFrame, limit: int = LIMITS["category"], seed_limit: int = 5, source: str = "category") -> DataFrame:
    """Pools of the seeds' categories, by ``score / ((recency + 1) * rank)``."""
    rows = seeds(samples, seed_limit).join(item_category.select(F.col("aid").alias("seed"), "category"), "seed").join(pools.select("category", "aid", "score", "rank"), "category")
    sums = rows.groupBy("session", "aid").agg(F.sum(F.col("score") / ((F.col("recency") + 1) * F.col("rank"))).alias("score"))
    return _route(ranked_within(sums, ["session"], limit), source)


def path_category(item_category: DataFrame, paths: DataFrame, level: str) -> DataFrame:
    """``aid, category`` with the category replaced by its parent or root where the path has one."""
    value = F.when(F.size("category_path") >= 2, F.element_at("category_path", -2 if level == "parent" else 1)).otherwise(F.col("category"))
    return item_category.join(paths.select(F.col("categoryid").alias("category"), "category_path"), "category").select("aid", value.alias("category"))


def union(*routes: DataFrame) -> DataFrame:
    """Candidates of all routes."""
    return reduce(DataFrame.unionByName, routes)


def from_indexes(samples: DataFrame, indexes: dict[str, DataFrame], limits: dict[str, int] | None = None, check: bool = False, extra: dict[str, Callable[[DataFrame, dict], DataFrame]] | None = None) -> DataFrame:
    """All heuristic routes over frozen indexes, and ``extra`` routes given as callables of samples and indexes.

    ``check`` runs a job that raises if a candidate is neither in the frozen catalogue nor in its session's history.
    """
    limit = LIMITS | (limits or {})
    rows = union(
        recent(samples, limit["recent"]),
        hybrid_popular(samples, indexes["hybrid_popularity"], limit["hybrid_popular"]),
        itemcf(samples, indexes["itemcf"], limit["itemcf"]),
        transition(samples, indexes["transition"], limit["transition"]),
        category(samples, indexes["item_category"], indexes["category_popularity"], limit["category"]),
        *(route(samples, indexes) for route in (extra or {}).values()),
    )
    if check:
        allowed = indexes["catalog"].unionByName(seeds(samples).select(F.col("seed").alias("aid"))).distinct()
        assert_subset(rows.select("aid").distinct(), allowed, ["aid"])
    return rows


def four_routes(samples: DataFrame, popularity: DataFrame, cf_edges: DataFrame, per_source: int, embedding_edges: DataFrame | None = None, embedding_source: str = "item2vec") -> DataFrame:
    """Recent, popular, item-to-item and, if given, embedding neighbours, each cut at ``per_source``."""
    rows = [recent(samples, per_source), popular(samples, popularity, per_source), by_neighbours(samples, cf_edges, "itemcf", per_source)]
    if embedding_edges is not None:
        rows.append(by_neighbours(samples, embedding_edges, embedding_source, per_source))
    return union(*rows)
