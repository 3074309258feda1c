"""State as it was known: a lookup by the time of knowledge and the time of validity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import settle

#: Names of hot entities and trees that are broadcast at most; more of them meet the rows in an ordinary join.
MOST_BROADCAST = 200_000


class PersistentTree:
    """Path-copied search tree over keys ``0 .. n-1``; version ``v`` is the tree after the first ``v + 1`` insertions.

    An insertion copies the nodes from the root to its leaf and shares all other subtrees with the version before. Nodes
    lie in flat arrays, one row per level: the node that version ``v`` made on level ``l`` is ``[l, v]``, its children are
    versions on level ``l + 1`` (-1: empty). All copies of one level are made in one vectorised step.
    """

    def __init__(self, positions: np.ndarray, size: int):
        self.m, self.height = len(positions), max(1, int(max(1, size - 1)).bit_length())
        versions = np.arange(self.m, dtype=np.int64)
        self.left = np.full((self.height, self.m), -1, dtype=np.int32)
        self.right = np.full((self.height, self.m), -1, dtype=np.int32)
        for level in range(self.height):
            prefix = positions >> (self.height - 1 - level)
            at = np.sort(prefix * self.m + versions)
            sibling = prefix ^ 1
            before = np.searchsorted(at, sibling * self.m + versions) - 1
            copied = np.where((before >= 0) & (at[before] // self.m == sibling), at[before] % self.m, -1) if self.m else before
            is_right = (prefix & 1).astype(bool)
            self.left[level] = np.where(is_right, copied, versions)
            self.right[level] = np.where(is_right, versions, copied)

    def floor(self, roots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Version that inserted the greatest key <= ``keys`` in the tree of ``roots``; -1 if there is none or a root is -1."""
        here = np.where(keys >= 0, roots, -1).astype(np.int64)
        spare_level = np.full(len(keys), -1)
        spare = np.full(len(keys), -1, dtype=np.int64)
        for level in range(self.height):
            alive = here >= 0
            goes_right = ((keys >> (self.height - 1 - level)) & 1).astype(bool)
            left = np.where(alive, self.left[level][here], -1)
            right = np.where(alive, self.right[level][here], -1)
            passed = alive & goes_right & (left >= 0)
            spare = np.where(passed, left, spare)
            spare_level = np.where(passed, level + 1, spare_level)
            here = np.where(goes_right, right, left)
        down = np.where(here >= 0, -1, spare)
        for level in range(1, self.height):
            moving = (down >= 0) & (spare_level <= level)
            right = self.right[level][down]
            down = np.where(moving, np.where(right >= 0, right, self.left[level][down]), down)
        return np.where(here >= 0, here, down)


def _probe(entity: list[str], valued: list[str], carried: list[str]):
    def kernel(states: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if points.empty or states.empty:
            return pd.DataFrame(columns=[*entity, "__known", "__valid", *carried, "__state_ts", *valued])
        both = pd.concat([states[entity], points[entity]], ignore_index=True)
        codes = both.groupby(entity, sort=False).ngroup().to_numpy(dtype=np.int64)
        order = np.argsort(states["__recorded"].to_numpy(), kind="stable")
        states = states.iloc[order]
        state_code, point_code = codes[: len(states)][order], codes[len(states) :]
        times = np.unique(states["__state_ts"].to_numpy())
        width = len(times) + 1
        key = state_code * width + np.searchsorted(times, states["__state_ts"].to_numpy()) + 1
        keys, positions = np.unique(key, return_inverse=True)
        tree = PersistentTree(positions.astype(np.int64), len(keys))
        wanted = point_code * width + np.searchsorted(times, points["__valid"].to_numpy(), side="right")
        roots = np.searchsorted(states["__recorded"].to_numpy(), points["__known"].to_numpy(), side="right") - 1
        found = tree.floor(roots, np.searchsorted(keys, wanted, side="right") - 1)
        hit = (found >= 0) & (state_code[found] == point_code)
        answer = points.loc[hit, [*entity, "__known", "__valid", *carried]].reset_index(drop=True)
        chosen = states.iloc[found[hit]].reset_index(drop=True)
        answer["__state_ts"] = chosen["__state_ts"]
        for name in valued:
            answer[name] = chosen[name]
        return answer

    return kernel


def as_known(queries: DataFrame, states: DataFrame, entity: list[str], values: list[str], valid: str = "timestamp", recorded: str = "recorded_ts", known_at: str = "target_ts", valid_at: str | None = None, prefix: str = "state_", tree_rows: int = 50_000, tree_points: int = 200_000) -> DataFrame:
    """Add to each query the state of its entity that was known at ``known_at`` and valid at ``valid_at``.

    Of the states with ``recorded <= known_at`` and ``valid <= valid_at`` (default ``known_at``) the one with the greatest
    ``valid`` comes out, as columns ``<prefix>ts`` and ``<prefix><value>``; of states with equal ``valid`` the one recorded
    last (equal there too: undefined, so clean such contradictions before). Times are bigint. Entities with few rows share
    a persistent tree per shard (:class:`PersistentTree`): a query takes the root of its known time and searches the valid
    time. Entities with more than ``tree_rows`` states are range-sorted by the valid time, and each range has its tree. A
    query needs two ranges at most: the last that begins by its valid time and holds a state known by its known time, and
    the one before that. Both are found by the same lookup over the ranges' first times, which is as distributed as the
    lookup itself. If more than ``tree_points`` queries ask for one tree, they are divided among copies of it. So no task
    holds more than a bounded part of an entity, but for states of one entity and one valid time, which stay together, and
    the driver gets counts only. Runs small jobs, and settles the ranges. Both tables are read several times.

    A query with a null in entity or time, or without a known state, gets nulls; states with a null in entity, ``valid`` or
    ``recorded`` never count. Repeated queries each get their answer; other columns of either table don't matter.
    """
    valid_from = F.col(valid_at) if valid_at else F.col(known_at)
    kept = states.select(*entity, F.col(valid).cast("long").alias("__state_ts"), F.col(recorded).cast("long").alias("__recorded"), *(F.col(v).alias(f"__v{i}") for i, v in enumerate(values)))
    kept = kept.dropna(subset=[*entity, "__state_ts", "__recorded"])
    points = settle(queries.select(*entity, F.col(known_at).cast("long").alias("__known"), valid_from.cast("long").alias("__valid")).dropna().distinct())
    answers = _lookup(points, kept, entity, [f"__v{i}" for i in range(len(values))], [], tree_rows, tree_points)
    named = answers.select(*(F.col(e).alias(f"__e{i}") for i, e in enumerate(entity)), "__known", "__valid", F.col("__state_ts").alias(f"{prefix}ts"), *(F.col(f"__v{i}").alias(prefix + v) for i, v in enumerate(values)))
    matched = (F.col(known_at).cast("long") == F.col("__known")) & (valid_from.cast("long") == F.col("__valid"))
    for i, e in enumerate(entity):
        matched = matched & (F.col(e) == F.col(f"__e{i}"))
    return queries.join(named, matched, "left").select(*queries.columns, f"{prefix}ts", *(prefix + v for v in values))


def _lookup(points: DataFrame, kept: DataFrame, entity: list[str], valued: list[str], carried: list[str], tree_rows: int, tree_points: int) -> DataFrame:
    """The points that have a known state, with its ``__state_ts`` and values."""
    spark = points.sparkSession
    sizes = kept.groupBy(*entity).agg(F.count(F.lit(1)).alias("rows"))
    large = F.col("rows") > tree_rows
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(large).alias("hot"), F.coalesce(F.sum(F.when(large, F.col("rows"))), F.lit(0)).alias("hot_rows")).first()
    kept, points = kept.withColumn("__range", F.lit(0)), points.withColumn("__range", F.lit(0))
    if total["hot"]:
        names = _small(sizes.filter(large).select(*entity), total["hot"])
        cut = kept.join(names, entity, "left_semi").repartitionByRange(2 * math.ceil(total["hot_rows"] / tree_rows), *entity, "__state_ts")
        cut = settle(cut.withColumn("__range", F.spark_partition_id() + 1))
        ranges = settle(cut.groupBy(*entity, F.col("__range").alias("__place")).agg(F.min("__state_ts").alias("__state_ts"), F.min("__recorded").alias("__recorded")))
        kept = kept.join(names, entity, "left_anti").unionByName(cut)
        asking = points.join(names, entity, "left_semi").drop("__range")
        columns = [*entity, "__known", "__valid", *carried]
        own = settle(_lookup(asking, ranges, entity, ["__place"], carried, tree_rows, tree_points))
        asked_for = f"__asked{len(carried)}"  # a name per level
        earlier = own.withColumns({asked_for: F.col("__valid"), "__valid": F.try_subtract("__state_ts", F.lit(1))}).drop("__state_ts", "__place").dropna(subset=["__valid"])
        before = _lookup(earlier, ranges, entity, ["__place"], [*carried, asked_for], tree_rows, tree_points).drop("__valid").withColumnRenamed(asked_for, "__valid")
        placed = settle(own.unionByName(before).select(*columns, F.col("__place").alias("__range")))
        points = points.join(names, entity, "left_anti").unionByName(placed)

    cells = points.groupBy(*entity, "__range").agg(F.count(F.lit(1)).alias("points"))
    busy = F.col("points") > tree_points
    asked = cells.agg(F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.count_if(busy).alias("busy")).first()
    copies = F.lit(1)
    if asked["busy"]:
        divided = _small(cells.filter(busy).select(*entity, "__range", F.ceil(F.col("points") / F.lit(tree_points)).cast("int").alias("__copies")), asked["busy"])
        kept, points = (df.join(divided, [*entity, "__range"], "left") for df in (kept, points))
        copies = F.coalesce("__copies", F.lit(1))
    kept = kept.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    points = points.withColumn("__copy", F.pmod(F.xxhash64("__known", "__valid"), copies.cast("long")).cast("int"))

    shards = max(1, math.ceil(total["rows"] / tree_rows), math.ceil(asked["points"] / tree_points), min(spark.sparkContext.defaultParallelism, total["rows"] // 2000))
    shard = F.pmod(F.xxhash64(*entity, "__range", "__copy"), F.lit(shards)).cast("int").alias("__shard")
    kept = kept.select(shard, *entity, "__state_ts", "__recorded", *valued)
    points = points.select(shard, *entity, "__known", "__valid", *carried)
    fields = [points.schema[c] for c in points.columns[1:]] + [T.StructField("__state_ts", T.LongType())] + [kept.schema[c] for c in valued]
    answers = kept.groupBy("__shard").cogroup(points.groupBy("__shard")).applyInPandas(_probe(entity, valued, carried), T.StructType(fields))
    if total["hot"]:  # of the two ranges' states the later one
        answers = answers.groupBy(*points.columns[1:]).agg(F.max_by(F.struct("__state_ts", *valued), "__state_ts").alias("s")).select(*points.columns[1:], "s.*")
    return answers


def _small(rows: DataFrame, number: int) -> DataFrame:
    return F.broadcast(rows) if number <= MOST_BROADCAST else rows


def clean_states(states: DataFrame, entity: list[str], value: str, valid: str = "timestamp", recorded: str = "recorded_ts") -> DataFrame:
    """One row per entity and instant: rows with a null entity, time or value go, and so do all rows of an instant with different values.

    ``recorded`` is the earliest of equal rows (null if none is set). Extra columns are dropped.
    """
    rows = states.dropna(subset=[*entity, valid, value]).groupBy(*entity, valid).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.min(recorded).alias(recorded))
    return rows.filter(F.col("__low") == F.col("__high")).select(*entity, valid, F.col("__low").alias(value), recorded)


def newest_states(states: DataFrame, entity: list[str], value: str, valid: str = "timestamp") -> DataFrame:
    """``entity, value, valid`` of the greatest ``valid`` per entity, whenever recorded; pre-aggregated before the shuffle."""
    return states.groupBy(*entity).agg(F.max_by(value, valid).alias(value), F.max(valid).alias(valid))
