"""Per-key results when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How partial results of an aggregate are merged.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
#: Most keys the sketch may track, below the limit of Spark's own sketch.
MOST_TRACKED = 1 << 19


def heavy_share(spark: SparkSession) -> float:
    """Share of the rows from which a key is heavy: a quarter of what one of the shuffle's tasks gets on the average."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return 1.0 / (4 * tasks)


def key_hash(keys: list[str]) -> Column:
    """Hash by which keys are told heavy; nulls count as values."""
    return F.xxhash64(*keys)


def heavy_keys(df: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """``__h``: hashes of the keys that hold at least ``share`` of the rows (default: :func:`heavy_share`).

    One pass with Spark's frequent-items sketch, merged from the tasks; it tracks 16 / ``share`` keys, so that its error is
    below a quarter of the share: every key at the share comes out, and none below half of it, at most ``2 / share`` in all
    whatever the size of ``df``. The hash only decides which way a key is processed, so two keys of one hash do no harm.
    Shares below 16 / 2^19 count as that. Null keys count as keys; an empty input gives no row.
    """
    share = heavy_share(df.sparkSession) if share is None else share
    tracked = 1 << max(6, (int(16 / max(share, 16 / MOST_TRACKED)) - 1).bit_length())
    most = min(tracked - 1, int(2 / share) + 1)
    found = df.select(key_hash(keys).alias("__h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(__h, {most}, {tracked})").alias("top")).first()
    rows = [[item["item"]] for item in found["top"] or [] if item["count"] >= 0.75 * share * found["n"]]
    return df.sparkSession.createDataFrame(rows, "__h long")


def split_by_keys(df: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hot, cold)``: the rows of the heavy keys, found by a broadcast join, and all others; nulls are keys, too."""
    marked, hashed = F.broadcast(heavy), df.withColumn("__h", key_hash(keys))
    return hashed.join(marked, "__h", "left_semi").drop("__h"), hashed.join(marked, "__h", "left_anti").drop("__h")


def skewed_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | None]], distinct_on: list[str] | None = None, share: float | None = None) -> DataFrame:
    """Aggregate per key without a task doing far more than the others.

    ``aggs`` maps a result column to ``(function, column)``, function one of count, sum, min and max (column None: rows).
    With ``distinct_on``, rows that agree in these columns count once (null equals null); they must hold the keys.

    Heavy keys come from :func:`heavy_keys`. Their rows are found by a broadcast join and spread over all tasks by the
    hash of the whole row, deduplicated after a map-side pre-aggregation (a group of copies shrinks before it is sent) and
    aggregated in parts that are merged. Rows of the other keys, of which none fills more than a quarter of a task, go
    through one ordinary shuffle by key, which serves the deduplication and the aggregation. Both results are united; a key
    is in one of them only. Null keys form a group; an empty input gives no rows; extra columns are ignored.
    """
    for name, (function, _) in aggs.items():
        if function not in _MERGE:
            raise ValueError(f"{name}: unknown function {function}")
    if distinct_on and not set(keys) <= set(distinct_on):
        raise ValueError("distinct_on must hold the keys")
    needed = list(dict.fromkeys([*keys, *(distinct_on or []), *(c for _, c in aggs.values() if c)]))
    rows = df.select(*needed)
    if distinct_on and set(needed) != set(distinct_on):
        raise ValueError("aggregated columns must be among distinct_on")
    hot, cold = split_by_keys(rows, keys, heavy_keys(rows, keys, share))

    def compute(function: str, column: str | None) -> Column:
        return F.count(F.lit(1) if column is None else F.col(column)) if function == "count" else getattr(F, function)(column)

    exprs = [compute(f, c).alias(name) for name, (f, c) in aggs.items()]
    if distinct_on:
        hot = hot.groupBy(*distinct_on).agg(F.lit(1).alias("__one"))
        cold = cold.repartition(*keys).groupBy(*distinct_on).agg(F.lit(1).alias("__one"))
    return hot.groupBy(*keys).agg(*exprs).unionByName(cold.groupBy(*keys).agg(*exprs))


def skewed_join(facts: DataFrame, dimension: DataFrame, keys: list[str], how: str = "inner", share: float | None = None) -> DataFrame:
    """Join a large table with one row per key, a few keys holding most rows of the large one.

    The dimension's rows of the heavy keys (a bounded number, as its keys are unique) are broadcast; all other rows meet
    in an ordinary join. ``how`` is inner or left. Null keys match nothing and don't meet in one task.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    full = facts.filter(_all_set(keys))
    heavy = heavy_keys(full, keys, share)
    hot, cold = split_by_keys(full, keys, heavy)
    few = split_by_keys(dimension, keys, heavy)[0]
    joined = hot.join(F.broadcast(few), keys, how).unionByName(cold.join(dimension, keys, how))
    if how == "inner":
        return joined
    return joined.unionByName(facts.filter(~_all_set(keys)), allowMissingColumns=True)


def _all_set(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition
