"""The first N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Heavy groups that are broadcast at most; beyond it they are told apart in an ordinary join.
BROADCAST_GROUPS = 100_000


def top_n(candidates: DataFrame, group: str, item: str, score: str, n: int, heavy_rows: int = 20_000) -> DataFrame:
    """``group, item, score, rank`` of the ``n`` highest scores per group, ties to the smaller item.

    An item counts once per group, at its highest score. Rows with a null in group or item, or with a null, NaN or
    infinite score, don't count. Fewer valid items than ``n``: all come out. Empty input: no rows. Other columns are ignored.

    Exact counts tell heavy groups (more than ``heavy_rows`` rows) from light ones. A light group meets in one task: one
    shuffle by group serves the deduplication and an ordinary window. A heavy group is deduplicated in all tasks, with a map-side
    combine, range-sorted by (group, score, item) over all of them, each range keeps its first ``n``, and a window over
    these few picks the result. Both are united. Runs a job (the counts).
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark = candidates.sparkSession
    value = F.col(score).cast("double")
    rows = candidates.select(F.col(group).alias("__g"), F.col(item).alias("__i"), value.alias("__s"))
    rows = rows.filter(F.col("__g").isNotNull() & F.col("__i").isNotNull() & F.col("__s").isNotNull() & ~F.isnan("__s") & (F.abs("__s") != float("inf")))
    heavy = rows.groupBy("__g").count().filter(F.col("count") > heavy_rows).select("__g")
    few = heavy.limit(BROADCAST_GROUPS + 1).collect()
    best = Window.partitionBy("__g").orderBy(F.desc("__s"), "__i")

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= n)

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("__g").alias(group), F.col("__i").alias(item), F.col("__s").alias(score), F.col("__r").cast("long").alias("rank"))

    light = rows
    if few:
        marked = F.broadcast(spark.createDataFrame(few, heavy.schema)) if len(few) <= BROADCAST_GROUPS else heavy
        light = rows.join(marked, "__g", "left_anti")
    light = first(light.repartition("__g").groupBy("__g", "__i").agg(F.max("__s").alias("__s")))
    if not few:
        return named(light)
    hot = rows.join(marked, "__g", "left_semi").groupBy("__g", "__i").agg(F.max("__s").alias("__s"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = hot.repartitionByRange(parts, "__g", F.desc("__s"), "__i").withColumn("__salt", F.spark_partition_id())
    local = Window.partitionBy("__g", "__salt").orderBy(F.desc("__s"), "__i")
    hot = hot.sortWithinPartitions("__g", "__salt", F.desc("__s"), "__i").withColumn("__k", F.row_number().over(local)).filter(F.col("__k") <= n).drop("__k", "__salt")
    return named(light).unionByName(named(first(hot)))
