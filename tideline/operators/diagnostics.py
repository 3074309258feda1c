"""Diagnosis of routes, misses and variants."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def route_diagnostics(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: recall, hits that no other source has, the loss of union recall without it, and the union's recall.

    Sources are counted per hit, so no sets are compared.
    """
    hits = candidates.join(labels.select("session", F.col("target_aid").alias("aid")), ["session", "aid"]).select("session", "source").distinct()
    sources = hits.groupBy("session").agg(F.count(F.lit(1)).alias("__k"), F.min("source").alias("__only"))
    per = hits.groupBy("source").agg(F.count(F.lit(1)).alias("hits"))
    alone = sources.filter("__k = 1").groupBy(F.col("__only").alias("source")).agg(F.count(F.lit(1)).alias("exclusive_hits"))
    total = labels.agg(F.count(F.lit(1)).alias("__n"))
    union = sources.agg(F.count(F.lit(1)).alias("__u"))
    every = candidates.select("source").distinct().join(F.broadcast(total)).join(F.broadcast(union))
    rows = every.join(per, "source", "left").join(alone, "source", "left").fillna(0, ["hits", "exclusive_hits"])
    return rows.select("source", (F.col("hits") / F.col("__n")).alias("recall"), "exclusive_hits", (F.col("exclusive_hits") / F.col("__n")).alias("leave_one_out_recall_drop"), (F.col("__u") / F.col("__n")).alias("union_recall"))


def pairwise_jaccard(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """``left, right, jaccard`` of the sets of candidates of each pair of sources; one flag per source and candidate, then sums."""
    flags = candidates.groupBy("session", "aid").agg(*(F.max((F.col("source") == s).cast("int")).alias(s) for s in sources))
    pairs = list(combinations(sorted(sources), 2))
    sums = flags.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.sum(F.col(a) * F.col(b)).alias(f"i{i}"), F.sum(F.greatest(a, b)).alias(f"u{i}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.coalesce(F.try_divide(F.col(f"i{i}"), F.col(f"u{i}")), F.lit(0.0)).alias("jaccard")) for i, (a, b) in enumerate(pairs))))
    return sums.select(rows.alias("r")).select("r.*")


def auc_gauc(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: AUC over pairs and mean AUC per session of recalled targets against the source's other candidates."""
    rows = candidates.join(labels.select("session", "target_aid"), "session")
    hit = F.col("aid") == F.col("target_aid")
    best = rows.filter(hit).groupBy("source", "session").agg(F.max("source_score").alias("__s"))
    pairs = rows.filter(~hit).join(best, ["source", "session"]).groupBy("source", "session").agg(F.sum(F.when(F.col("__s") > F.col("source_score"), 1.0).when(F.col("__s") == F.col("source_score"), 0.5).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("source").agg((F.sum("w") / F.sum("n")).alias("candidate_auc"), F.avg(F.col("w") / F.col("n")).alias("session_gauc"), F.count(F.lit(1)).alias("eligible_sessions"))


def route_summary(candidates: DataFrame, labels: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Per source: sessions covered, mean candidates, recall at ``k`` and in full, median rank of hits, MRR, and hits outside the history."""
    target = labels.select("session", F.col("target_aid").alias("aid"))
    hits = candidates.join(target, ["session", "aid"]).groupBy("source", "session", "aid").agg(F.min("source_rank").alias("rank"))
    seen = history.select("session", "aid").distinct().withColumn("__seen", F.lit(1))
    hits = hits.join(seen, ["session", "aid"], "left")
    total = labels.agg(F.count(F.lit(1)).alias("__n"))
    size = candidates.groupBy("source", "session").agg(F.count(F.lit(1)).alias("c")).groupBy("source").agg(F.count(F.lit(1)).alias("covered_sessions"), F.avg("c").alias("mean_candidates"))
    found = hits.groupBy("source").agg(F.count(F.lit(1)).alias("h"), F.count_if(F.col("rank") <= k).alias("hk"), F.percentile("rank", 0.5).alias("rank_median"), F.sum(F.lit(1.0) / F.col("rank")).alias("rr"), F.count_if(F.col("__seen").isNull()).alias("novel_hits"))
    rows = size.join(found, "source", "left").join(F.broadcast(total))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("__n")
    return rows.select("source", "covered_sessions", "mean_candidates", share("hk").alias("recall_at_k"), share("h").alias("recall_full"), "rank_median", share("rr").alias("mrr_full"), F.coalesce("novel_hits", F.lit(0)).alias("novel_hits"))


def miss_segments(rows: DataFrame, segments: list[str], hit: str = "hit") -> DataFrame:
    """``segment, value, samples, misses, recall`` for every segmentation at once, by grouping sets: one pass over the rows."""
    kept = rows.select(hit, *segments)
    value = "coalesce(" + ", ".join(f"cast({s} AS string)" for s in segments) + ")"
    name = "CASE " + " ".join(f"WHEN grouping({s}) = 0 THEN '{s}'" for s in segments) + " END"
    sets = ", ".join(f"({s})" for s in segments)
    return kept.sparkSession.sql(f"SELECT {name} AS segment, {value} AS value, count(*) AS samples, count_if({hit} = 0) AS misses, avg(cast({hit} AS double)) AS recall FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=kept)


def compare_variants(variants: dict[str, DataFrame], base: DataFrame, labels: DataFrame, history: DataFrame) -> DataFrame:
    """Per variant of a route: recall, recall of targets outside the history, hits the ``base`` candidates lack, union recall and its lift."""
    target = labels.select("session", F.col("target_aid").alias("aid"))
    base_hits = base.join(target, ["session", "aid"]).select("session").distinct().withColumn("__base", F.lit(1))
    seen = history.select("session", "aid").distinct().withColumn("__seen", F.lit(1))
    rows = target.join(seen, ["session", "aid"], "left").join(base_hits, "session", "left")
    out = None
    for name, df in variants.items():
        own = df.join(target, ["session", "aid"]).select("session").distinct().withColumn("__own", F.lit(1))
        r = rows.join(own, "session", "left").fillna(0, ["__own", "__base", "__seen"])
        novel = F.col("__seen") == 0
        one = r.agg(
            F.lit(name).alias("variant"),
            F.avg(F.col("__own").cast("double")).alias("recall"),
            F.avg(F.when(novel, F.col("__own").cast("double"))).alias("novel_recall"),
            F.sum(F.col("__own") * (F.lit(1) - F.col("__base"))).alias("exclusive_hits"),
            F.avg(F.greatest("__own", "__base").cast("double")).alias("union_recall"),
            F.avg((F.col("__own") * (F.lit(1) - F.col("__base"))).cast("double")).alias("union_lift"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def pool_sizes(candidates: DataFrame, key: str = "session") -> DataFrame:
    """One row: distribution of the number of candidates per session."""
    sizes = candidates.select(key, "aid").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"), F.percentile("n", 0.99).alias("p99"), F.max("n").alias("max"))


def temporal_folds(spark: SparkSession, samples: DataFrame, folds: int, warmup: float, time: str = "target_ts") -> DataFrame:
    """``fold, start_ts, end_ts``: expanding windows between quantiles of the target time; the last one holds its end."""
    if folds < 1 or not 0 < warmup < 1:
        raise ValueError("folds must be positive and warmup between 0 and 1")
    points = [warmup + (1 - warmup) * i / folds for i in range(folds + 1)]
    bounds = samples.agg(F.percentile(time, points).alias("b")).select(F.transform("b", lambda x: x.cast("long")).alias("b"))
    rows = bounds.select(F.posexplode(F.slice("b", 1, folds)).alias("fold", "start_ts"), "b")
    end = F.col("b")[F.col("fold") + 1]
    return rows.select(F.col("fold").cast("long").alias("fold"), "start_ts", F.when(F.col("fold") == folds - 1, end + 1).otherwise(end).alias("end_ts"))
