"""Metrics of ranked lists. Shares are of all labels or samples; a group without any gets 0 or, where a mean has no rows, null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sessions import number_rows

ACTION_WEIGHTS = {"clicks": 0.1, "carts": 0.3, "orders": 0.6}


def _weight(column: str = "target_type") -> Column:
    return F.create_map(*(F.lit(x) for pair in ACTION_WEIGHTS.items() for x in pair))[F.col(column)]


def _by_action(rows: DataFrame, hit: str, prefix: str, total: str) -> DataFrame:
    shares = {a: F.coalesce(F.avg(F.when(F.col("target_type") == a, F.col(hit).cast("double"))), F.lit(0.0)) for a in ACTION_WEIGHTS}
    one = rows.agg(*(v.alias(f"{prefix}{a}") for a, v in shares.items()))
    combined = sum((F.lit(w) * F.col(f"{prefix}{a}") for a, w in ACTION_WEIGHTS.items()), F.lit(0.0))
    return one.withColumn(total, combined)


def _hits(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    found = candidates.select("session", F.col("aid").alias("target_aid")).distinct().withColumn("hit", F.lit(1))
    return labels.join(found, ["session", "target_aid"], "left").fillna(0, ["hit"])


def recall_at(scored: DataFrame, labels: DataFrame, k: int, score: str = "score") -> DataFrame:
    """One row: share of targets among the ``k`` best items of their session, by action and weighted."""
    w = Window.partitionBy("session").orderBy(F.desc(F.round(score, 9)), "aid")
    best = scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    return _by_action(_hits(best, labels), "hit", "recall_", "weighted_recall")


def candidate_recall(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: share of targets among all candidates: overall, by action and weighted."""
    rows = _hits(candidates, labels)
    return _by_action(rows, "hit", "candidate_recall_", "weighted_candidate_recall").join(rows.agg(F.avg(F.col("hit").cast("double")).alias("candidate_recall")))


def source_recall(candidates: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``source, recall``: share of all targets among each source's ``k`` first ranks."""
    w = Window.partitionBy("source", "session").orderBy("source_rank", "aid")
    best = candidates.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    hits = best.join(labels.select("session", F.col("target_aid").alias("aid")), ["session", "aid"]).select("source", "session").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("__h"))
    total = labels.agg(F.count(F.lit(1)).alias("__n"))
    every = candidates.select("source").distinct().join(F.broadcast(total))
    return every.join(hits, "source", "left").select("source", (F.coalesce("__h", F.lit(0)) / F.col("__n")).alias("recall"))


def positive_ranks(scored: DataFrame, key: str = "sample_id", item: str = "aid", score: str = "final_score") -> DataFrame:
    """Per sample: the target's rank (null if it isn't there) and how many others score less or the same.

    The rank is counted, not sorted: items that score more, or the same with a smaller id. One aggregation after a join with
    one row per sample. At most one positive per sample is expected; of several the best counts.
    """
    target = scored.filter("label = 1").groupBy(key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i"))).alias("__p")).select(key, F.col("__p.s").alias("__s"), (-F.col("__p.i")).alias("__i"))
    rows = scored.join(target, key, "left")
    better = (F.col(score) > F.col("__s")) | ((F.col(score) == F.col("__s")) & (F.col(item) < F.col("__i")))
    negative = F.col("label") == 0
    return rows.groupBy(key).agg(
        F.first("target_type").alias("target_type"),
        F.max(F.col("__s").isNotNull()).alias("__has"),
        F.count_if(better).alias("__better"),
        F.count_if(negative & (F.col("__s") > F.col(score))).alias("wins"),
        F.count_if(negative & (F.col("__s") == F.col(score))).alias("ties"),
        F.count_if(negative).alias("negatives"),
    ).withColumn("rank", F.when(F.col("__has"), F.col("__better") + 1)).drop("__has", "__better")


def toplist(scored: DataFrame, k: int = 20) -> DataFrame:
    """One row of list metrics of ``sample_id, aid, target_type, label, final_score``: hit rate, MRR and NDCG at ``k``, weighted and by
    action, and AUC over the candidates, over samples with a recalled target and end to end."""
    rows = positive_ranks(scored)
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    rows = rows.withColumns(
        {
            "hit": hit.cast("double"),
            "mrr": F.when(hit, F.lit(1.0) / F.col("rank")).otherwise(0.0),
            "ndcg": F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + 1.0)).otherwise(0.0),
            "w": _weight(),
            "pairs": F.when(F.col("rank").isNotNull(), F.col("negatives")).otherwise(0),
        }
    )
    rows = rows.withColumn("auc", F.when(F.col("pairs") > 0, (F.col("wins") + F.lit(0.5) * F.col("ties")) / F.col("pairs")))
    weighted = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("w")) / F.sum("w")
    aggs = [F.count(F.lit(1)).alias("samples"), F.avg(F.col("rank").isNotNull().cast("double")).alias("candidate_recall"), F.avg("hit").alias("hit_rate"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), weighted("hit").alias("event_weighted_hit_rate"), weighted("mrr").alias("event_weighted_mrr"), weighted("ndcg").alias("event_weighted_ndcg")]
    aggs += [F.coalesce(F.avg(F.when(F.col("target_type") == a, F.col("hit"))), F.lit(0.0)).alias(f"{a}_hit_rate") for a in ACTION_WEIGHTS]
    aggs += [(F.sum(F.when(F.col("pairs") > 0, F.col("wins") + F.lit(0.5) * F.col("ties"))) / F.sum("pairs")).alias("conditional_auc"), F.avg("auc").alias("conditional_gauc"), F.count("auc").alias("auc_samples"), F.avg(F.coalesce("auc", F.lit(0.0))).alias("end_to_end_gauc"), weighted("auc").alias("event_weighted_end_to_end_gauc")]
    one = rows.agg(*aggs)
    macro = sum((F.lit(w) * F.col(f"{a}_hit_rate") for a, w in ACTION_WEIGHTS.items()), F.lit(0.0))
    return one.withColumn("macro_weighted_hit_rate", macro)


def uauc(rows: DataFrame, user: str = "visitorid", score: str = "final_score") -> DataFrame:
    """One row: mean AUC over users, plain and weighted by pairs, ranks of equal scores averaged; users without both labels don't count.

    Per user and score the labels are counted first; the window runs over different scores.
    """
    cells = rows.groupBy(user, score).agg(F.sum("label").alias("p"), F.sum(F.lit(1) - F.col("label")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(user).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = cells.withColumn("__w", F.col("p") * (below + F.lit(0.5) * F.col("n")))
    users = won.groupBy(user).agg(F.sum("__w").alias("w"), (F.sum("p") * F.sum("n")).alias("pairs")).filter("pairs > 0")
    return users.agg(F.avg(F.col("w") / F.col("pairs")).alias("uauc"), (F.sum("w") / F.sum("pairs")).alias("weighted_uauc"), F.count(F.lit(1)).alias("eligible_users"))


def end_to_end(scored: DataFrame) -> DataFrame:
    """Scored rows and, for samples whose target wasn't recalled, a positive with the score minus infinity."""
    missing = scored.groupBy("sample_id").agg(F.max("label").alias("__l"), F.first("target_type").alias("target_type")).filter("__l = 0")
    added = missing.select("sample_id", "target_type", F.lit(1).alias("label"), F.lit(float("-inf")).alias("final_score"))
    return scored.unionByName(added, allowMissingColumns=True)


def list_metrics(ranks: DataFrame, ks: list[int], rank: str = "rank") -> DataFrame:
    """One row per k: hit rate, NDCG and MRR of single targets; a null rank is a miss."""
    hit = F.coalesce(F.col(rank) <= F.col("k"), F.lit(False))
    rows = ranks.select(rank, F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return rows.groupBy("k").agg(
        F.avg(hit.cast("double")).alias("hit_rate"),
        F.avg(F.when(hit, F.lit(1.0) / F.log2(F.col(rank) + 1.0)).otherwise(0.0)).alias("ndcg"),
        F.avg(F.when(hit, F.lit(1.0) / F.col(rank)).otherwise(0.0)).alias("mrr"),
    )


def single_positive_auc(scored: DataFrame, key: str = "sample_id", score: str = "final_score") -> DataFrame:
    """One row: AUC over all pairs and mean AUC per sample, of one positive against all finite negatives, ties counting half."""
    rows = positive_ranks(scored.filter((F.col("label") == 1) | ((F.abs(score) != float("inf")) & ~F.isnan(score))), key, score=score).filter(F.col("rank").isNotNull() & (F.col("negatives") > 0))
    won = F.col("wins") + F.lit(0.5) * F.col("ties")
    return rows.agg((F.sum(won) / F.sum("negatives")).alias("auc"), F.avg(won / F.col("negatives")).alias("uauc"))


def popularity_ranks(samples: DataFrame, events: DataFrame, exclude_seen: bool = True) -> DataFrame:
    """``sample_id, rank`` of the target in the list of all items by popularity; items of the history don't count, the target does.

    The rank is the target's place less the seen items before it, so no list is built per sample. Runs jobs (the numbering).
    """
    counts = events.groupBy("item").agg(F.count(F.lit(1)).alias("__n"))
    places = number_rows(counts, "__place", F.desc("__n"), F.col("item")).select("item", (F.col("__place") + 1).alias("__place"))
    rows = samples.join(places.select(F.col("item").alias("target"), F.col("__place").alias("__t")), "target", "left")
    if not exclude_seen:
        return rows.select("sample_id", F.col("__t").cast("long").alias("rank"))
    seen = rows.select("sample_id", "target", "__t", F.explode(F.array_distinct("history")).alias("item")).filter(F.col("item") != F.col("target")).join(places, "item").filter(F.col("__place") < F.col("__t"))
    before = seen.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__b"))
    return rows.join(before, "sample_id", "left").select("sample_id", (F.col("__t") - F.coalesce("__b", F.lit(0))).cast("long").alias("rank"))


def ordinal_violations(scored: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: share of candidates, and of samples with a candidate, whose click, cart and order probabilities don't fall."""
    bad = (F.col("p_click") < F.col("p_cart")) | (F.col("p_cart") < F.col("p_order"))
    rows = scored.groupBy(key).agg(F.count_if(bad).alias("b"), F.count(F.lit(1)).alias("n"))
    return rows.agg((F.sum("b") / F.sum("n")).alias("candidate_violation_rate"), F.avg((F.col("b") > 0).cast("double")).alias("session_violation_rate"))


def grid_search(rows: DataFrame, columns: list[str], grid: list[tuple[float, ...]], first: Column, k: int = 20) -> DataFrame:
    """Per set of weights: hit rate at ``k`` on the samples where ``first`` holds and on the others, and whether it is best on the first.

    ``rows``: ``sample_id, aid, label, target_type`` and the columns to weigh. The grid is a short list, so each row is scored for all of it at once.
    """
    options = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(float(w)).alias(f"w{j}") for j, w in enumerate(ws))) for i, ws in enumerate(grid)))
    wide = rows.withColumns({"__first": first, "g": F.explode(options)})
    score = F.lit(0.0)
    for j, c in enumerate(columns):
        score = score + F.col(f"g.w{j}") * F.col(c)
    scored = wide.select(F.struct("g.i", "sample_id", "__first").alias("cell"), "aid", "label", "target_type", F.round(score, 9).alias("final_score"))
    ranks = positive_ranks(scored, "cell")
    hit = F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")
    out = ranks.groupBy(F.col("cell.i").alias("option")).agg(F.avg(F.when(F.col("cell.__first"), hit)).alias("first_hit_rate"), F.avg(F.when(~F.col("cell.__first"), hit)).alias("held_out_hit_rate"))
    best = out.agg(F.max(F.struct(F.round("first_hit_rate", 9).alias("h"), (-F.col("option")).alias("o"))).alias("b")).select((-F.col("b.o")).alias("__best"))
    return out.join(F.broadcast(best)).select(F.col("option").cast("long").alias("option"), "first_hit_rate", "held_out_hit_rate", (F.col("option") == F.col("__best")).alias("chosen"))
