"""Queries that train models, and what their training reaches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.adapters import behaviour, feedback, item_vectors, with_sql
from tideline.operators import asof, codes, embeddings, features, fusion, indexes, metrics, models, sequences
from tideline.operators.clean import fill_routes
from tideline.operators.events import typed_events
from tideline.plans.events import _FS, rounded
from tideline.plans.recall import ROUTE_NAMES, candidates, labels
from tideline.plans.registry import Registry
from tideline.session import read_table, release, settle

query = Registry()


def next_items(spark: SparkSession, folder: str) -> DataFrame:
    """``sample_id, session, history, types, buckets, target, target_type, ts`` of the validation samples."""
    rows = read_table(spark, folder, "validation_samples").distinct().dropna(subset=["target_aid", "target_type_id", "target_ts"])
    buckets = F.transform("history_time_deltas_ms", lambda d: features.time_bucket(d) - 1)
    return rows.select("sample_id", "session", F.col("history_aids").alias("history"), F.col("history_type_ids").cast("array<long>").alias("types"), buckets.alias("buckets"), F.col("target_aid").alias("target"), F.col("target_type_id").cast("long").alias("target_type"), F.col("target_ts").alias("ts"))


def _items(samples: DataFrame) -> DataFrame:
    """Items of the histories and targets, in one pass."""
    return samples.select(F.explode(F.concat(F.coalesce("history", F.array().cast("array<long>")), F.array("target"))).alias("item_id"))


def _falling(spark: SparkSession, rows: list[tuple[str, list[float]]]) -> DataFrame:
    """Per model its epochs and whether the loss of the last is below that of the first."""
    return spark.createDataFrame([(name, len(x), x[-1] < x[0]) for name, x in rows], "model string, epochs int, falls boolean")


@query()
def two_tower(spark: SparkSession, folder: str) -> DataFrame:
    """Item vectors of the towers with a recurrent user."""
    samples = settle(next_items(spark, folder))
    return models.tower_items(spark, models.train_towers(samples, _items(samples), epochs=2))


def item_features(spark: SparkSession, folder: str) -> DataFrame:
    """``item_id, categories`` (leaf, parent, root and depth as numbers from 1), ``numbers`` (scaled logarithms of events by action, availability)
    and ``known`` (the item's vector)."""
    states = read_table(spark, folder, "item_category_changes").dropna(subset=["itemid", "timestamp", "categoryid"])
    tree = read_table(spark, folder, "category_tree")
    paths = asof.category_paths(spark, tree, states)
    index = features.vocabulary(paths.select(F.explode("category_path").alias("c")).unionByName(paths.select(F.col("categoryid").alias("c"))), "c")
    for name, value in (("leaf", F.col("categoryid")), ("parent", F.try_element_at("category_path", F.lit(-2))), ("root", F.col("root_categoryid"))):
        paths = features.encode(paths.withColumn("c", value), "c", index, name).drop("c")
    path = paths.select("categoryid", F.array("leaf", "parent", "root", F.col("category_depth") + 1).alias("categories"))
    leaf = states.groupBy("itemid").agg(F.max(F.struct("timestamp", "categoryid"))["categoryid"].alias("categoryid")).join(path, "categoryid").select(F.col("itemid").alias("item_id"), "categories")
    available = read_table(spark, folder, "item_availability_changes").dropna(subset=["itemid", "timestamp", "available"])
    available = available.groupBy(F.col("itemid").alias("item_id")).agg(F.max(F.struct("timestamp", "available"))["available"].cast("double").alias("available"))
    events = typed_events(read_table(spark, folder, "events_all"))
    counts = events.groupBy(F.col("aid").alias("item_id")).agg(*(F.log1p(F.count_if(F.col("type") == a)).alias(a) for a in ("clicks", "carts", "orders")))
    counts = features.standardise(counts, ["clicks", "carts", "orders"])
    known = item_vectors(spark, folder).withColumnRenamed("vector", "known")
    rows = counts.join(leaf, "item_id", "left").join(available, "item_id", "left").join(known, "item_id", "left")
    return rows.select("item_id", "categories", F.array("clicks", "carts", "orders", F.coalesce("available", F.lit(-1.0))).alias("numbers"), "known")


def ranked_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by route with ranks from 1 without gaps."""
    w = Window.partitionBy("session", "source").orderBy("source_rank", "aid")
    rows = fusion.distinct_union(candidates(spark, folder))
    return rows.select(F.col("session").alias("sample_id"), "aid", "source", F.row_number().over(w).cast("long").alias("rank"))


def blocked_items(spark: SparkSession, folder: str) -> DataFrame:
    """``sample_id, aid``: each session's target and its items from the target's time on."""
    targets = read_table(spark, folder, "validation_samples").select(F.col("session").alias("sample_id"), F.col("target_aid").alias("aid"), "target_ts").distinct()
    events = read_table(spark, folder, "events_all").select(F.col("session").alias("sample_id"), F.col("aid").alias("__a"), "ts").dropna()
    later = events.join(targets.select("sample_id", "target_ts"), "sample_id").filter(F.col("ts") >= F.col("target_ts")).select("sample_id", F.col("__a").alias("aid"))
    return targets.select("sample_id", "aid").unionByName(later).distinct()


_ROUTES = """r0 AS (SELECT session AS sample_id, aid, source, min(source_rank) AS k FROM candidate_features WHERE isfinite(final_score) AND session IS NOT NULL AND aid IS NOT NULL GROUP BY ALL),
r AS (SELECT sample_id, aid, source, row_number() OVER (PARTITION BY sample_id, source ORDER BY k, aid) AS rank FROM r0),
ends AS (SELECT sample_id, least(max(CASE WHEN source = 'itemcf' THEN rank END), max(CASE WHEN source = 'transition' THEN rank END)) AS n FROM r WHERE source IN ('itemcf', 'transition') GROUP BY sample_id HAVING count(DISTINCT source) = 2),
pools AS (SELECT sample_id, 0 AS pool, rank - 11 AS ordinal, aid FROM r WHERE source = 'item2vec' AND rank BETWEEN 11 AND 42
 UNION ALL SELECT sample_id, 1, 2 * (rank - 1) + (source = 'transition')::INT AS o, aid FROM r JOIN ends USING (sample_id) WHERE source IN ('itemcf', 'transition') AND rank <= n AND 2 * (rank - 1) + (source = 'transition')::INT < 24
 UNION ALL SELECT sample_id, 2, rank - 1, aid FROM r WHERE source = 'category' AND rank <= 16
 UNION ALL SELECT sample_id, 3, rank - 1, aid FROM r WHERE source = 'popular' AND rank <= 12),
tg AS (SELECT DISTINCT session, target_aid, target_ts FROM validation_samples), blocked AS (SELECT session, target_aid AS aid FROM tg UNION SELECT e.session, e.aid FROM events_all e JOIN tg ON tg.session = e.session AND e.ts >= target_ts WHERE e.aid IS NOT NULL),
free AS (SELECT p.* FROM pools p ANTI JOIN blocked b ON b.session = p.sample_id AND b.aid = p.aid), one AS (SELECT *, row_number() OVER (PARTITION BY sample_id, aid ORDER BY ordinal, pool) AS k FROM free)"""


@query(f"WITH {_ROUTES} SELECT * FROM (SELECT sample_id, aid, row_number() OVER (PARTITION BY sample_id ORDER BY ordinal, pool, aid) AS place FROM one WHERE k = 1) WHERE place <= 96")
def negative_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives without the drawn ones."""
    return fusion.round_robin(fusion.negative_pools(ranked_routes(spark, folder)), blocked_items(spark, folder), 96)


def _negatives(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """``sample_id, negatives`` of the validation samples, or of the sessions in ``only``."""
    counts = typed_events(read_table(spark, folder, "events_all")).groupBy("aid").agg(F.count(F.lit(1)).alias("n"))
    samples = (read_table(spark, folder, "validation_samples") if only is None else only).select(F.col("session").alias("sample_id")).distinct()
    routes, blocked = ranked_routes(spark, folder), blocked_items(spark, folder)
    if only is not None:
        routes, blocked = (df.join(samples, "sample_id", "left_semi") for df in (routes, blocked))
    return fusion.negative_lists(routes, blocked, counts, samples)


@query("SELECT count(DISTINCT session) AS samples, 0::BIGINT AS blocked, true AS full, true AS distinct_items FROM validation_samples")
def hard_negatives_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """That every sample gets 96 different hard negatives, none of them blocked."""
    found = settle(_negatives(spark, folder).select("sample_id", F.explode("negatives").alias("aid")))
    per = found.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("aid").alias("d"))
    wrong = found.join(blocked_items(spark, folder), ["sample_id", "aid"]).count()
    return per.agg(F.count(F.lit(1)).alias("samples"), F.lit(wrong).cast("long").alias("blocked"), F.bool_and(F.col("n") == 96).alias("full"), F.bool_and(F.col("n") == F.col("d")).alias("distinct_items"))


def _wide(spark: SparkSession, folder: str, samples: DataFrame, catalogue: DataFrame, epochs: int) -> models.Fitted:
    negatives = _negatives(spark, folder, samples)
    rows = samples.withColumn("sample_id", F.col("session"))
    return models.train_towers(rows, catalogue, epochs=epochs, features=item_features(spark, folder), negatives=negatives, hard=(0.0, 0.25, 0.5))


@query("SELECT model, epochs, true AS falls FROM (VALUES ('towers', 4), ('attention', 3), ('decoder', 3)) t(model, epochs)")
def training_losses(spark: SparkSession, folder: str) -> DataFrame:
    """That the loss of each sequence model falls."""
    samples = settle(next_items(spark, folder))
    tower = models.train_towers(samples, _items(samples), epochs=4)
    windows, events = _windows(spark, folder)
    attention = models.train_attention(windows, events.select("item_id"), 20, epochs=3)
    decoder = models.train_decoder(*_coded(spark, folder), 8, epochs=3)
    return _falling(spark, [("towers", tower.losses), ("attention", attention.losses), ("decoder", decoder.losses)])


@query()
def two_tower_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Item vectors of the towers with item features and hard negatives."""
    samples = next_items(spark, folder)
    return models.tower_items(spark, _wide(spark, folder, samples, _items(samples), 3))


@query()
def recall_two_tower(spark: SparkSession, folder: str) -> DataFrame:
    """The route of the two towers: the 50 nearest items of each sample's user."""
    samples = next_items(spark, folder)
    return models.recall_towers(samples, models.train_towers(samples, _items(samples), epochs=2), 50)


def _held_out(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The earlier four fifths of the samples by their times, and the others."""
    cut = samples.agg(F.percentile("ts", 0.8)).first()[0] or 0
    return samples.filter(F.col("ts") < cut), samples.filter(F.col("ts") >= cut)


@query()
def two_tower_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Hit rates of held-out targets among the first 20 and 200 items: both kinds of towers, and the most frequent items of the training histories."""
    samples = settle(next_items(spark, folder))
    train, test = _held_out(samples)
    items = _items(samples).unionByName(typed_events(read_table(spark, folder, "events_all")).select(F.col("aid").alias("item_id")))
    asked, out = test.withColumn("sample_id", F.col("session")), None
    for name, fit in (("towers", lambda: models.train_towers(train, items, epochs=8, rate=0.02)), ("towers with features", lambda: _wide(spark, folder, train, items, 8))):
        fitted = fit()
        ranks = settle(models.target_ranks(asked, fitted, 200))
        fitted.discard()
        del fitted
        release(spark)
        one = metrics.list_metrics(ranks, [20, 200]).select(F.lit(name).alias("model"), "k", "hit_rate")
        out = one if out is None else out.unionByName(one)
    frequent = indexes.popularity(_items(train).withColumnRenamed("item_id", "aid"), 200).select(F.col("aid").alias("target"), "rank")
    ranks = asked.select("target").join(frequent, "target", "left").select("rank")
    return out.unionByName(metrics.list_metrics(ranks, [20, 200]).select(F.lit("popularity").alias("model"), "k", "hit_rate"))


def _windows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = feedback(spark, folder)
    before = embeddings.before_last(events, 1)
    return sequences.masked_windows(sequences.feedback_sequences(before), length=20), events


@query()
def attention_eval(spark: SparkSession, folder: str) -> DataFrame:
    """List metrics of each user's last positive item by self-attention over what came before, and of the most frequent items."""
    events = settle(feedback(spark, folder))
    asked = settle(sequences.last_positive_samples(sequences.feedback_sequences(events), history=20).filter("position > 0"))
    order = events.join(asked.select("user_id", F.col("position")), "user_id")
    w = Window.partitionBy("user_id").orderBy("timestamp", "event_order")
    before = order.withColumn("__p", F.row_number().over(w) - 1).filter(F.col("__p") < F.col("position"))  # nothing from the target on is learned from
    fitted = models.train_attention(sequences.masked_windows(sequences.feedback_sequences(before), length=20), events.select("item_id"), 20, epochs=8, rate=0.02)
    frequent = metrics.popularity_ranks(asked.select(F.col("user_id").alias("sample_id"), "target", F.filter("history", lambda x: x > 0).alias("history")), before.select(F.col("item_id").alias("item")))
    own = metrics.list_metrics(models.attention_ranks(asked, fitted), [20, 50]).withColumn("model", F.lit("attention"))
    return rounded(own.unionByName(metrics.list_metrics(frequent, [20, 50]).withColumn("model", F.lit("popularity"))))


def _coded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Next-item samples of the feedback log and unique codes of its items: two tokens by a hash and the number within."""
    events = feedback(spark, folder)
    samples = sequences.positive_samples(sequences.feedback_sequences(embeddings.before_last(events, 1)), history=8)
    cat = codes.collision_tail(codes.random_codes(events.select("item_id").dropna().distinct(), [8, 8])).withColumnRenamed("tail", "c3")
    return samples, cat


@query()
def decoder_eval(spark: SparkSession, folder: str) -> DataFrame:
    """List metrics of each user's last positive item by the code decoder and a beam over legal codes."""
    samples, cat = _coded(spark, folder)
    fitted = models.train_decoder(samples, cat, 8, epochs=6, rate=0.02)
    asked = sequences.last_positive_samples(sequences.feedback_sequences(feedback(spark, folder)), history=8).filter("position > 0")
    found = models.decode_topk(asked, fitted, beam=60, topk=20)
    ranks = asked.select("user_id", F.col("target").alias("item_id")).join(found, ["user_id", "item_id"], "left").select("rank")
    return rounded(metrics.list_metrics(ranks, [5, 20]))


@query(f"{with_sql('feedback')}, {_FS}, t AS (SELECT user_id, max(p) AS p FROM fs WHERE is_positive = 1 GROUP BY user_id HAVING max(p) > 1) SELECT count(*) AS users, 20 * count(*) AS rows, true AS legal FROM t")
def decoder_beam(spark: SparkSession, folder: str) -> DataFrame:
    """That the beam gives each user as many different items of the catalogue as asked for."""
    samples, cat = _coded(spark, folder)
    fitted = models.train_decoder(samples, cat, 8, epochs=1)
    asked = sequences.last_positive_samples(sequences.feedback_sequences(feedback(spark, folder)), history=8).filter("position > 0")
    found = models.decode_topk(asked, fitted, beam=60, topk=20).join(cat.select("item_id", F.lit(True).alias("legal")), "item_id", "left")
    per = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("d"), F.bool_and(F.coalesce("legal", F.lit(False))).alias("l"))
    return per.agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("rows"), F.bool_and(F.col("l") & (F.col("n") == F.col("d"))).alias("legal"))


@query("SELECT kind, 4 AS epochs, true AS falls FROM (VALUES ('static'), ('mlp'), ('gate')) t(kind)")
def trained_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """That the loss of each fusion head falls, trained on three probabilities made from the scores."""
    from tideline.plans.ranking import probabilities

    rows = settle(probabilities(spark, folder).drop("label").join(_labelled(spark, folder), ["sample_id", "aid"]))
    found = [(kind, models.train_fusion(rows, kind, ["p_click", "p_cart", "p_order"], ["source_count"], epochs=4, rate=0.05)[2]) for kind in ("static", "mlp", "gate")]
    return _falling(spark, found).withColumnRenamed("model", "kind")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    samples = read_table(spark, folder, "validation_samples").select("sample_id", F.col("target_aid").alias("aid"), F.lit(1).alias("label")).distinct()
    rows = read_table(spark, folder, "candidate_features").dropna(subset=["sample_id", "aid"]).groupBy("sample_id", "aid").agg(F.count_distinct("source").alias("source_count"))
    return rows.join(samples, ["sample_id", "aid"], "left").fillna(0, ["label"])


def ranker_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Candidates with the targets of three tasks and all route features, ranks as reciprocals, scaled; and the features' names."""
    rows = fusion.compact(candidates(spark, folder), labels(spark, folder), ROUTE_NAMES, 0, 100)
    rows = fill_routes(rows, ROUTE_NAMES)
    names = ["rrf_score", "source_count", "best_source_rank"]
    for name in ROUTE_NAMES:
        rows = rows.withColumn(f"source_rank_{name}", F.lit(1.0) / F.col(f"source_rank_{name}"))
        names += [f"source_rank_{name}", f"source_score_{name}", f"source_present_{name}"]
    rows = rows.select("session", "aid", "label", "target_type", *(F.col(c).cast("double").alias(c) for c in names))
    return features.task_targets(features.standardise(rows, names)), names


@query("SELECT kind, true AS falls, true AS stops_in_time FROM (VALUES ('shared_bottom'), ('mmoe'), ('ple')) t(kind)")
def ranker_training(spark: SparkSession, folder: str) -> DataFrame:
    """That the rankers' losses fall over all route features, with early stopping by the last tenth of the sessions in time."""
    rows, names = ranker_rows(spark, folder)
    times = read_table(spark, folder, "validation_samples").groupBy("session").agg(F.max("target_ts").alias("__ts"))
    cut = times.agg(F.percentile("__ts", 0.9)).first()[0]
    timed = settle(rows.join(times, "session"))
    train, valid = timed.filter(F.col("__ts") < cut), timed.filter(F.col("__ts") >= cut)
    out = []
    for kind in ("shared_bottom", "mmoe", "ple"):
        _, losses = models.train_ranker(train, names, kind, epochs=3, valid=valid)
        out.append((kind, len(losses) < 2 or losses[-1] < losses[0], len(losses) <= 3))
    return spark.createDataFrame(out, "kind string, falls boolean, stops_in_time boolean")


@query()
def item2vec(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.item2vec(indexes.adaptive_pairs(behaviour(spark, folder)), dims=16, epochs=2)


@query("WITH e AS (SELECT DISTINCT session, aid, ts, event_order FROM events_all WHERE session IS NOT NULL AND aid IS NOT NULL AND trim(lower(type)) IN ('clicks', 'view', 'carts', 'addtocart', 'orders', 'transaction')), n AS (SELECT session FROM e GROUP BY session HAVING count(*) > 1) SELECT count(DISTINCT aid) AS items, true AS nearer, 3 AS checkpoints FROM e WHERE session IN (SELECT session FROM n)")
def item2vec_checks(spark: SparkSession, folder: str) -> DataFrame:
    """That items of common sessions are nearer than pairs drawn at random, and that each epoch is handed out."""
    events = typed_events(read_table(spark, folder, "events_all")).filter("session IS NOT NULL")
    pairs = indexes.adaptive_pairs(settle(events.select("session", "aid", "ts", "event_order").distinct()))  # pairs are made again where needed, as they are many times the events
    seen, last = [], []

    def keep(epoch: int, ids: np.ndarray, x: np.ndarray) -> None:
        seen.append(epoch)
        last[:] = ids, x

    found = embeddings.item2vec(pairs, dims=16, epochs=3, rate=0.1, schedule=lambda e: 1.0 / (1 + e), checkpoint=keep)
    n = found.count()
    if not n:
        return spark.createDataFrame([(0, False, len(seen))], "items long, nearer boolean, checkpoints int")
    ids, x = last
    near = _mean_cosine(models.numbered(pairs.filter("center <> context").select(F.col("center").alias("a"), F.col("context").alias("b")), ids, (), ("a", "b")).filter("a > 0 AND b > 0"), x)
    drawn = found.select(F.col("item_id").alias("a"), F.explode(F.array(*map(F.lit, range(8)))).alias("j"))
    drawn = drawn.select("a", (F.pmod(F.xxhash64("a", "j"), F.lit(n)) + 1).alias("b"))
    far = _mean_cosine(models.numbered(drawn, ids, (), ("a",)), x)
    return spark.createDataFrame([(n, near is not None and near > far, len(seen))], "items long, nearer boolean, checkpoints int")


def _mean_cosine(places: DataFrame, x: np.ndarray) -> float | None:
    """Mean cosine of the rows ``a`` and ``b`` (from 1) of a matrix that fits in each task; None without pairs."""
    length = np.linalg.norm(x, axis=1)
    shared = places.sparkSession.sparkContext.broadcast((x, length))

    def kernel(batches):
        x, length = shared.value
        for frame in batches:
            a, b = frame["a"].to_numpy() - 1, frame["b"].to_numpy() - 1
            cosine = np.einsum("id,id->i", x[a], x[b]) / np.maximum(length[a] * length[b], 1e-12)
            yield pd.DataFrame({"n": [len(frame)], "s": [float(cosine.sum())]})

    n, total = places.select("a", "b").mapInPandas(kernel, "n long, s double").agg(F.sum("n"), F.sum("s")).first()
    return total / n if n else None


@query("SELECT doc_id, true AS unit FROM documents WHERE trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) <> ''")
def text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of texts by a function of one's own, here of letter counts: a unit vector for every text that isn't blank."""

    def letters(texts: list[str]) -> np.ndarray:
        return np.array([[1.0, *(t.count(c) for c in "aeiou")] for t in texts])

    rows = embeddings.text_vectors(read_table(spark, folder, "documents"), "doc_id", "text", letters)
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("doc_id", (F.abs(length - 1) < 1e-6).alias("unit"))


QUERIES, ORACLES = query.queries, query.oracles
