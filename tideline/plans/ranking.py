"""Queries over features, metrics and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.adapters import CUTOFF_MS, behaviour, with_sql
from tideline.operators import clean, diagnostics, features, fusion, metrics
from tideline.plans.events import rounded, texts
from tideline.plans.recall import CAND_SQL, ROUTE_NAMES, candidates, labels
from tideline.plans.registry import Registry

query = Registry()

_STATS = "stats AS (SELECT aid, count(*) AS item_events, count(DISTINCT session) AS item_sessions, max(ts) AS item_last_ts, CAST(sum(CASE WHEN type = 'clicks' THEN 1 ELSE 0 END) AS BIGINT) AS item_clicks, CAST(sum(CASE WHEN type = 'carts' THEN 1 ELSE 0 END) AS BIGINT) AS item_carts, CAST(sum(CASE WHEN type = 'orders' THEN 1 ELSE 0 END) AS BIGINT) AS item_orders FROM {} GROUP BY aid)"
_HISTORY = "history AS (SELECT session, unnest(history_aids) AS aid, target_ts - unnest(history_time_deltas_ms) AS ts FROM (SELECT DISTINCT session, target_ts, history_aids, history_time_deltas_ms FROM validation_samples))"


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the validation samples' histories."""
    rows = spark.read.parquet(f"{folder}/validation_samples.parquet").select("session", "target_ts", "history_aids", "history_time_deltas_ms", "history_type_ids").distinct()
    kinds = F.create_map(F.lit(0), F.lit("clicks"), F.lit(1), F.lit("carts"), F.lit(2), F.lit("orders"))
    zipped = rows.select("session", "target_ts", F.explode(F.arrays_zip("history_aids", "history_time_deltas_ms", "history_type_ids")).alias("h"))
    return zipped.select("session", F.col("h.history_aids").alias("aid"), (F.col("target_ts") - F.col("h.history_time_deltas_ms")).alias("ts"), kinds[F.col("h.history_type_ids")].alias("type"))


@query(f"{with_sql('beh')}, {_STATS.format('beh')} SELECT *, round(item_carts / item_events, 6) AS cart_rate, round(item_orders / item_events, 6) AS order_rate FROM stats")
def item_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.item_statistics(behaviour(spark, folder)))


_WIDE = ", ".join(f"coalesce(min(CASE WHEN source = '{s}' THEN source_rank END), 0) AS source_rank_{s}, coalesce(round(max(CASE WHEN source = '{s}' THEN source_score END), 6), 0) AS source_score_{s}" for s in ROUTE_NAMES)


@query(f"""WITH {CAND_SQL}, {_HISTORY}, stats AS (SELECT aid, count(*) AS item_events, count(DISTINCT session) AS item_sessions FROM history GROUP BY aid),
 pr AS (SELECT session, aid, count(*) AS in_session_count, max(ts) AS pair_last FROM history GROUP BY ALL), se AS (SELECT session, CAST(sum(in_session_count) AS BIGINT) AS session_length, count(*) AS session_unique_items, max(pair_last) AS session_last_ts FROM pr GROUP BY session)
 SELECT c.*, coalesce(item_events, 0) AS item_events, coalesce(item_sessions, 0) AS item_sessions, coalesce(session_length, 0) AS session_length, coalesce(session_unique_items, 0) AS session_unique_items, coalesce(session_last_ts, 0) AS session_last_ts, coalesce(in_session_count, 0) AS in_session_count, coalesce(session_last_ts - pair_last, 0) AS ms_since_seen
 FROM (SELECT session, aid, round(sum(1.0 / (60.0 + source_rank)), 6) AS rrf_score, count(DISTINCT source) AS source_count, min(source_rank) AS best_source_rank, {_WIDE} FROM cand GROUP BY session, aid) c LEFT JOIN stats USING (aid) LEFT JOIN se USING (session) LEFT JOIN pr USING (session, aid)""")
def candidate_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.candidate_features(history(spark, folder), candidates(spark, folder), ROUTE_NAMES)
    return rounded(rows.drop("item_last_ts", "item_clicks", "item_carts", "item_orders", "cart_rate", "order_rate"))


_LABELLED = "labelled AS (SELECT c.session, c.aid, target_type, CAST(coalesce(c.aid = target_aid, false) AS INT) AS label FROM (SELECT DISTINCT session, aid FROM cand) c LEFT JOIN lab USING (session))"


@query(f"WITH {CAND_SQL}, {_LABELLED} SELECT *, label AS label_clicks, CASE WHEN target_type IN ('carts', 'orders') THEN label ELSE 0 END AS label_carts, CASE WHEN target_type = 'orders' THEN label ELSE 0 END AS label_orders FROM labelled")
def task_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.attach_labels(candidates(spark, folder).select("session", "aid").distinct(), labels(spark, folder))
    return features.task_targets(rows).fillna(0, ["label_carts", "label_orders"])


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/validation_samples.parquet").distinct()


@query("SELECT DISTINCT sample_id, target_ts, target_aid, target_type, len(history_aids) AS history_length, len(list_distinct(history_aids)) AS history_unique_items, history_aids[-1] AS last_aid, history_type_ids[-1] AS last_type_id, round(list_max(history_time_deltas_ms) / 60000.0, 6) AS session_span_minutes FROM validation_samples")
def session_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.session_features(_samples(spark, folder)))


@query("SELECT sample_id, aid, count(*) AS history_candidate_count, min(back) AS history_candidate_recency FROM (SELECT sample_id, unnest(list_reverse(history_aids)) AS aid, unnest(range(1, len(history_aids) + 1)) AS back FROM (SELECT DISTINCT sample_id, history_aids FROM validation_samples)) GROUP BY ALL")
def pair_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.pair_features(_samples(spark, folder))


_ITEMS = f"cat AS (SELECT itemid AS aid, max(struct_pack(t := timestamp, c := categoryid)).c AS categoryid FROM item_category_changes WHERE itemid IS NOT NULL AND timestamp < 1686000000000 GROUP BY itemid), fs AS (SELECT aid, min(ts) AS first_seen_ts FROM events_all WHERE aid IS NOT NULL GROUP BY aid), items AS (SELECT coalesce(cat.aid, fs.aid) AS aid, categoryid, first_seen_ts FROM cat FULL JOIN fs ON cat.aid = fs.aid)"


@query(f"""WITH cand AS (SELECT DISTINCT c.sample_id, c.aid, CAST(c.aid = s.target_aid AS INT) AS label FROM candidate_features c JOIN (SELECT DISTINCT sample_id, target_aid FROM validation_samples) s USING (sample_id)), {_ITEMS},
 smp AS (SELECT DISTINCT sample_id, target_ts, target_aid, target_type, history_aids[-1] AS last_aid FROM validation_samples), ok AS (SELECT smp.*, coalesce(i.categoryid, -1) AS last_categoryid FROM smp JOIN items f ON f.aid = target_aid AND f.first_seen_ts < target_ts LEFT JOIN items i ON i.aid = last_aid),
 pr AS (SELECT sample_id, aid, count(*) AS n, min(back) AS r FROM (SELECT sample_id, unnest(list_reverse(history_aids)) AS aid, unnest(range(1, len(history_aids) + 1)) AS back FROM (SELECT DISTINCT sample_id, history_aids FROM validation_samples)) GROUP BY ALL)
 SELECT c.sample_id, c.aid, label, CAST(c.aid = last_aid AS INT) AS candidate_is_last, CAST(n IS NOT NULL AS INT) AS candidate_in_history, coalesce(n, 0) AS history_candidate_count, coalesce(r, 0) AS history_candidate_recency, CAST(coalesce(i.categoryid, -1) = last_categoryid AND coalesce(i.categoryid, -1) <> -1 AS INT) AS same_category_as_last, label AS label_clicks, CASE WHEN target_type IN ('carts', 'orders') THEN label ELSE 0 END AS label_carts, CASE WHEN target_type = 'orders' THEN label ELSE 0 END AS label_orders
 FROM cand c JOIN ok USING (sample_id) LEFT JOIN pr USING (sample_id, aid) LEFT JOIN items i ON i.aid = c.aid""")
def enriched_candidates(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.operators.asof import first_seen, latest_state

    samples = _samples(spark, folder)
    cand = spark.read.parquet(f"{folder}/candidate_features.parquet").select("sample_id", "aid").distinct().join(samples.select("sample_id", "target_aid"), "sample_id")
    cand = cand.select("sample_id", "aid", (F.col("aid") == F.col("target_aid")).cast("int").alias("label"))
    cat = latest_state(spark.read.parquet(f"{folder}/item_category_changes.parquet"), 1_686_000_000_000, "categoryid").select(F.col("itemid").alias("aid"), "categoryid")
    seen = first_seen(spark.read.parquet(f"{folder}/events_all.parquet").filter("aid IS NOT NULL"))
    rows = features.enrich(cand, features.session_features(samples), features.pair_features(samples), cat.join(seen, "aid", "full_outer"), [], training=True)
    return rows.select("sample_id", "aid", "label", "candidate_is_last", "candidate_in_history", "history_candidate_count", "history_candidate_recency", "same_category_as_last", "label_clicks", "label_carts", "label_orders")


_FIN = "CASE WHEN final_score IS NULL OR NOT isfinite(final_score) THEN 0 ELSE final_score END"


@query(f"SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(source_rank), 6) AS mean_source_rank, round(stddev_pop(source_rank), 6) AS std_source_rank, round(avg({_FIN}), 6) AS mean_final_score, round(stddev_pop({_FIN}), 6) AS std_final_score, round(least(50.0, sqrt((count(*) - sum(label)) / greatest(sum(label), 1))), 6) AS pos_weight FROM candidate_features")
def feature_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.moments(clean.finite(spark.read.parquet(f"{folder}/candidate_features.parquet"), "final_score"), ["source_rank", "final_score"]))


@query(f"{with_sql('beh')}, {_STATS.format('beh')}, m AS (SELECT avg(ln(1 + item_events)) AS a, stddev_pop(ln(1 + item_events)) AS b, avg(item_sessions) AS c, stddev_pop(item_sessions) AS d FROM stats) SELECT aid, round((ln(1 + item_events) - a) / b, 6) AS item_events, round((item_sessions - c) / d, 6) AS item_sessions FROM stats, m")
def zscore_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.item_statistics(behaviour(spark, folder)).select("aid", "item_events", "item_sessions")
    return rounded(features.standardise(rows, ["item_events", "item_sessions"], ["item_events"]))


@query("WITH v AS (SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM candidate_features WHERE source <> 'recent')) SELECT sample_id, aid, source, coalesce(i, 0) AS source_index, count(*) AS n FROM candidate_features LEFT JOIN v USING (source) GROUP BY ALL")
def vocabulary_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/candidate_features.parquet")
    coded = features.encode(rows, "source", features.vocabulary(rows.filter("source <> 'recent'"), "source"), "source_index")
    return coded.groupBy("sample_id", "aid", "source", "source_index").agg(F.count(F.lit(1)).alias("n"))


_GRID = ", ".join(f"CAST(sum(CASE WHEN type = '{a}' AND ts >= {CUTOFF_MS - d * 86_400_000} THEN 1 ELSE 0 END) AS BIGINT) AS {a}_{d}d" for a in ("clicks", "carts", "orders") for d in (1, 7, 30))


@query(f"{with_sql('beh')} SELECT aid, {_GRID}, count(DISTINCT CASE WHEN ts >= {CUTOFF_MS - 30 * 86_400_000} THEN session END) AS sessions_30d, round(({CUTOFF_MS} - min(ts)) / 86400000.0, 6) AS age_first_days, round(({CUTOFF_MS} - max(ts)) / 86400000.0, 6) AS age_last_days FROM beh WHERE ts < {CUTOFF_MS} GROUP BY aid")
def item_action_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features.action_grid(behaviour(spark, folder), CUTOFF_MS))


@query("SELECT sample_id, string_agg((least(31, floor(log2(greatest(floor(d / 1000), 0) + 1)))::BIGINT + 1)::VARCHAR, ',' ORDER BY i) AS buckets FROM (SELECT sample_id, unnest(history_time_deltas_ms) AS d, unnest(range(len(history_time_deltas_ms))) AS i FROM (SELECT DISTINCT sample_id, history_time_deltas_ms FROM validation_samples)) GROUP BY sample_id")
def time_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return texts(_samples(spark, folder).select("sample_id", F.transform("history_time_deltas_ms", features.time_bucket).alias("buckets")), "buckets")


@query("""WITH RECURSIVE walk AS (SELECT categoryid, parentid, [categoryid] AS path FROM category_tree UNION ALL SELECT w.categoryid, t.parentid, list_prepend(t.categoryid, w.path) FROM walk w JOIN category_tree t ON w.parentid = t.categoryid),
 paths AS (SELECT categoryid, arg_max(path, len(path)) AS path FROM walk GROUP BY categoryid), item AS (SELECT itemid, path FROM (SELECT itemid, max(struct_pack(t := timestamp, c := categoryid)).c AS c FROM item_category_changes WHERE itemid IS NOT NULL AND timestamp < 1690000000000 GROUP BY itemid) JOIN paths ON c = categoryid),
 s AS (SELECT DISTINCT sample_id, target_aid, history_aids FROM validation_samples), h AS (SELECT sample_id, unnest(history_aids) AS aid FROM s), f AS (SELECT s.sample_id, t.path AS tp, i.path AS hp FROM s JOIN item t ON t.itemid = target_aid JOIN h ON h.sample_id = s.sample_id JOIN item i ON i.itemid = h.aid)
 SELECT sample_id, CASE WHEN bool_or(hp[-1] = tp[-1]) THEN 'exact' WHEN bool_or(len(hp) >= 2 AND len(tp) >= 2 AND hp[-2] = tp[-2]) THEN 'same_parent' WHEN bool_or(hp[1] = tp[1]) THEN 'same_root' ELSE 'other' END AS relation FROM f GROUP BY sample_id""")
def category_relations(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.operators.asof import category_paths, latest_state

    changes = spark.read.parquet(f"{folder}/item_category_changes.parquet")
    tree = spark.read.parquet(f"{folder}/category_tree.parquet")
    paths = category_paths(spark, tree, tree.select("categoryid")).select("categoryid", "category_path")
    item = latest_state(changes, 1_690_000_000_000, "categoryid").join(F.broadcast(paths), "categoryid").select("itemid", "category_path")
    samples = _samples(spark, folder).select("sample_id", "target_aid", "history_aids")
    past = samples.select("sample_id", F.explode("history_aids").alias("itemid")).join(item, "itemid").groupBy("sample_id").agg(F.collect_list("category_path").alias("paths"))
    own = samples.select("sample_id", F.col("target_aid").alias("itemid")).join(item, "itemid")
    return own.join(past, "sample_id").select("sample_id", features.category_relation("paths", "category_path").alias("relation"))


# Metrics. Scored lists: each item of a sample once, at its highest score.
_SCORED = "scored AS (SELECT c.sample_id, aid, any_value(target_type) AS target_type, max(CAST(aid = target_aid AS INT)) AS label, max(final_score) AS final_score FROM candidate_features c JOIN (SELECT DISTINCT sample_id, target_aid FROM validation_samples) s ON s.sample_id = c.sample_id WHERE isfinite(final_score) GROUP BY ALL)"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Each valid item of each sample once, with its label."""
    rows = spark.read.parquet(f"{folder}/candidate_features.parquet")
    rows = rows.filter(F.col("final_score").isNotNull() & ~F.isnan("final_score") & (F.abs("final_score") != float("inf")))
    target = _samples(spark, folder).select("sample_id", "target_aid")
    return rows.join(target, "sample_id").groupBy("sample_id", "aid").agg(F.first("target_type").alias("target_type"), F.max((F.col("aid") == F.col("target_aid")).cast("int")).alias("label"), F.max("final_score").alias("final_score"))


_HITS = "SELECT l.*, CASE WHEN h.session IS NULL THEN 0 ELSE 1 END AS hit FROM lab l LEFT JOIN ({}) h ON h.session = l.session AND h.aid = l.target_aid"


def _actions(prefix: str, total: str, hits: str) -> str:
    parts = {a: f"coalesce(avg(CASE WHEN target_type = '{a}' THEN hit::DOUBLE END), 0)" for a in ("clicks", "carts", "orders")}
    return ", ".join(f"round({v}, 6) AS {prefix}{a}" for a, v in parts.items()) + f", round(0.1 * {parts['clicks']} + 0.3 * {parts['carts']} + 0.6 * {parts['orders']}, 6) AS {total}"


_SUMM = "summ AS (SELECT session, aid, sum(1.0 / (60.0 + source_rank)) AS score FROM cand GROUP BY ALL)"


@query(f"WITH {CAND_SQL}, {_SUMM} SELECT {_actions('recall_', 'weighted_recall', '')} FROM ({_HITS.format('SELECT session, aid FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(score, 9) DESC, aid) AS r FROM summ) WHERE r <= 20')})")
def recall_at_20(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.rrf_summary(candidates(spark, folder)).withColumnRenamed("rrf_score", "score")
    return rounded(metrics.recall_at(rows, labels(spark, folder), 20))


@query(f"WITH {CAND_SQL}, hits AS ({_HITS.format('SELECT DISTINCT session, aid FROM cand')}) SELECT {_actions('candidate_recall_', 'weighted_candidate_recall', '')}, round(avg(hit), 6) AS candidate_recall FROM hits")
def candidate_recall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.candidate_recall(candidates(spark, folder), labels(spark, folder)))


@query(f"WITH {CAND_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, session ORDER BY source_rank, aid) AS r FROM cand) WHERE r <= 20) SELECT source, round(count(DISTINCT CASE WHEN target_aid IS NOT NULL THEN b.session END) / (SELECT count(*) FROM lab), 6) AS recall FROM (SELECT DISTINCT source FROM cand) LEFT JOIN best b USING (source) LEFT JOIN lab ON lab.session = b.session AND lab.target_aid = b.aid GROUP BY source")
def source_recall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.source_recall(candidates(spark, folder), labels(spark, folder), 20))


_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY final_score DESC, aid) AS r FROM scored), placed AS (SELECT sample_id, r, final_score AS ps FROM ranked WHERE label = 1),
 auc AS (SELECT sample_id, sum(CASE WHEN ps > final_score THEN 1.0 WHEN ps = final_score THEN 0.5 ELSE 0 END) AS w, count(*) AS n FROM ranked JOIN (SELECT sample_id, ps FROM placed) USING (sample_id) WHERE label = 0 GROUP BY sample_id),
 per AS (SELECT s.sample_id, s.target_type, p.r, CASE WHEN p.r <= 20 THEN 1.0 ELSE 0 END::DOUBLE AS hit, CASE WHEN p.r <= 20 THEN 1.0 / p.r ELSE 0 END::DOUBLE AS mrr, CASE WHEN p.r <= 20 THEN 1.0 / log2(p.r + 1.0) ELSE 0 END::DOUBLE AS ndcg, CASE s.target_type WHEN 'clicks' THEN 0.1 WHEN 'carts' THEN 0.3 ELSE 0.6 END::DOUBLE AS wt, w, n FROM (SELECT sample_id, any_value(target_type) AS target_type FROM scored GROUP BY sample_id) s LEFT JOIN placed p USING (sample_id) LEFT JOIN auc USING (sample_id))"""
_ACT = {a: f"coalesce(avg(CASE WHEN target_type = '{a}' THEN hit END), 0)" for a in ("clicks", "carts", "orders")}


_TOPLIST = f"""SELECT count(*) AS samples, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS candidate_recall, round(avg(hit), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(sum(hit * wt) / sum(wt), 6) AS event_weighted_hit_rate, round(sum(mrr * wt) / sum(wt), 6) AS event_weighted_mrr, round(sum(ndcg * wt) / sum(wt), 6) AS event_weighted_ndcg,
 {', '.join(f'round({v}, 6) AS {a}_hit_rate' for a, v in _ACT.items())}, round(sum(w) / sum(n), 6) AS conditional_auc, round(avg(w / n), 6) AS conditional_gauc, count(w) AS auc_samples, round(avg(coalesce(w / n, 0)), 6) AS end_to_end_gauc, round(sum(coalesce(w / n, 0) * wt) / sum(wt), 6) AS event_weighted_end_to_end_gauc, round(0.1 * {_ACT['clicks']} + 0.3 * {_ACT['carts']} + 0.6 * {_ACT['orders']}, 6) AS macro_weighted_hit_rate FROM per"""


@query(f"WITH {_SCORED}, {_RANKED} {_TOPLIST}")
def toplist_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.toplist(scored(spark, folder), 20))


_USERS = "users AS (SELECT session, min(visitorid) AS visitorid FROM events_all WHERE session IS NOT NULL GROUP BY session), su AS (SELECT DISTINCT sample_id, visitorid FROM validation_samples JOIN users USING (session))"


def _with_users(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    users = spark.read.parquet(f"{folder}/events_all.parquet").filter("session IS NOT NULL").groupBy("session").agg(F.min("visitorid").alias("visitorid"))
    own = _samples(spark, folder).select("sample_id", "session").join(users, "session").select("sample_id", "visitorid")
    return rows.join(own, "sample_id")


_UAUC = """z AS (SELECT visitorid, label, rank() OVER (PARTITION BY visitorid ORDER BY final_score) + (count(*) OVER (PARTITION BY visitorid, final_score) - 1) / 2.0 AS rk FROM x), u AS (SELECT visitorid, sum(label)::DOUBLE AS p, count(*) - sum(label)::DOUBLE AS n, sum(CASE WHEN label = 1 THEN rk END) AS s FROM z GROUP BY visitorid), v AS (SELECT (s - p * (p + 1) / 2.0) / (p * n) AS auc, p * n AS pairs FROM u WHERE p > 0 AND n > 0)
 SELECT round(avg(auc), 6) AS uauc, round(sum(auc * pairs) / sum(pairs), 6) AS weighted_uauc, count(*) AS eligible_users FROM v"""


@query(f"WITH {_SCORED}, {_USERS}, x AS (SELECT visitorid, label, final_score FROM scored JOIN su USING (sample_id) WHERE sample_id IN (SELECT sample_id FROM scored WHERE label = 1)), {_UAUC}")
def uauc(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    kept = rows.join(rows.filter("label = 1").select("sample_id"), "sample_id", "left_semi")
    return rounded(metrics.uauc(_with_users(spark, folder, kept)))


@query(f"WITH {_SCORED}, {_USERS}, ee AS (SELECT sample_id, label, final_score FROM scored UNION ALL SELECT sample_id, 1, '-inf'::DOUBLE FROM scored GROUP BY sample_id HAVING max(label) = 0), x AS (SELECT visitorid, label, final_score FROM ee JOIN su USING (sample_id)), {_UAUC}")
def uauc_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.uauc(_with_users(spark, folder, metrics.end_to_end(scored(spark, folder)))))


@query(f"WITH {_SCORED}, {_RANKED} SELECT k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN r <= k THEN 1.0 / log2(r + 1.0) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN r <= k THEN 1.0 / r ELSE 0 END), 6) AS mrr FROM per, (SELECT unnest([5, 10, 20, 50])::INT AS k) GROUP BY k")
def list_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.list_metrics(metrics.positive_ranks(scored(spark, folder)), [5, 10, 20, 50]))


@query(f"WITH {_SCORED}, {_RANKED} SELECT sample_id, coalesce(r, 0) AS rank FROM per")
def counted_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.positive_ranks(scored(spark, folder)).select("sample_id", F.coalesce("rank", F.lit(0)).alias("rank"))


@query(f"WITH {_SCORED}, {_RANKED} SELECT round(sum(w) / sum(n), 6) AS auc, round(avg(w / n), 6) AS uauc FROM auc")
def single_positive_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.single_positive_auc(scored(spark, folder)))


@query("""WITH pl AS (SELECT aid, row_number() OVER (ORDER BY count(*) DESC, aid) AS place FROM events_all WHERE aid IS NOT NULL GROUP BY aid), s AS (SELECT DISTINCT sample_id, target_aid, history_aids FROM validation_samples),
 h AS (SELECT DISTINCT sample_id, target_aid, unnest(history_aids) AS aid FROM s), b AS (SELECT h.sample_id, count(*) AS c FROM h JOIN pl t ON t.aid = target_aid JOIN pl p ON p.aid = h.aid WHERE h.aid <> target_aid AND p.place < t.place GROUP BY h.sample_id), r AS (SELECT s.sample_id, t.place - coalesce(c, 0) AS rank FROM s LEFT JOIN pl t ON t.aid = target_aid LEFT JOIN b USING (sample_id))
 SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN rank <= k THEN 1.0 / log2(rank + 1.0) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN rank <= k THEN 1.0 / rank ELSE 0 END), 6) AS mrr FROM r, (SELECT unnest([20, 200])::INT AS k) GROUP BY k""")
def popularity_eval(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events_all.parquet").filter("aid IS NOT NULL").select(F.col("aid").alias("item"))
    samples = _samples(spark, folder).select("sample_id", F.col("target_aid").alias("target"), F.col("history_aids").alias("history"))
    return rounded(metrics.list_metrics(metrics.popularity_ranks(samples, events), [20, 200]))


_PROB = "SELECT sample_id, aid, 1 / (1 + exp(-s)) AS p_click, 1 / (1 + exp(-(s - 0.002 * (aid % 7) + 0.005))) AS p_cart, 1 / (1 + exp(-(s - 0.01))) AS p_order FROM (SELECT sample_id, aid, final_score AS s FROM scored)"


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Three action probabilities made from the scores."""
    s = F.col("final_score")
    sigmoid = lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return scored(spark, folder).select("sample_id", "aid", "label", "target_type", sigmoid(s).alias("p_click"), sigmoid(s - F.lit(0.002) * (F.col("aid") % 7) + F.lit(0.005)).alias("p_cart"), sigmoid(s - F.lit(0.01)).alias("p_order"))


@query(f"WITH {_SCORED}, p AS ({_PROB}), b AS (SELECT sample_id, CASE WHEN p_click < p_cart OR p_cart < p_order THEN 1 ELSE 0 END AS bad FROM p) SELECT round(avg(bad), 6) AS candidate_violation_rate, (SELECT round(avg(m), 6) FROM (SELECT max(bad)::DOUBLE AS m FROM b GROUP BY sample_id)) AS session_violation_rate FROM b")
def ordinal_violations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ordinal_violations(probabilities(spark, folder)))


@query(f"WITH {_SCORED}, p AS ({_PROB}) SELECT sample_id, aid, round(0.05 * p_click + 0.30 * p_cart + 0.40 * p_order, 6) AS score FROM p")
def probability_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(probabilities(spark, folder).select("sample_id", "aid", fusion.probability_fusion().alias("score")))


_CLIP = "greatest(1e-6, least(1 - 1e-6, {}))"
_LOGIT = {c: f"ln({_CLIP.format(c)} / (1 - {_CLIP.format(c)}))" for c in ("p_click", "p_cart", "p_order")}
_SOFT = "ln(1 + exp({}))"


@query(f"WITH {_SCORED}, p AS ({_PROB}) SELECT sample_id, aid, round(1 / (1 + exp(-(({_SOFT.format('0.5')}) * {_LOGIT['p_click']} + ({_SOFT.format('1.0')}) * {_LOGIT['p_cart']} + ({_SOFT.format('-1.0')}) * {_LOGIT['p_order']}) / ({_SOFT.format('0.5')} + {_SOFT.format('1.0')} + {_SOFT.format('-1.0')}))), 6) AS fused, round(1 / (1 + exp(-(exp(0.1 + 2 * p_click) * {_LOGIT['p_click']} + exp(-1 * p_click) * {_LOGIT['p_order']}) / (exp(0.1 + 2 * p_click) + exp(-1 * p_click)))), 6) AS gated FROM p")
def fusion_heads(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.operators import models

    rows = probabilities(spark, folder)
    static = models.static_fusion(["p_click", "p_cart", "p_order"], [0.5, 1.0, -1.0])
    gated = models.gated_fusion(["p_click", "p_order"], ["p_click"], [[2.0], [-1.0]], [0.1, 0.0])
    return rounded(rows.select("sample_id", "aid", static.alias("fused"), gated.alias("gated")))


_OPTIONS = [(0.05, 0.30, 0.40), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)]
_GRID_SQL = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS option, sample_id, aid, label, round({a} * p_click + {b} * p_cart + {c} * p_order, 9) AS s FROM pl" for i, (a, b, c) in enumerate(_OPTIONS))


@query(f"WITH {_SCORED}, p AS ({_PROB}), pl AS (SELECT p.*, label FROM p JOIN scored USING (sample_id, aid)), g AS ({_GRID_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY option, sample_id ORDER BY s DESC, aid) AS r FROM g), h AS (SELECT option, sample_id, max(CASE WHEN label = 1 AND r <= 20 THEN 1.0 ELSE 0 END) AS hit FROM r GROUP BY ALL), o AS (SELECT option, avg(CASE WHEN sample_id % 2 = 0 THEN hit END) AS a, avg(CASE WHEN sample_id % 2 = 1 THEN hit END) AS b FROM h GROUP BY option) SELECT option, round(a, 6) AS first_hit_rate, round(b, 6) AS held_out_hit_rate, row_number() OVER (ORDER BY round(a, 9) DESC, option) = 1 AS chosen FROM o")
def fusion_grid(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.grid_search(probabilities(spark, folder), ["p_click", "p_cart", "p_order"], _OPTIONS, F.col("sample_id") % 2 == 0))


@query(f"SELECT sample_id, aid, source, 125.0::DOUBLE AS source_rank, {_FIN} AS final_score FROM candidate_features")
def masked_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.finite(spark.read.parquet(f"{folder}/candidate_features.parquet"), "final_score")
    return clean.mask_columns(rows, {"source_rank": 125.0}).select("sample_id", "aid", "source", "source_rank", "final_score")


# Diagnosis.
_HIT = "hit AS (SELECT DISTINCT c.session, c.source FROM cand c JOIN lab l ON l.session = c.session AND l.target_aid = c.aid), one AS (SELECT session, count(*) AS k, min(source) AS solo FROM hit GROUP BY session)"


@query(f"WITH {CAND_SQL}, {_HIT}, n AS (SELECT count(*)::DOUBLE AS n FROM lab), u AS (SELECT count(*) AS u FROM one) SELECT source, round((SELECT count(*) FROM hit h WHERE h.source = s.source) / n, 6) AS recall, (SELECT count(*) FROM one WHERE k = 1 AND solo = s.source) AS exclusive_hits, round((SELECT count(*) FROM one WHERE k = 1 AND solo = s.source) / n, 6) AS leave_one_out_recall_drop, round(u / n, 6) AS union_recall FROM (SELECT DISTINCT source FROM cand) s, n, u")
def route_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.route_diagnostics(candidates(spark, folder), labels(spark, folder)))


@query(f"WITH {CAND_SQL}, d AS (SELECT DISTINCT session, aid, source FROM cand), c AS (SELECT source, count(*) AS n FROM d GROUP BY source), x AS (SELECT a.source AS l, b.source AS r, count(*) AS i FROM d a JOIN d b ON a.session = b.session AND a.aid = b.aid AND a.source < b.source GROUP BY ALL) SELECT a.source AS left, b.source AS right, round(coalesce(i, 0) / (a.n + b.n - coalesce(i, 0)), 6) AS jaccard FROM c a JOIN c b ON a.source < b.source LEFT JOIN x ON l = a.source AND r = b.source")
def pairwise_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.pairwise_jaccard(candidates(spark, folder), ROUTE_NAMES))


@query(f"WITH {CAND_SQL}, b AS (SELECT source, c.session, max(source_score) AS s FROM cand c JOIN lab l ON l.session = c.session AND l.target_aid = c.aid GROUP BY ALL), p AS (SELECT c.source, c.session, sum(CASE WHEN s > source_score THEN 1.0 WHEN s = source_score THEN 0.5 ELSE 0 END) AS w, count(*) AS n FROM cand c JOIN b ON b.source = c.source AND b.session = c.session JOIN lab l ON l.session = c.session WHERE c.aid <> l.target_aid GROUP BY ALL) SELECT source, round(sum(w) / sum(n), 6) AS candidate_auc, round(avg(w / n), 6) AS session_gauc, count(*) AS eligible_sessions FROM p GROUP BY source")
def auc_gauc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.auc_gauc(candidates(spark, folder), labels(spark, folder)))


@query(f"""WITH {CAND_SQL}, {_HISTORY}, sz AS (SELECT source, count(*) AS covered_sessions, round(avg(c), 6) AS mean_candidates FROM (SELECT source, session, count(*) AS c FROM cand GROUP BY ALL) GROUP BY source), hs AS (SELECT DISTINCT session, aid FROM history),
 h AS (SELECT source, c.session, c.aid, min(source_rank) AS rank FROM cand c JOIN lab l ON l.session = c.session AND l.target_aid = c.aid GROUP BY ALL), f AS (SELECT source, count(*) AS h, sum(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) AS hk, quantile_cont(rank, 0.5) AS md, sum(1.0 / rank) AS rr, sum(CASE WHEN hs.session IS NULL THEN 1 ELSE 0 END)::BIGINT AS nv FROM h LEFT JOIN hs ON hs.session = h.session AND hs.aid = h.aid GROUP BY source), n AS (SELECT count(*) AS n FROM lab)
 SELECT source, covered_sessions, mean_candidates, round(coalesce(hk, 0) / n, 6) AS recall_at_k, round(coalesce(h, 0) / n, 6) AS recall_full, round(md, 6) AS rank_median, round(coalesce(rr, 0) / n, 6) AS mrr_full, coalesce(nv, 0) AS novel_hits FROM sz LEFT JOIN f USING (source), n""")
def route_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.route_summary(candidates(spark, folder), labels(spark, folder), history(spark, folder), 20))


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    samples = _samples(spark, folder)
    found = candidates(spark, folder).select("session", F.col("aid").alias("target_aid")).distinct().withColumn("hit", F.lit(1))
    n = F.col("history_length_full")
    length = F.when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise("over 10")
    novel = F.when(F.array_contains("history_aids", F.col("target_aid")), "repeat").otherwise("novel")
    return samples.join(found, ["session", "target_aid"], "left").fillna(0, ["hit"]).select("hit", F.col("target_type").alias("action"), length.alias("length"), novel.alias("novelty"))


@query(f"""WITH {CAND_SQL}, s AS (SELECT DISTINCT sample_id, session, target_aid, target_type AS action, CASE WHEN history_length_full <= 3 THEN '2-3' WHEN history_length_full <= 6 THEN '4-6' WHEN history_length_full <= 10 THEN '7-10' ELSE 'over 10' END AS length, CASE WHEN list_contains(history_aids, target_aid) THEN 'repeat' ELSE 'novel' END AS novelty FROM validation_samples),
 h AS (SELECT s.*, CASE WHEN c.session IS NULL THEN 0 ELSE 1 END AS hit FROM s LEFT JOIN (SELECT DISTINCT session, aid FROM cand) c ON c.session = s.session AND c.aid = s.target_aid)
 SELECT CASE WHEN grouping(action) = 0 THEN 'action' WHEN grouping(length) = 0 THEN 'length' ELSE 'novelty' END AS segment, coalesce(action, length, novelty) AS value, count(*) AS samples, CAST(sum(1 - hit) AS BIGINT) AS misses, round(avg(hit), 6) AS recall FROM h GROUP BY GROUPING SETS ((action), (length), (novelty))""")
def miss_segments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.miss_segments(_segmented(spark, folder), ["action", "length", "novelty"]))


def _variant_sql(name: str, where: str) -> str:
    return f"SELECT '{name}' AS variant, round(avg(own), 6) AS recall, round(avg(CASE WHEN seen = 0 THEN own END), 6) AS novel_recall, CAST(sum(own * (1 - base)) AS BIGINT) AS exclusive_hits, round(avg(greatest(own, base)), 6) AS union_recall, round(avg(own * (1 - base)), 6) AS union_lift FROM (SELECT l.session, CASE WHEN b.session IS NULL THEN 0 ELSE 1 END AS base, CASE WHEN o.session IS NULL THEN 0 ELSE 1 END AS own, CASE WHEN h.session IS NULL THEN 0 ELSE 1 END AS seen FROM lab l LEFT JOIN (SELECT DISTINCT session, aid FROM cand WHERE source = 'recent') b ON b.session = l.session AND b.aid = l.target_aid LEFT JOIN (SELECT DISTINCT session, aid FROM cand WHERE {where}) o ON o.session = l.session AND o.aid = l.target_aid LEFT JOIN (SELECT DISTINCT session, aid FROM history) h ON h.session = l.session AND h.aid = l.target_aid)"


@query(f"WITH {CAND_SQL}, {_HISTORY} {_variant_sql('itemcf', 'source = ' + chr(39) + 'itemcf' + chr(39))} UNION ALL {_variant_sql('top_50', 'source_rank <= 50')}")
def compare_variants(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    variants = {"itemcf": rows.filter("source = 'itemcf'"), "top_50": rows.filter("source_rank <= 50")}
    return rounded(diagnostics.compare_variants(variants, rows.filter("source = 'recent'"), labels(spark, folder), history(spark, folder)))


@query(f"WITH {CAND_SQL}, c AS (SELECT session, count(DISTINCT aid) AS n FROM cand GROUP BY session) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max FROM c")
def pool_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.pool_sizes(candidates(spark, folder)))


_QS = [0.2 + 0.8 * i / 4 for i in range(5)]


@query("WITH s AS (SELECT DISTINCT sample_id, target_ts FROM validation_samples), b AS (SELECT " + ", ".join(f"CAST(floor(quantile_cont(target_ts::DOUBLE, {q})) AS BIGINT) AS b{i}" for i, q in enumerate(_QS)) + " FROM s) " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS fold, b{i} AS start_ts, b{i + 1}{' + 1' if i == 3 else ''} AS end_ts FROM b" for i in range(4)))
def temporal_folds(spark: SparkSession, folder: str) -> DataFrame:
    return diagnostics.temporal_folds(spark, _samples(spark, folder), 4, 0.2)


QUERIES, ORACLES = query.queries, query.oracles
