"""Queries over cleaning, sessions, labels, state and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.adapters import CUTOFF_MS, DAY_MS, HOUR_MS, SESSION_GAP_MS, basket, behaviour, feedback, ratings, raw_behaviour, state, tree, with_sql
from tideline.operators import asof, clean, sequences, sessions
from tideline.plans.registry import Registry

query = Registry()
EVENT_COLUMNS = ["session", "aid", "ts", "type", "event_order"]
_EVENTS = ", ".join(EVENT_COLUMNS)


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as comma-separated text."""
    return df.withColumns({c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in columns})


@query(f"{with_sql('raw')} SELECT visitorid, itemid, timestamp, event_order, CASE event WHEN 'view' THEN 'clicks' WHEN 'addtocart' THEN 'carts' WHEN 'transaction' THEN 'orders' END AS type FROM raw WHERE event IN ('view', 'addtocart', 'transaction')")
def map_types(spark: SparkSession, folder: str) -> DataFrame:
    return clean.map_types(raw_behaviour(spark, folder)).select("visitorid", "itemid", "timestamp", "event_order", "type")


@query("SELECT coalesce(session, -1) AS session, visitorid, coalesce(aid, -1) AS aid, ts, type, transactionid, min(event_order) AS event_order FROM events_all GROUP BY session, visitorid, aid, ts, type, transactionid")
def drop_copies(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events_all.parquet")
    return clean.drop_copies(events, ["session", "visitorid", "aid", "ts", "type", "transactionid"], "event_order").fillna(-1, ["session", "aid"])


@query("""WITH one AS (SELECT itemid, timestamp, min(categoryid) AS categoryid FROM item_category_changes WHERE itemid IS NOT NULL AND timestamp IS NOT NULL AND categoryid IS NOT NULL GROUP BY ALL HAVING min(categoryid) = max(categoryid)),
 seq AS (SELECT *, lag(categoryid) OVER (PARTITION BY itemid ORDER BY timestamp) AS before FROM one) SELECT itemid, timestamp, categoryid FROM seq WHERE categoryid IS DISTINCT FROM before""")
def clean_changes(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_changes(spark.read.parquet(f"{folder}/item_category_changes.parquet"))


@query(f"{with_sql('basket')} SELECT {_EVENTS} FROM basket WHERE session NOT IN (SELECT session FROM (SELECT session, ts, count(*) AS n, max(ts) OVER (PARTITION BY session) AS m FROM basket GROUP BY session, ts) WHERE ts = m AND n > 1)")
def drop_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_ambiguous(basket(spark, folder)).select(*EVENT_COLUMNS)


_TOP50 = "SELECT aid FROM basket GROUP BY aid ORDER BY count(*) DESC, aid LIMIT 50"


@query(f"{with_sql('basket')} SELECT {_EVENTS} FROM basket WHERE aid IN ({_TOP50})")
def restrict_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return clean.restrict_catalogue(basket(spark, folder), 50).select(*EVENT_COLUMNS)


@query(f"{with_sql('beh')} SELECT {_EVENTS} FROM beh WHERE session IN (SELECT session FROM beh GROUP BY session HAVING count(*) >= 3)")
def min_session_length(spark: SparkSession, folder: str) -> DataFrame:
    return clean.min_session_length(behaviour(spark, folder), 3).select(*EVENT_COLUMNS)


@query(f"{with_sql('beh')} SELECT {_EVENTS} FROM beh WHERE session IN (SELECT session FROM beh GROUP BY session ORDER BY min(ts), session LIMIT 200)")
def earliest_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return clean.earliest_sessions(behaviour(spark, folder), 200).select(*EVENT_COLUMNS)


@query(f"""{with_sql('basket')}, starts AS (SELECT session, min(ts) AS start FROM basket GROUP BY session), cut AS (SELECT * FROM basket WHERE aid IN (SELECT aid FROM basket GROUP BY aid ORDER BY count(*) DESC, aid LIMIT 500)),
 long AS (SELECT * FROM cut WHERE session IN (SELECT session FROM cut GROUP BY session HAVING count(*) >= 2)),
 tied AS (SELECT session FROM (SELECT session, ts, count(*) AS n, max(ts) OVER (PARTITION BY session) AS m FROM long GROUP BY session, ts) WHERE ts = m AND n > 1),
 clear AS (SELECT * FROM long WHERE session NOT IN (SELECT session FROM tied)) SELECT {_EVENTS} FROM clear WHERE session IN (SELECT session FROM starts WHERE session IN (SELECT session FROM clear) ORDER BY start, session LIMIT 100)""")
def prepare_events(spark: SparkSession, folder: str) -> DataFrame:
    return clean.prepare_events(basket(spark, folder), 500, 100, 2).select(*EVENT_COLUMNS)


def _core_sql(rounds: int, source: str, user: str, item: str, a: int, b: int) -> str:
    parts, last = [], source
    for i in range(rounds):
        parts.append(f"u{i} AS (SELECT * FROM {last} WHERE {user} IN (SELECT {user} FROM {last} GROUP BY {user} HAVING count(*) >= {a}))")
        parts.append(f"i{i} AS (SELECT * FROM u{i} WHERE {item} IN (SELECT {item} FROM u{i} GROUP BY {item} HAVING count(*) >= {b}))")
        last = f"i{i}"
    return ", ".join(parts)


_POSITIVE = "positive AS (SELECT * FROM ratings WHERE rating >= 4.0)"


@query(f"{with_sql('ratings')}, {_POSITIVE}, {_core_sql(14, 'positive', 'user_id', 'item_id', 4, 4)} SELECT user_id, item_id, timestamp, rating FROM i13")
def k_core(spark: SparkSession, folder: str) -> DataFrame:
    return clean.k_core(ratings(spark, folder).filter("rating >= 4.0"), "user_id", "item_id", 4, 4)


@query(f"{with_sql('ratings')}, topi AS (SELECT * FROM ratings WHERE item_id IN (SELECT item_id FROM ratings GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 300)), topu AS (SELECT * FROM topi WHERE user_id IN (SELECT user_id FROM topi GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 200)), {_core_sql(14, 'topu', 'user_id', 'item_id', 5, 5)} SELECT user_id, item_id, timestamp, rating FROM i13")
def limit_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return clean.limit_catalogue(ratings(spark, folder), "user_id", "item_id", 300, 200, 5, 5)


@query(f"{with_sql('ratings')}, {_POSITIVE}, {_core_sql(14, 'positive', 'user_id', 'item_id', 4, 4)} SELECT user_id, item_id, timestamp, rating, CAST(rating >= 4.0 AS INT) AS is_positive FROM ratings WHERE user_id IN (SELECT user_id FROM i13) AND item_id IN (SELECT item_id FROM i13)")
def label_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return clean.label_feedback(ratings(spark, folder), F.col("rating") >= 4.0, "user_id", "item_id", 4, 4)


@query(f"{with_sql('feedback')} SELECT f.user_id, item_id, timestamp FROM feedback f JOIN events e ON event_id = event_order WHERE value >= 20 AND is_positive >= 1")
def threshold_events(spark: SparkSession, folder: str) -> DataFrame:
    values = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_id").alias("event_order"), "value")
    return clean.threshold_events(feedback(spark, folder).join(values, "event_order"), "value", 20, "is_positive", 1).select("user_id", "item_id", "timestamp")


@query(f"""{with_sql('beh')}, ends AS (SELECT session, min(ts) AS a, max(ts) AS b FROM beh GROUP BY session),
 parts AS (SELECT session, 'formal' AS part FROM (SELECT session FROM ends WHERE b >= {CUTOFF_MS} ORDER BY b, session LIMIT 500) UNION ALL SELECT session, 'warmup' FROM ends WHERE a >= {CUTOFF_MS - 7 * DAY_MS} AND b < {CUTOFF_MS})
 SELECT part, {_EVENTS} FROM beh JOIN parts USING (session)""")
def warmup_split(spark: SparkSession, folder: str) -> DataFrame:
    return clean.warmup_split(behaviour(spark, folder), CUTOFF_MS, 7, DAY_MS, 500).select("part", *EVENT_COLUMNS)


@query("SELECT sample_id, aid, source_rank, CASE WHEN final_score IS NULL OR NOT isfinite(final_score) THEN 0 ELSE final_score END AS final_score FROM candidate_features")
def finite(spark: SparkSession, folder: str) -> DataFrame:
    return clean.finite(spark.read.parquet(f"{folder}/candidate_features.parquet"), "final_score").select("sample_id", "aid", "source_rank", "final_score")


@query()
def subsample_frequent(spark: SparkSession, folder: str) -> DataFrame:
    return clean.subsample_frequent(behaviour(spark, folder), 0.001, 7).select(*EVENT_COLUMNS)


@query(f"{with_sql('beh')} SELECT session, visitorid, aid, ts, type, event_order FROM beh")
def sessionize(spark: SparkSession, folder: str) -> DataFrame:
    raw = clean.map_types(raw_behaviour(spark, folder)).withColumnsRenamed({"itemid": "aid", "timestamp": "ts"})
    return sessions.sessionise(raw, SESSION_GAP_MS).select("session", "visitorid", "aid", "ts", "type", "event_order")


@query(f"{with_sql('beh')} SELECT dense_rank() OVER (ORDER BY session) - 1 AS session, aid, ts, type, event_order FROM beh")
def dense_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.dense_sessions(behaviour(spark, folder).select(*EVENT_COLUMNS))


_DIM = """dim AS (SELECT session, any_value(visitorid) AS visitorid, count(*) AS event_count, count(DISTINCT aid) AS unique_item_count, min(ts) AS start_ts, max(ts) AS end_ts, CAST(sum(CASE WHEN ts = m THEN 1 ELSE 0 END) AS BIGINT) AS last_timestamp_count
 FROM (SELECT *, max(ts) OVER (PARTITION BY session) AS m FROM {0}) GROUP BY session),
 sess AS (SELECT *, NOT (event_count < 3 OR last_timestamp_count > 1) AS label_eligible, concat_ws('+', CASE WHEN event_count < 3 THEN 'too_short' END, CASE WHEN last_timestamp_count > 1 THEN 'ambiguous_last_timestamp' END) AS ineligible_reason FROM dim)"""


@query(f"{with_sql('basket')}, {_DIM.format('basket')} SELECT * FROM sess")
def session_dim(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_dimension(basket(spark, folder))


_LABELS = """lab AS (SELECT session, aid AS target_aid, type AS target_type, ts AS target_ts FROM (SELECT *, max(ts) OVER (PARTITION BY session) AS m, count(*) OVER (PARTITION BY session, ts) AS n FROM {0}) WHERE ts = m AND n = 1)"""


@query(f"{with_sql('basket')}, {_LABELS.format('basket')} SELECT b.{_EVENTS.replace(', ', ', b.')}, target_aid, target_type FROM basket b JOIN lab l ON b.session = l.session AND b.ts < l.target_ts")
def leave_last_out(spark: SparkSession, folder: str) -> DataFrame:
    history, labels = sessions.leave_last_out(basket(spark, folder))
    return history.select(*EVENT_COLUMNS).join(labels.select("session", "target_aid", "target_type"), "session")


_SPLIT = """pos AS (SELECT *, row_number() OVER (ORDER BY target_ts, session) AS r, count(*) OVER () AS n FROM lab), bound AS (SELECT max(CASE WHEN r = CAST(floor(n * 0.7) AS BIGINT) + 1 THEN target_ts END) AS v, max(CASE WHEN r = CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) + 1 THEN target_ts END) AS t FROM pos),
 split AS (SELECT session, target_aid, target_type, target_ts, CASE WHEN target_ts < v THEN 'train' WHEN target_ts < t THEN 'validation' ELSE 'test' END AS split FROM lab, bound)"""


@query(f"{with_sql('beh')}, {_LABELS.format('beh')}, {_SPLIT} SELECT * FROM split")
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.time_splits(sessions.last_event_labels(behaviour(spark, folder)))


@query(f"{with_sql('beh')}, {_LABELS.format('beh')}, {_SPLIT} SELECT split AS part, beh.{_EVENTS.replace(', ', ', beh.')} FROM beh JOIN split USING (session)")
def split_sessions(spark: SparkSession, folder: str) -> DataFrame:
    parts = sessions.split_sessions(behaviour(spark, folder))
    return clean.union_all(*(df.select(F.lit(part).alias("part"), *EVENT_COLUMNS) for part, df in parts.items()))


@query(f"{with_sql('beh')}, {_DIM.format('beh')}, lab0 AS (SELECT session, arg_max(aid, ts) AS target_aid, arg_max(type, ts) AS target_type, max(ts) AS target_ts FROM beh GROUP BY session), lab AS (SELECT * FROM lab0 WHERE session IN (SELECT session FROM sess WHERE label_eligible)), {_SPLIT} SELECT s.session, event_count, label_eligible, ineligible_reason, coalesce(split, 'reference_only') AS split FROM sess s LEFT JOIN split USING (session)")
def preprocess(spark: SparkSession, folder: str) -> DataFrame:
    _, dimension, _ = sessions.preprocess(raw_behaviour(spark, folder), SESSION_GAP_MS)
    return dimension.select("session", "event_count", "label_eligible", "ineligible_reason", "split")


_Q = ", ".join(f"round(quantile_cont(CASE WHEN label_eligible THEN event_count END, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99))
_B = ", ".join(f"CAST(sum(CASE WHEN label_eligible AND event_count BETWEEN {a} AND {b} THEN 1 ELSE 0 END) AS BIGINT) AS length_{a}_{b}" for a, b in ((3, 5), (6, 10), (11, 20), (21, 50), (51, 100)))
_C = ", ".join(f"round(sum(CASE WHEN label_eligible THEN greatest(least(event_count - 1, {c}) - 1, 0) END) / sum(CASE WHEN label_eligible THEN event_count - 2 END), 6) AS covered_{c}" for c in (20, 50, 100))


@query(f"""{with_sql('beh')}, {_DIM.format('beh')} SELECT count(*) AS all_sessions, CAST(sum(CASE WHEN label_eligible THEN 1 ELSE 0 END) AS BIGINT) AS label_eligible_sessions, CAST(sum(CASE WHEN label_eligible THEN 0 ELSE 1 END) AS BIGINT) AS reference_only_sessions,
 round(avg(CASE WHEN label_eligible THEN event_count END), 6) AS mean, max(CASE WHEN label_eligible THEN event_count END) AS max, {_Q}, {_B}, CAST(sum(CASE WHEN label_eligible AND event_count > 100 THEN 1 ELSE 0 END) AS BIGINT) AS length_over_100,
 CAST(sum(CASE WHEN label_eligible THEN event_count - 2 END) AS BIGINT) AS prefix_training_samples, {_C} FROM sess""")
def session_length_report(spark: SparkSession, folder: str) -> DataFrame:
    report = sessions.session_length_report(sessions.session_dimension(behaviour(spark, folder)))
    return rounded(report)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query(f"{with_sql('beh', 'state')} SELECT b.session, b.aid, b.ts, b.event_order, coalesce(s.timestamp, -1) AS state_ts, coalesce(s.categoryid, -1) AS categoryid FROM beh b ASOF LEFT JOIN state s ON b.aid = s.itemid AND b.ts >= s.timestamp")
def asof_category(spark: SparkSession, folder: str) -> DataFrame:
    return asof.backward_asof(behaviour(spark, folder).select("session", "aid", "ts", "event_order"), state(spark, folder), "aid", "ts", "itemid", "timestamp", ["categoryid"]).fillna(-1)


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    changes = state(spark, folder)
    paths = asof.category_paths(spark, tree(spark, folder), changes)
    return asof.asof_enrich(behaviour(spark, folder), changes, changes, paths)


_PATHS = """up AS (SELECT c.categoryid, coalesce(p.categoryid, c.categoryid) AS root_categoryid, CASE WHEN p.categoryid IS NULL THEN 0 ELSE 1 END AS category_depth, CASE WHEN p.categoryid IS NULL THEN c.categoryid::VARCHAR ELSE p.categoryid || ',' || c.categoryid END AS category_path, true AS in_tree FROM tree c LEFT JOIN tree p ON c.parentid = p.categoryid),
 paths AS (SELECT * FROM up UNION ALL SELECT DISTINCT categoryid, categoryid, 0, categoryid::VARCHAR, false FROM state WHERE categoryid NOT IN (SELECT categoryid FROM tree))"""
ENRICHED_SQL = """joined AS (SELECT b.*, s.categoryid AS c, s.timestamp AS st, s.available AS av FROM beh b ASOF LEFT JOIN state s ON b.aid = s.itemid AND b.ts >= s.timestamp),
 enriched AS (SELECT session, aid, ts, type, event_order, coalesce(c, -1) AS categoryid, coalesce(st, -1) AS category_state_ts, coalesce(av, -1) AS available, coalesce(st, -1) AS availability_state_ts, coalesce(root_categoryid, -1) AS root_categoryid, coalesce(category_depth, -1)::BIGINT AS category_depth, coalesce(category_path, '-1') AS category_path, coalesce(in_tree, false) AS in_tree FROM joined LEFT JOIN paths ON c = paths.categoryid)"""


@query(f"{with_sql('beh', 'state', 'tree')}, {_PATHS}, {ENRICHED_SQL} SELECT * FROM enriched")
def asof_enrich(spark: SparkSession, folder: str) -> DataFrame:
    rows = texts(_enriched(spark, folder), "category_path")
    return rows.select(*EVENT_COLUMNS, "categoryid", "category_state_ts", "available", "availability_state_ts", "root_categoryid", "category_depth", "category_path", "in_tree")


@query(f"{with_sql('state')} SELECT itemid, arg_max(categoryid, timestamp) AS categoryid, max(timestamp) AS state_ts FROM state WHERE timestamp < {CUTOFF_MS} GROUP BY itemid")
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return asof.latest_state(state(spark, folder), CUTOFF_MS, "categoryid")


@query(f"{with_sql('state', 'tree')}, {_PATHS} SELECT categoryid, root_categoryid, category_depth::BIGINT AS category_depth, category_path, in_tree FROM paths")
def category_paths(spark: SparkSession, folder: str) -> DataFrame:
    return texts(asof.category_paths(spark, tree(spark, folder), state(spark, folder)), "category_path")


@query("""WITH RECURSIVE walk AS (SELECT categoryid, parentid, categoryid::VARCHAR AS path, 0 AS depth, categoryid AS root FROM category_tree
 UNION ALL SELECT w.categoryid, t.parentid, t.categoryid || ',' || w.path, w.depth + 1, t.categoryid FROM walk w JOIN category_tree t ON w.parentid = t.categoryid),
 best AS (SELECT categoryid, arg_max(root, depth) AS root_categoryid, max(depth)::BIGINT AS category_depth, arg_max(path, depth) AS category_path FROM walk GROUP BY categoryid)
 SELECT categoryid, root_categoryid, category_depth, category_path, true AS in_tree FROM best UNION ALL SELECT DISTINCT categoryid, categoryid, 0, categoryid::VARCHAR, false FROM item_category_changes WHERE categoryid IS NOT NULL AND categoryid NOT IN (SELECT categoryid FROM category_tree)""")
def category_tree_paths(spark: SparkSession, folder: str) -> DataFrame:
    return texts(asof.category_paths(spark, spark.read.parquet(f"{folder}/category_tree.parquet"), spark.read.parquet(f"{folder}/item_category_changes.parquet")), "category_path")


@query(f"""{with_sql('beh')}, fs AS (SELECT aid, min(ts) AS f FROM beh GROUP BY aid), snap AS (SELECT DISTINCT ts - ts % {DAY_MS} AS snapshot_ts FROM beh),
 sized AS (SELECT snapshot_ts, (SELECT count(*) FROM fs WHERE f < snapshot_ts) AS catalog_items FROM snap) SELECT *, catalog_items - lag(catalog_items, 1, 0) OVER (ORDER BY snapshot_ts) AS new_items FROM sized""")
def catalog_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return asof.catalogue_snapshots(behaviour(spark, folder))


@query(f"""{with_sql('beh', 'state', 'tree')}, {_PATHS}, c AS (SELECT itemid AS aid, arg_max(categoryid, timestamp) AS categoryid, max(timestamp) AS cts, arg_max(available, timestamp) AS available, max(timestamp) AS ats FROM state WHERE timestamp < {CUTOFF_MS} GROUP BY itemid), f AS (SELECT aid, min(ts) AS first_seen_ts FROM beh GROUP BY aid)
 SELECT aid, coalesce(categoryid, -1) AS categoryid, coalesce(root_categoryid, -1) AS root_categoryid, coalesce(available, -1) AS available, coalesce(first_seen_ts, -1) AS first_seen_ts, coalesce(round(({CUTOFF_MS} - first_seen_ts) / 86400000.0, 6), -1) AS candidate_age_days, coalesce(round(({CUTOFF_MS} - cts) / 86400000.0, 6), -1) AS category_state_age_days FROM (SELECT coalesce(c.aid, f.aid) AS aid, categoryid, available, cts, first_seen_ts FROM c FULL JOIN f ON c.aid = f.aid) LEFT JOIN paths USING (categoryid)""")
def item_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    changes, events = state(spark, folder), behaviour(spark, folder)
    rows = asof.item_snapshot(CUTOFF_MS, changes, changes, asof.category_paths(spark, tree(spark, folder), changes), asof.first_seen(events))
    return rounded(rows.select("aid", "categoryid", "root_categoryid", "available", "first_seen_ts", "candidate_age_days", "category_state_age_days")).fillna(-1)


_AGE = "CASE WHEN availability_state_ts >= 0 THEN (ts - availability_state_ts) / 3600000.0 END"


@query(f"""{with_sql('beh', 'state', 'tree')}, {_PATHS}, {ENRICHED_SQL} SELECT type, count(*) AS events, CAST(sum(CASE WHEN available = 1 THEN 1 ELSE 0 END) AS BIGINT) AS available_events, CAST(sum(CASE WHEN available = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unavailable_events, CAST(sum(CASE WHEN available = -1 THEN 1 ELSE 0 END) AS BIGINT) AS unknown_events,
 round(quantile_cont({_AGE}, 0.5), 6) AS age_hours_median, round(quantile_cont({_AGE}, 0.9), 6) AS age_hours_p90, round(quantile_cont({_AGE}, 0.99), 6) AS age_hours_p99 FROM enriched GROUP BY type""")
def availability_audit(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(asof.availability_audit(_enriched(spark, folder)))


_TYPE_ID = "CASE type WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END"
_SAMPLE_SQL = """hist AS (SELECT t.session, t.event_order AS target_order, t.aid AS target_aid, t.type AS target_type, t.ts AS target_ts, h.aid, h.ts, h.type, h.event_order, row_number() OVER (PARTITION BY t.session, t.event_order ORDER BY h.ts DESC, h.event_order DESC) AS back, count(*) OVER (PARTITION BY t.session, t.event_order) AS full_length FROM {0} t JOIN {1} h ON h.session = t.session AND h.ts < t.ts),
 samp AS (SELECT session, target_aid, target_type, target_ts, string_agg(aid::VARCHAR, ',' ORDER BY ts, event_order) AS history_aids, string_agg((CASE type WHEN 'clicks' THEN 0 WHEN 'carts' THEN 1 ELSE 2 END)::VARCHAR, ',' ORDER BY ts, event_order) AS history_type_ids, string_agg((target_ts - ts)::VARCHAR, ',' ORDER BY ts, event_order) AS history_time_deltas_ms, any_value(full_length) AS history_length_full, count(*) AS history_length_used
 FROM hist WHERE full_length >= 2 AND back <= {2} GROUP BY session, target_order, target_aid, target_type, target_ts)"""


@query(f"""{with_sql('basket')}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_order) - 1 AS pos, count(*) OVER (PARTITION BY session, ts) AS tied, (SELECT count(*) FROM basket x WHERE x.session = b.session AND x.ts < b.ts) AS before FROM basket b) WHERE tied = 1 AND pos >= 2 AND before >= 2),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM cand), pick AS (SELECT DISTINCT session, n, CAST(round_even(k * (n - 1) / 2.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT session, n FROM numbered WHERE n > 3), (SELECT unnest([0, 1, 2]) AS k)),
 targets AS (SELECT numbered.* FROM numbered LEFT JOIN pick USING (session, n, i) WHERE n <= 3 OR pick.session IS NOT NULL), {_SAMPLE_SQL.format('targets', 'basket', 3)} SELECT * FROM samp""")
def prefix_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequences.training_samples(basket(spark, folder), max_history=3, max_samples=3)
    return texts(rows, "history_aids", "history_type_ids", "history_time_deltas_ms").drop("target_type_id", "event_order")


@query(f"{with_sql('beh')}, {_LABELS.format('beh')}, {_SPLIT}, targets AS (SELECT session, target_aid AS aid, target_type AS type, target_ts AS ts, 0 AS event_order FROM split WHERE split = 'validation'), {_SAMPLE_SQL.format('targets', 'beh', 30)} SELECT * FROM samp")
def eval_samples(spark: SparkSession, folder: str) -> DataFrame:
    events = behaviour(spark, folder)
    labels = sessions.time_splits(sessions.last_event_labels(events)).filter("split = 'validation'")
    rows = sequences.evaluation_samples(events, labels)
    return texts(rows, "history_aids", "history_type_ids", "history_time_deltas_ms").drop("target_type_id")


_FS = "fs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_order) AS p, count(*) OVER (PARTITION BY user_id) AS n, item_id, is_positive FROM feedback)"


@query(f"{with_sql('feedback')}, {_FS}, ok AS (SELECT user_id FROM fs WHERE n - p < 20 GROUP BY user_id HAVING sum(is_positive) >= 3) SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY p) AS items, string_agg(is_positive::VARCHAR, ',' ORDER BY p) AS positive FROM fs WHERE n - p < 20 AND user_id IN (SELECT user_id FROM ok) GROUP BY user_id")
def feedback_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return texts(sequences.feedback_sequences(feedback(spark, folder), max_length=20, min_positive=3), "items", "positive")


@query(f"{with_sql('feedback')}, {_FS} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY p) FILTER (p <= n - 2) AS train, string_agg(item_id::VARCHAR, ',' ORDER BY p) FILTER (p <= n - 1) AS valid, string_agg(item_id::VARCHAR, ',' ORDER BY p) AS test FROM fs WHERE n >= 5 GROUP BY user_id")
def leave_two_out(spark: SparkSession, folder: str) -> DataFrame:
    return texts(sequences.leave_two_out(sequences.feedback_sequences(feedback(spark, folder)), 3), "train", "valid", "test")


@query(f"{with_sql('feedback')}, u AS (SELECT DISTINCT user_id FROM feedback), r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS p, count(*) OVER () AS n FROM u) SELECT user_id, CASE WHEN p <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r")
def user_holdout(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.user_holdout(feedback(spark, folder).select("user_id").distinct(), 0.8)


@query(f"""{with_sql('feedback')}, {_FS}, pos AS (SELECT user_id, p, row_number() OVER (PARTITION BY user_id ORDER BY p DESC) AS back, count(*) OVER (PARTITION BY user_id) AS k FROM fs WHERE is_positive = 1),
 cut AS (SELECT user_id, max(p) FILTER (back = 2) AS v, max(p) FILTER (back = 1) AS e FROM pos WHERE k >= 5 GROUP BY user_id)
 SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY p) FILTER (p < v) AS train, string_agg(item_id::VARCHAR, ',' ORDER BY p) FILTER (p <= v) AS valid, string_agg(item_id::VARCHAR, ',' ORDER BY p) FILTER (p <= e) AS test FROM fs JOIN cut USING (user_id) GROUP BY user_id""")
def positive_leave_two_out(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequences.positive_leave_two_out(sequences.feedback_sequences(feedback(spark, folder)), 3)
    return rows.select("user_id", *(F.concat_ws(",", F.transform(part, lambda x: x.item.cast("string"))).alias(part) for part in ("train", "valid", "test")))


@query(f"""{with_sql('feedback')}, {_FS}, t AS (SELECT * FROM fs WHERE p >= 3 AND p > n - 4), h AS (SELECT t.user_id, t.p, t.item_id AS target, string_agg(f.item_id::VARCHAR, ',' ORDER BY f.p) AS hist, count(*) AS c FROM t JOIN fs f ON f.user_id = t.user_id AND f.p < t.p AND f.p >= t.p - 5 GROUP BY ALL)
 SELECT user_id, p - 1 AS position, repeat('0,', 5 - c::INT) || hist AS history, target FROM h""")
def next_item_samples(spark: SparkSession, folder: str) -> DataFrame:
    return texts(sequences.next_item_samples(sequences.feedback_sequences(feedback(spark, folder)), history=5, last=4), "history")


@query(f"""{with_sql('feedback')}, {_FS}, t AS (SELECT * FROM fs WHERE is_positive = 1 AND p > 1), h AS (SELECT t.user_id, t.p, t.item_id AS target, string_agg(f.item_id::VARCHAR, ',' ORDER BY f.p) AS hist, string_agg((f.is_positive + 1)::VARCHAR, ',' ORDER BY f.p) AS fb, count(*) AS c FROM t JOIN fs f ON f.user_id = t.user_id AND f.p < t.p AND f.p >= t.p - 5 GROUP BY ALL)
 SELECT user_id, p - 1 AS position, repeat('0,', 5 - c::INT) || hist AS history, repeat('0,', 5 - c::INT) || fb AS feedback, target FROM h""")
def positive_samples(spark: SparkSession, folder: str) -> DataFrame:
    return texts(sequences.positive_samples(sequences.feedback_sequences(feedback(spark, folder)), history=5), "history", "feedback")


@query(f"{with_sql('feedback')}, d AS (SELECT *, dense_rank() OVER (ORDER BY item_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_order DESC) AS back FROM feedback) SELECT user_id, string_agg(i::VARCHAR, ',' ORDER BY timestamp, event_order) AS items FROM d WHERE back <= 30 GROUP BY user_id HAVING count(*) >= 10")
def interaction_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return texts(sequences.interaction_sequences(feedback(spark, folder), 10, 30), "items")


@query(f"""{with_sql('feedback')}, {_FS}, t AS (SELECT user_id, max(p) AS p FROM fs WHERE is_positive = 1 GROUP BY user_id), h AS (SELECT t.user_id, t.p, coalesce(string_agg(f.item_id::VARCHAR, ',' ORDER BY f.p), '') AS hist, coalesce(string_agg((f.is_positive + 1)::VARCHAR, ',' ORDER BY f.p), '') AS fb, count(f.p) AS c FROM t LEFT JOIN fs f ON f.user_id = t.user_id AND f.p < t.p AND f.p >= t.p - 5 GROUP BY ALL)
 SELECT h.user_id, h.p - 1 AS position, repeat('0,', 5 - c::INT) || hist AS history, repeat('0,', 5 - c::INT) || fb AS feedback, item_id AS target FROM h JOIN fs ON fs.user_id = h.user_id AND fs.p = h.p WHERE c > 0""")
def last_positive_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequences.last_positive_samples(sequences.feedback_sequences(feedback(spark, folder)), history=5)
    return texts(rows.filter("position > 0"), "history", "feedback")


@query(f"""{with_sql('feedback')}, {_FS}, seq AS (SELECT user_id, list(item_id ORDER BY p) AS items, list(is_positive ORDER BY p) AS pos, count(*) AS n FROM fs GROUP BY user_id),
 blk AS (SELECT *, unnest(range(1, n, 4)) AS b FROM seq WHERE n > 1), w AS (SELECT *, least(b + 4, n) AS e, greatest(0, least(b + 4, n) - 9) AS f FROM blk)
 SELECT user_id, b AS block_start, repeat('0,', (8 - (e - f - 1))::INT) || array_to_string([items[i + 1] + 1 for i in range(f, e - 1)], ',') AS items, repeat('0,', (8 - (e - f - 1))::INT) || array_to_string([pos[i + 1] + 1 for i in range(f, e - 1)], ',') AS feedback,
 repeat('-100,', (8 - (e - f - 1))::INT) || array_to_string([CASE WHEN pos[i + 2] = 1 AND i + 1 >= b THEN items[i + 2] ELSE -100 END for i in range(f, e - 1)], ',') AS labels FROM w""")
def masked_windows(spark: SparkSession, folder: str) -> DataFrame:
    return texts(sequences.masked_windows(sequences.feedback_sequences(feedback(spark, folder)), length=8, stride=4), "items", "feedback", "labels")


QUERIES, ORACLES = query.queries, query.oracles
