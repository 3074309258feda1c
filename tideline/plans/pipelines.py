"""Whole chains: from the raw log to metrics, snapshots, and rolling folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.adapters import CUTOFF_MS, DAY_MS, SESSION_GAP_MS, behaviour, raw_behaviour, state, tree, with_sql
from tideline.operators import asof, clean, diagnostics, fusion, indexes, metrics, routes, sequences, sessions, snapshots
from tideline.plans.events import _LABELS, _SPLIT, rounded
from tideline.plans.ranking import _RANKED, _TOPLIST
from tideline.plans.recall import _BASE, _INDEX_SQL, _UNION, SOURCES
from tideline.plans.recall import _ENR
from tideline.plans.recall import _PAST as _PAST_SQL
from tideline.plans.recall import _SEEDS as _RECALL_SEEDS
from tideline.plans.registry import Registry
from tideline.session import settle

query = Registry()


def recent_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Raw log, sessions, unambiguous labels, recent items, hit rate at 20 by action."""
    events = sessions.sessionise(clean.map_types(raw_behaviour(spark, folder)).withColumnsRenamed({"itemid": "aid", "timestamp": "ts"}), SESSION_GAP_MS)
    labels = sessions.last_event_labels(clean.drop_ambiguous(events))
    samples = sequences.evaluation_samples(events, labels, min_history=1, max_history=1000)
    return rounded(metrics.recall_at(routes.recent(samples, 20).withColumnRenamed("source_score", "score"), labels, 20))


_ACT = {a: f"coalesce(avg(CASE WHEN target_type = '{a}' THEN hit::DOUBLE END), 0)" for a in ("clicks", "carts", "orders")}
query(
    f"{with_sql('beh')}, {_LABELS.format('beh')}, h AS (SELECT b.session, b.aid, max(b.ts * 1000000 + b.event_order) AS last FROM beh b JOIN lab l ON l.session = b.session AND b.ts < l.target_ts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY last DESC) AS k FROM h), x AS (SELECT l.*, CASE WHEN r.k <= 20 THEN 1 ELSE 0 END AS hit FROM lab l LEFT JOIN r ON r.session = l.session AND r.aid = l.target_aid) SELECT {', '.join(f'round({v}, 6) AS recall_{a}' for a, v in _ACT.items())}, round(0.1 * {_ACT['clicks']} + 0.3 * {_ACT['carts']} + 0.6 * {_ACT['orders']}, 6) AS weighted_recall FROM x"
)(recent_baseline)


def _samples(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = settle(behaviour(spark, folder))
    labels = sessions.time_splits(sessions.last_event_labels(events)).filter("split = 'validation'")
    return events, settle(sequences.evaluation_samples(events, labels))


_VAL = f"{with_sql('beh')}, {_LABELS.format('beh')}, {_SPLIT}, v AS (SELECT session, target_ts, target_ts - target_ts % {DAY_MS} AS snapshot_ts FROM split s WHERE split = 'validation' AND (SELECT count(*) FROM beh b WHERE b.session = s.session AND b.ts < s.target_ts) >= 2), snap AS (SELECT DISTINCT snapshot_ts FROM v)"
_PAST = f"past AS (SELECT snapshot_ts, b.* FROM snap JOIN beh b ON b.ts < snapshot_ts)"
_SEEDS = "hist AS (SELECT v.session, v.snapshot_ts, b.aid, row_number() OVER (PARTITION BY v.session ORDER BY b.ts DESC, b.event_order DESC) AS back FROM v JOIN beh b ON b.session = v.session AND b.ts < v.target_ts), seeds AS (SELECT session, snapshot_ts, aid AS src, row_number() OVER (PARTITION BY session ORDER BY min(back)) - 1 AS recency FROM hist WHERE back <= 30 GROUP BY session, snapshot_ts, aid), wanted AS (SELECT DISTINCT snapshot_ts, src FROM seeds WHERE recency < 5)"


@query(f"{_VAL}, {_PAST}, c AS (SELECT snapshot_ts, aid, count(*)::DOUBLE AS score FROM past GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts ORDER BY score DESC, aid) AS rank FROM c) WHERE rank <= 20")
def snapshot_popularity(spark: SparkSession, folder: str) -> DataFrame:
    events, samples = _samples(spark, folder)
    return snapshots.popularity_at(events, samples.withColumn("snapshot_ts", snapshots.floor_to("target_ts", DAY_MS)), 20)


def _wanted(samples: DataFrame) -> DataFrame:
    rows = samples.withColumn("snapshot_ts", snapshots.floor_to("target_ts", DAY_MS))
    return rows.select("snapshot_ts", F.explode(F.slice(F.array_distinct(F.reverse("history_aids")), 1, 5)).alias("src")).distinct()


_CF = "held AS (SELECT DISTINCT snapshot_ts, session, aid FROM past), sized AS (SELECT *, 1.0 / log2(2 + count(*) OVER (PARTITION BY snapshot_ts, session)) AS w FROM held), cnt AS (SELECT snapshot_ts, aid, count(*) AS n FROM held GROUP BY ALL), cf0 AS (SELECT a.snapshot_ts, a.aid AS src, b.aid AS dst, sum(a.w) AS s FROM sized a JOIN held b ON a.snapshot_ts = b.snapshot_ts AND a.session = b.session AND a.aid <> b.aid JOIN wanted t ON t.snapshot_ts = a.snapshot_ts AND t.src = a.aid GROUP BY ALL), cf1 AS (SELECT c.snapshot_ts, src, dst, s / sqrt(x.n * y.n) AS score FROM cf0 c JOIN cnt x ON x.snapshot_ts = c.snapshot_ts AND x.aid = src JOIN cnt y ON y.snapshot_ts = c.snapshot_ts AND y.aid = dst), cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts, src ORDER BY round(score, 9) DESC, dst) AS rank FROM cf1) WHERE rank <= {n})"


@query(f"{_VAL}, {_PAST}, {_SEEDS}, {_CF.format(n=20)} SELECT snapshot_ts, src, dst, round(score, 6) AS score, rank FROM cf")
def snapshot_itemcf(spark: SparkSession, folder: str) -> DataFrame:
    events, samples = _samples(spark, folder)
    return rounded(snapshots.itemcf_at(events, _wanted(samples), 20))


_MOVES = "ord AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_order) AS p FROM beh), mv0 AS (SELECT a.aid AS src, b.aid AS dst, b.ts AS at, CASE b.type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 3 ELSE 6 END * (exp(-(b.ts - a.ts) / 60000.0 / 30.0) + 0.2 * exp(-(b.ts - a.ts) / 60000.0 / 1440.0)) / (b.p - a.p) AS s FROM ord a JOIN ord b ON a.session = b.session AND b.p BETWEEN a.p + 1 AND a.p + 3 AND b.ts > a.ts AND a.aid <> b.aid), mv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts, src ORDER BY round(score, 9) DESC, dst) AS rank FROM (SELECT t.snapshot_ts, t.src, dst, sum(s) AS score FROM wanted t JOIN mv0 ON mv0.src = t.src AND mv0.at < t.snapshot_ts GROUP BY ALL)) WHERE rank <= {n})"


@query(f"{_VAL}, {_SEEDS}, {_MOVES.format(n=20)} SELECT snapshot_ts, src, dst, round(score, 6) AS score, rank FROM mv")
def snapshot_transitions(spark: SparkSession, folder: str) -> DataFrame:
    events, samples = _samples(spark, folder)
    return rounded(snapshots.transitions_at(events, _wanted(samples), 20))


def _near(edges: str, source: str) -> str:
    return f"SELECT session, snapshot_ts, aid, '{source}' AS source, rank AS source_rank, score AS source_score FROM (SELECT *, row_number() OVER (PARTITION BY session, snapshot_ts ORDER BY round(score, 9) DESC, aid) AS rank FROM (SELECT session, s.snapshot_ts, dst AS aid, sum(score / (recency + 1)) AS score FROM seeds s JOIN {edges} e ON e.snapshot_ts = s.snapshot_ts AND e.src = s.src WHERE recency < 5 GROUP BY ALL)) WHERE rank <= 20"


@query(
    f"{_VAL}, {_PAST}, {_SEEDS}, {_CF.format(n=100)}, {_MOVES.format(n=200)}, pop AS (SELECT * FROM (SELECT snapshot_ts, aid, row_number() OVER (PARTITION BY snapshot_ts ORDER BY n DESC, aid) AS rank FROM (SELECT snapshot_ts, aid, count(*) AS n FROM past GROUP BY snapshot_ts, aid)) WHERE rank <= 20) SELECT session, snapshot_ts, aid, source, source_rank, round(source_score, 6) AS source_score FROM (SELECT session, snapshot_ts, src AS aid, 'recent' AS source, recency + 1 AS source_rank, 1.0 / (recency + 1) AS source_score FROM seeds WHERE recency < 20 UNION ALL SELECT session, v.snapshot_ts, aid, 'popular', rank, 1.0 / rank FROM v JOIN pop USING (snapshot_ts) UNION ALL {_near('cf', 'itemcf')} UNION ALL {_near('mv', 'transition')})"
)
def point_in_time(spark: SparkSession, folder: str) -> DataFrame:
    events, samples = _samples(spark, folder)
    return rounded(snapshots.point_in_time(events, samples, 20))


@query(f"{_VAL}, {_PAST} SELECT s.snapshot_ts, n AS samples, count(p.ts) AS reference_events, count(DISTINCT p.aid) AS catalog_items, coalesce(max(p.ts), -1) AS max_reference_ts FROM (SELECT snapshot_ts, count(*) AS n FROM v GROUP BY snapshot_ts) s LEFT JOIN past p USING (snapshot_ts) GROUP BY ALL")
def snapshot_audit(spark: SparkSession, folder: str) -> DataFrame:
    events, samples = _samples(spark, folder)
    return snapshots.snapshot_audit(events, samples)


_FOLDS = 2
_FOLD_POINTS = [0.4 + 0.6 * i / _FOLDS for i in range(_FOLDS + 1)]
_FOLD_SAMPLES = f"""f_all AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_order) - 1 AS place, count(*) OVER (PARTITION BY session, ts) AS tied FROM beh),
 f_num AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM f_all WHERE tied = 1 AND place >= 2),
 f_pick AS (SELECT DISTINCT session, n, CAST(round_even(k * (n - 1) / 49.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT session, n FROM f_num WHERE n > 50), (SELECT unnest(range(0, 50)) AS k)),
 f_smp AS (SELECT f.session AS of_session, aid AS target_aid, type AS target_type, ts AS target_ts FROM f_num f LEFT JOIN f_pick p ON p.session = f.session AND p.n = f.n AND p.i = f.i WHERE f.n <= 50 OR p.session IS NOT NULL),
 f_bound AS (SELECT {', '.join(f'CAST(floor(quantile_cont(target_ts::DOUBLE, {q})) AS BIGINT) AS b{i}' for i, q in enumerate(_FOLD_POINTS))} FROM f_smp)"""


def _fold_sql(fold: int) -> str:
    own = f"cutoff AS (SELECT b{fold} AS c FROM f_bound), f_own AS (SELECT row_number() OVER (ORDER BY of_session, target_ts) AS session, s.* FROM f_smp s, f_bound WHERE target_ts >= b{fold} AND target_ts < b{fold + 1}{' + 1' if fold == _FOLDS - 1 else ''})"
    hist = "hist AS (SELECT t.session, h.aid, h.type, row_number() OVER (PARTITION BY t.session ORDER BY h.ts DESC, h.event_order DESC) AS back, count(*) OVER (PARTITION BY t.session) AS n FROM f_own t JOIN beh h ON h.session = t.of_session AND h.ts < t.target_ts)"
    text = f"""SELECT * FROM ({_ENR}, {_FOLD_SAMPLES}, {own}, {hist}, {_RECALL_SEEDS[_RECALL_SEEDS.index('used AS'):]}, {_PAST_SQL}, {_INDEX_SQL}, f_found AS ({_UNION}),
 f_fused AS (SELECT session, aid, sum(1.0 / (60.0 + source_rank)) AS s, count(DISTINCT source) AS k, min(source_rank) AS r FROM f_found GROUP BY ALL),
 f_lab AS (SELECT f.*, CAST(f.aid = o.target_aid AS INT) AS label FROM f_fused f JOIN f_own o USING (session)),
 f_more AS (SELECT * FROM f_lab UNION ALL SELECT session, target_aid, 0, 0, 201, 1 FROM f_own WHERE session NOT IN (SELECT session FROM f_lab WHERE label = 1))
 SELECT {fold} AS fold, of_session AS session, target_ts, aid, round(s, 6) AS rrf_score, k AS source_count, r AS best_source_rank, label, target_type FROM (SELECT *, row_number() OVER (PARTITION BY session, label ORDER BY round(s, 9) DESC, k DESC, aid) AS place FROM f_more) JOIN f_own USING (session) WHERE label = 1 OR place <= 30)"""
    return text.replace(str(CUTOFF_MS - 30 * DAY_MS), f"((SELECT c FROM cutoff) - {30 * DAY_MS})").replace(str(CUTOFF_MS), "(SELECT c FROM cutoff)")


@query(" UNION ALL ".join(map(_fold_sql, range(_FOLDS))))
def rolling_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold training candidates: each fold's samples meet indexes frozen at its start; positives are added where they lack."""
    events, changes = settle(behaviour(spark, folder)), state(spark, folder)
    enriched = settle(asof.asof_enrich(events, changes, changes, asof.category_paths(spark, tree(spark, folder), changes)))
    samples = settle(sequences.training_samples(events, max_history=30).withColumns({"of_session": F.col("session"), "session": F.xxhash64("session", "target_ts")}))
    out = None
    for fold in diagnostics.temporal_folds(spark, samples, _FOLDS, 0.4).orderBy("fold").collect():
        own = samples.filter((F.col("target_ts") >= fold.start_ts) & (F.col("target_ts") < fold.end_ts))
        found = routes.from_indexes(own, indexes.freeze(events, enriched, changes, fold.start_ts))
        one = fusion.compact(found, own, SOURCES, 30, 200).join(own.select("session", "of_session", "target_ts"), "session").withColumn("fold", F.lit(fold.fold))
        out = one if out is None else out.unionByName(one)
    return out.select("fold", F.col("of_session").alias("session"), "target_ts", "aid", F.round("rrf_score", 6).alias("rrf_score"), "source_count", "best_source_rank", "label", "target_type")


_FIRST = "cutoff AS (SELECT min(target_ts) AS c FROM split WHERE split = 'validation' AND session IN (SELECT session FROM used))"
_FROZEN = f"{_BASE.replace(_PAST_SQL, _FIRST + ', ' + _PAST_SQL)}, {_INDEX_SQL}".replace(str(CUTOFF_MS - 30 * DAY_MS), f"((SELECT c FROM cutoff) - {30 * DAY_MS})").replace(str(CUTOFF_MS), "(SELECT c FROM cutoff)")


@query(f"""{_FROZEN}, cand AS ({_UNION}), fused AS (SELECT session, aid, sum(1.0 / (60.0 + source_rank)) AS s, count(DISTINCT source) AS k FROM cand GROUP BY ALL),
 scored AS (SELECT f.session AS sample_id, aid, t.target_type, CAST(coalesce(aid = t.target_aid, false) AS INT) AS label, round(s, 9) AS final_score FROM fused f JOIN split t ON t.session = f.session), {_RANKED} {_TOPLIST}""")
def frozen_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Validation samples against indexes frozen at their earliest target: union, fusion and list metrics, label-blind."""
    events, samples = _samples(spark, folder)
    changes = state(spark, folder)
    cutoff = samples.agg(F.min("target_ts")).first()[0] or 0
    enriched = asof.asof_enrich(events, changes, changes, asof.category_paths(spark, tree(spark, folder), changes))
    found = routes.from_indexes(samples, indexes.freeze(events, enriched, changes, cutoff))
    rows = fusion.compact(found, samples, SOURCES, 0, 200, inject=False, prioritise=False)
    return rounded(metrics.toplist(rows.select(F.col("session").alias("sample_id"), "aid", "target_type", "label", F.round("rrf_score", 9).alias("final_score")), 20))


QUERIES, ORACLES = query.queries, query.oracles
