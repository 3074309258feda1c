"""Queries over indexes, routes and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.adapters import CUTOFF_MS, DAY_MS, basket, behaviour, state, tree, with_sql
from tideline.operators import asof, fusion, indexes, routes, sequences, sessions
from tideline.plans.events import _LABELS, _PATHS, _SPLIT, ENRICHED_SQL, rounded
from tideline.plans.registry import Registry
from tideline.session import settle

query = Registry()
SOURCES = ["category", "hybrid_popular", "itemcf", "recent", "transition"]

_W = "CAST(CASE type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 3 ELSE 6 END AS DOUBLE)"
_PAST = f"past AS (SELECT *, {_W} AS w, ({CUTOFF_MS} - ts) / 86400000.0 AS age FROM beh WHERE ts < {CUTOFF_MS})"


def _top(source: str, n: int, item: str = "aid", group: str = "", score: str = "score") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY round({score}, 9) DESC, {item}) AS rank FROM ({source})) WHERE rank <= {n}"


_POP = "SELECT aid, CAST(count(*) AS DOUBLE) AS score FROM past GROUP BY aid"
_TREND = "SELECT aid, sum(w * (exp(-age) + 0.3 * exp(-age / 7.0))) AS score FROM past GROUP BY aid"
_NEW = f"SELECT aid, sum(w * exp(-age / 7.0)) / sqrt(({CUTOFF_MS} - min(ts)) / 86400000.0 + 1) AS score FROM past GROUP BY aid HAVING min(ts) >= {CUTOFF_MS - 30 * DAY_MS}"
_WEIGHTED = "SELECT aid, sum(w) AS score FROM past GROUP BY aid"


@query(f"{with_sql('beh')}, {_PAST} SELECT aid, score, rank FROM ({_top(_POP, 20)})")
def popularity(spark: SparkSession, folder: str) -> DataFrame:
    return indexes.popularity(behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS), 20)


_WINDOWS = " UNION ALL ".join(f"SELECT '{name}' AS window, aid, count(*) AS events FROM past WHERE age <= {days} GROUP BY aid" for name, days in (("1d", 1), ("7d", 7), ("30d", 30), ("all", 100_000)))


@query(f"{with_sql('beh')}, {_PAST} SELECT \"window\", aid, events, rank FROM ({_top(_WINDOWS.replace('AS window', 'AS \"window\"'), 30, 'aid', '\"window\"', 'events')})")
def popularity_windows(spark: SparkSession, folder: str) -> DataFrame:
    return indexes.popularity_windows(behaviour(spark, folder), CUTOFF_MS, n=30)


@query(f"{with_sql('beh')}, {_PAST} SELECT aid, round(score, 6) AS score, rank FROM ({_top(_TREND, 50)})")
def trend_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.trend(behaviour(spark, folder), CUTOFF_MS, 50))


@query(f"{with_sql('beh')}, {_PAST} SELECT aid, round(score, 6) AS score, rank FROM ({_top(_NEW, 50)})")
def new_item_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.new_items(behaviour(spark, folder), CUTOFF_MS, 50))


def _hybrid_sql() -> str:
    lists = {
        "l0": _top("SELECT aid, CAST(count(*) AS DOUBLE) AS score FROM past WHERE type = 'clicks' GROUP BY aid", 200),
        "l1": _top("SELECT aid, CAST(count(*) AS DOUBLE) AS score FROM past WHERE type = 'carts' GROUP BY aid", 200),
        "l2": _top("SELECT aid, CAST(count(*) AS DOUBLE) AS score FROM past WHERE type = 'orders' GROUP BY aid", 200),
        "l3": _top(_TREND, 200),
        "l4": _top(_NEW, 200),
        "l5": _top(_WEIGHTED, 200),
    }
    ctes = [f"{name} AS ({sql})" for name, sql in lists.items()]
    for stage, quotas in indexes.STAGE_QUOTAS.items():
        taken: list[str] = []
        for i, quota in enumerate([*quotas, 20, 20, None]):
            seen = " UNION ALL ".join(f"SELECT aid FROM {t}" for t in taken) or "SELECT NULL::BIGINT WHERE false"
            name = f"{stage}{i}"
            left = f"100 - (SELECT count(*) FROM ({seen}))"
            limit = left if quota is None else f"least({quota}, {left})"
            ctes.append(f"{name} AS (SELECT '{stage}' AS stage, {i} AS part, aid, rank FROM (SELECT aid, rank, row_number() OVER (ORDER BY rank) AS k FROM l{i} WHERE aid NOT IN (SELECT aid FROM ({seen}) WHERE aid IS NOT NULL)) WHERE k <= {limit})")
            taken.append(name)
    every = " UNION ALL ".join(f"SELECT * FROM {stage}{i}" for stage in indexes.STAGE_QUOTAS for i in range(6))
    ctes.append(f"hybrid AS (SELECT stage, aid, row_number() OVER (PARTITION BY stage ORDER BY part, rank) AS rank FROM ({every}))")
    return ", ".join(ctes)


_HYBRID = _hybrid_sql()


@query(f"{with_sql('beh')}, {_PAST}, {_HYBRID} SELECT * FROM hybrid")
def hybrid_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return indexes.hybrid_popularity(behaviour(spark, folder), CUTOFF_MS)


def _cf(source: str, n: int) -> str:
    return f"""held AS (SELECT DISTINCT session, aid FROM {source}), sized AS (SELECT *, 1.0 / log2(2 + count(*) OVER (PARTITION BY session)) AS v FROM held), cnt AS (SELECT aid, count(*) AS n FROM held GROUP BY aid),
 cfraw AS (SELECT a.aid AS src, b.aid AS dst, sum(a.v) AS s FROM sized a JOIN held b ON a.session = b.session AND a.aid <> b.aid GROUP BY ALL), cf AS ({_top('SELECT src, dst, s / sqrt(x.n * y.n) AS score FROM cfraw JOIN cnt x ON x.aid = src JOIN cnt y ON y.aid = dst', n, 'dst', 'src')})"""


@query(f"{with_sql('beh')}, {_PAST}, {_cf('past', 20)} SELECT src, dst, round(score, 6) AS score, rank FROM cf")
def itemcf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.item_cf(behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS), 20))


@query(f"{with_sql('basket')}, {_cf('basket', 10)} SELECT src, dst, round(score, 6) AS score, rank FROM cf")
def itemcf_basket(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.item_cf(basket(spark, folder), 10))


def _moves(source: str, n: int, steps: int = 3, name: str = "moves") -> str:
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_order) AS p FROM {source}),
 {name} AS ({_top(f"SELECT a.aid AS src, b.aid AS dst, sum(CASE b.type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 3 ELSE 6 END * (exp(-(b.ts - a.ts) / 60000.0 / 30.0) + 0.2 * exp(-(b.ts - a.ts) / 60000.0 / 1440.0)) / (b.p - a.p)) AS score FROM ord a JOIN ord b ON a.session = b.session AND b.p BETWEEN a.p + 1 AND a.p + {steps} AND b.ts > a.ts AND a.aid <> b.aid GROUP BY ALL", n, 'dst', 'src')})"""


@query(f"{with_sql('beh')}, {_PAST}, {_moves('past', 20)} SELECT src, dst, round(score, 6) AS score, rank FROM moves")
def transitions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.transitions(behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS), 20))


@query(f"{with_sql('beh')}, {_PAST}, {_moves('past', 20, 1)} SELECT src, dst, round(score, 6) AS score, rank FROM moves")
def transition_adjacent(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.transitions(behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS), 20, steps=1))


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    changes = state(spark, folder)
    return asof.asof_enrich(behaviour(spark, folder), changes, changes, asof.category_paths(spark, tree(spark, folder), changes))


def _pool(column: str, n: int, name: str = "pools") -> str:
    return f"{name} AS ({_top(f'SELECT {column} AS category, aid, sum({_W} * (exp(-({CUTOFF_MS} - ts) / 86400000.0 / 7.0) + 0.2 * exp(-({CUTOFF_MS} - ts) / 86400000.0 / 30.0))) AS score FROM enriched WHERE {column} <> -1 AND ts < {CUTOFF_MS} GROUP BY ALL', n, 'aid', 'category')})"


_ENR = f"{with_sql('beh', 'state', 'tree')}, {_PATHS}, {ENRICHED_SQL}"


@query(f"{_ENR}, {_pool('categoryid', 20)} SELECT category, aid, round(score, 6) AS score, rank FROM pools")
def category_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.category_popularity(_enriched(spark, folder), CUTOFF_MS, 20))


@query(f"{_ENR}, {_pool('root_categoryid', 20)} SELECT category, aid, round(score, 6) AS score, rank FROM pools")
def root_category_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.category_popularity(_enriched(spark, folder), CUTOFF_MS, 20, "root_categoryid"))


@query(f"{with_sql('beh')}, ord AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_order) AS p, {_W} AS w FROM beh) SELECT a.aid AS center, b.aid AS context, count(*) AS pairs, round(sum(sqrt(a.w * b.w)), 6) AS weight FROM ord a JOIN ord b ON a.session = b.session AND a.p <> b.p AND abs(a.p - b.p) <= 3 GROUP BY ALL")
def skipgram_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.skipgram_pairs(behaviour(spark, folder), window=3).groupBy("center", "context").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").alias("weight")))


@query(f"{with_sql('beh')}, ord AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_order) AS p, count(*) OVER (PARTITION BY session) AS n FROM beh) SELECT a.aid AS center, b.aid AS context, round(sum(CASE WHEN abs(a.p - b.p) <= 3 THEN 1.0 ELSE exp(-0.2 * (abs(a.p - b.p) - 3)) END), 6) AS weight FROM ord a JOIN ord b ON a.session = b.session AND a.p <> b.p AND abs(a.p - b.p) <= least(10, greatest(5, round_even(a.n * 0.5, 0))) GROUP BY ALL")
def adaptive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(indexes.adaptive_pairs(behaviour(spark, folder)).groupBy("center", "context").agg(F.sum("weight").alias("weight")))


@query(f"{with_sql('beh')} SELECT session, aid, sum({_W}) AS value FROM beh GROUP BY ALL")
def session_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return indexes.session_matrix(behaviour(spark, folder))


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return _samples_of(behaviour(spark, folder))


def _samples_of(events: DataFrame) -> DataFrame:
    return sequences.evaluation_samples(events, sessions.time_splits(sessions.last_event_labels(events)).filter("split = 'validation'"))


def _indexes(spark: SparkSession, folder: str, n: int = 200) -> dict[str, DataFrame]:
    return indexes.freeze(behaviour(spark, folder), _enriched(spark, folder), state(spark, folder), CUTOFF_MS, n=n)


_SEEDS = """hist AS (SELECT t.session, h.aid, h.type, row_number() OVER (PARTITION BY t.session ORDER BY h.ts DESC, h.event_order DESC) AS back, count(*) OVER (PARTITION BY t.session) AS n FROM split t JOIN beh h ON h.session = t.session AND h.ts < t.target_ts WHERE t.split = 'validation'),
 used AS (SELECT * FROM hist WHERE back <= 30 AND n >= 2), seeds AS (SELECT session, aid AS seed, row_number() OVER (PARTITION BY session ORDER BY min(back)) - 1 AS recency FROM used GROUP BY session, aid),
 stages AS (SELECT session, CASE WHEN bool_or(type = 'orders') THEN 'order' WHEN bool_or(type = 'carts') THEN 'cart' ELSE 'click' END AS stage FROM used GROUP BY session)"""
_BASE = f"{_ENR}, {_LABELS.format('beh')}, {_SPLIT}, {_SEEDS}, {_PAST}"


def _near(edges: str, weight: str, seeds: int, limit: int) -> str:
    return _top(f"SELECT session, dst AS aid, sum(score * {weight}) AS score FROM seeds JOIN {edges} ON src = seed WHERE recency < {seeds} GROUP BY ALL", limit, "aid", "session")


_R_RECENT = "SELECT session, seed AS aid, 'recent' AS source, recency + 1 AS source_rank, 1.0 / (recency + 1) AS source_score FROM seeds WHERE recency < 30"
_R_HYBRID = "SELECT session, aid, 'hybrid_popular' AS source, rank AS source_rank, 1.0 / rank AS source_score FROM stages JOIN hybrid USING (stage)"
_R_CF = f"SELECT session, aid, 'itemcf' AS source, rank AS source_rank, score AS source_score FROM ({_near('cf', 'exp(-0.1 * recency)', 10, 200)})"
_R_MOVES = f"SELECT session, aid, 'transition' AS source, rank AS source_rank, score AS source_score FROM ({_near('moves', '(1.0 / (recency + 1))', 5, 150)})"
_ITEM_CATEGORY = f"itemcat AS (SELECT itemid AS seed, arg_max(categoryid, timestamp) AS category FROM state WHERE timestamp < {CUTOFF_MS} GROUP BY itemid)"
_R_CATEGORY = f"SELECT session, aid, 'category' AS source, rank AS source_rank, score AS source_score FROM ({_top('SELECT session, aid, sum(score / ((recency + 1) * rank)) AS score FROM seeds JOIN itemcat USING (seed) JOIN pools USING (category) WHERE recency < 5 GROUP BY ALL', 150, 'aid', 'session')})"
_INDEX_SQL = f"{_HYBRID}, {_cf('past', 200)}, {_moves('past', 200)}, {_pool('categoryid', 200)}, {_ITEM_CATEGORY}"
_ROUND = "SELECT session, aid, source, source_rank, round(source_score, 6) AS source_score FROM"
_UNION = " UNION ALL ".join((_R_RECENT, _R_HYBRID, _R_CF, _R_MOVES, _R_CATEGORY))


@query(f"{_BASE} {_ROUND} ({_R_RECENT})")
def recall_recent(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(routes.recent(_samples(spark, folder)))


@query(f"{_BASE}, {_HYBRID} {_ROUND} ({_R_HYBRID})")
def recall_hybrid_popular(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(routes.hybrid_popular(_samples(spark, folder), indexes.hybrid_popularity(behaviour(spark, folder), CUTOFF_MS)))


@query(f"{_BASE} {_ROUND} (SELECT DISTINCT session, p.aid, 'popular' AS source, p.rank AS source_rank, 1.0 / p.rank AS source_score FROM seeds, ({_top(_POP, 20)}) p)")
def recall_popular(spark: SparkSession, folder: str) -> DataFrame:
    past = behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS)
    return rounded(routes.popular(_samples(spark, folder), indexes.popularity(past, 20), 20))


@query(f"{_BASE}, {_cf('past', 200)} {_ROUND} ({_R_CF})")
def recall_itemcf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(routes.itemcf(_samples(spark, folder), indexes.item_cf(behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS), 200)))


@query(f"{_BASE}, {_moves('past', 200)} {_ROUND} ({_R_MOVES})")
def recall_transition(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(routes.transition(_samples(spark, folder), indexes.transitions(behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS), 200)))


@query(f"{_BASE}, {_pool('categoryid', 200)}, {_ITEM_CATEGORY} {_ROUND} ({_R_CATEGORY})")
def recall_category(spark: SparkSession, folder: str) -> DataFrame:
    frozen = _indexes(spark, folder)
    return rounded(routes.category(_samples(spark, folder), frozen["item_category"], frozen["category_popularity"]))


_ROOT_CATEGORY = f"rootcat AS (SELECT seed, coalesce(root_categoryid, category) AS category FROM itemcat LEFT JOIN paths ON category = categoryid)"


@query(f"{_BASE}, {_pool('root_categoryid', 200)}, {_ITEM_CATEGORY}, {_ROOT_CATEGORY} {_ROUND} ({_R_CATEGORY.replace('itemcat', 'rootcat').replace(chr(39) + 'category' + chr(39) + ' AS source', chr(39) + 'category_root' + chr(39) + ' AS source')})")
def recall_category_root(spark: SparkSession, folder: str) -> DataFrame:
    changes = state(spark, folder)
    frozen, paths = _indexes(spark, folder), asof.category_paths(spark, tree(spark, folder), changes)
    pools = indexes.category_popularity(_enriched(spark, folder), CUTOFF_MS, 200, "root_categoryid")
    return rounded(routes.category(_samples(spark, folder), routes.path_category(frozen["item_category"], paths, "root"), pools, source="category_root"))


@query(f"{_BASE}, {_INDEX_SQL} {_ROUND} ({_UNION})")
def recall_union(spark: SparkSession, folder: str) -> DataFrame:
    events, changes = settle(behaviour(spark, folder)), state(spark, folder)
    enriched = asof.asof_enrich(events, changes, changes, asof.category_paths(spark, tree(spark, folder), changes))
    samples = settle(_samples_of(events))
    return rounded(routes.from_indexes(samples, indexes.freeze(events, enriched, changes, CUTOFF_MS)))


_R_POP50 = f"SELECT DISTINCT session, p.aid, 'popular' AS source, p.rank AS source_rank, 1.0 / p.rank AS source_score FROM seeds, ({_top(_POP, 50)}) p"
_R_CF50 = f"SELECT session, aid, 'itemcf' AS source, rank AS source_rank, score AS source_score FROM ({_near('cf', '(1.0 / (recency + 1))', 5, 50)})"


@query(f"{_BASE}, {_cf('past', 100)} {_ROUND} ({_R_RECENT} UNION ALL {_R_POP50} UNION ALL {_R_CF50})")
def recall_four_routes(spark: SparkSession, folder: str) -> DataFrame:
    past = behaviour(spark, folder).filter(F.col("ts") < CUTOFF_MS)
    return rounded(routes.four_routes(_samples(spark, folder), indexes.popularity(past, 50), indexes.item_cf(past, 100), 50))


# Fusion over the scored candidates of the test tables.
ROUTE_NAMES = ["category", "popular", "item2vec", "itemcf", "recent", "transition", "two_tower"]
CAND_SQL = "cand AS (SELECT session, aid, source, source_rank, final_score AS source_score FROM candidate_features WHERE isfinite(final_score) AND session IS NOT NULL AND aid IS NOT NULL), lab AS (SELECT DISTINCT session, target_aid, target_type FROM validation_samples)"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Finite scored candidates as rows of routes."""
    rows = spark.read.parquet(f"{folder}/candidate_features.parquet")
    rows = rows.filter(F.col("final_score").isNotNull() & ~F.isnan("final_score") & (F.abs("final_score") != float("inf")))
    return rows.dropna(subset=["session", "aid"]).select("session", "aid", "source", "source_rank", F.col("final_score").alias("source_score"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of the validation samples, each once."""
    return spark.read.parquet(f"{folder}/validation_samples.parquet").select("session", "target_aid", "target_type").distinct()


_WIDE = ", ".join(f"min(CASE WHEN source = '{s}' THEN source_rank END) AS source_rank_{s}, round(max(CASE WHEN source = '{s}' THEN source_score END), 6) AS source_score_{s}" for s in ROUTE_NAMES)
_RRF = "sum(1.0 / (60.0 + source_rank)) AS rrf_score, count(DISTINCT source) AS source_count, min(source_rank) AS best_source_rank"


@query(f"WITH {CAND_SQL} SELECT session, aid, source, min(source_rank) AS source_rank, max(source_score) AS source_score FROM cand GROUP BY ALL")
def distinct_union(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.distinct_union(candidates(spark, folder))


@query(f"WITH {CAND_SQL} SELECT session, aid, round(rrf_score, 6) AS rrf_score, source_count, best_source_rank FROM (SELECT session, aid, {_RRF} FROM cand GROUP BY ALL)")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fusion.rrf_summary(candidates(spark, folder)))


_FILLED = ", ".join(f"coalesce(source_rank_{s}, 10000) AS source_rank_{s}, coalesce(source_score_{s}, 0) AS source_score_{s}, CAST(source_rank_{s} IS NOT NULL AS INT) AS source_present_{s}" for s in ROUTE_NAMES)


@query(f"WITH {CAND_SQL} SELECT session, aid, {_FILLED} FROM (SELECT session, aid, {_WIDE} FROM cand GROUP BY session, aid)")
def candidate_pivot(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.operators.clean import fill_routes

    return fill_routes(rounded(fusion.pivot(candidates(spark, folder), ROUTE_NAMES)), ROUTE_NAMES)


_ONE = f"one AS (SELECT session, aid, {_RRF} FROM cand WHERE source <> 'two_tower' GROUP BY ALL), two AS (SELECT session, aid, {_RRF} FROM cand WHERE source = 'two_tower' GROUP BY ALL)"


@query(f"WITH {CAND_SQL}, {_ONE} SELECT coalesce(one.session, two.session) AS session, coalesce(one.aid, two.aid) AS aid, round(coalesce(one.rrf_score, 0) + coalesce(two.rrf_score, 0), 6) AS rrf_score, coalesce(one.source_count, 0) + coalesce(two.source_count, 0) AS source_count, least(one.best_source_rank, two.best_source_rank) AS best_source_rank FROM one FULL JOIN two ON one.session = two.session AND one.aid = two.aid")
def pool_outer_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = candidates(spark, folder)
    return rounded(fusion.merge_pools(fusion.rrf_summary(rows.filter("source <> 'two_tower'")), fusion.rrf_summary(rows.filter("source = 'two_tower'")), ["session", "aid"]))


_SUM = f"summ AS (SELECT session, aid, {_RRF} FROM cand GROUP BY ALL), labelled AS (SELECT s.*, CAST(coalesce(s.aid = l.target_aid, false) AS INT) AS label FROM summ s LEFT JOIN lab l USING (session))"
_INJECT = "injected AS (SELECT * FROM labelled UNION ALL SELECT session, target_aid, 0, 0, 101, 1 FROM lab WHERE session NOT IN (SELECT session FROM labelled WHERE label = 1))"
_CUT = "SELECT c.session, aid, round(rrf_score, 6) AS rrf_score, source_count, best_source_rank, label, target_type FROM ({}) c LEFT JOIN lab USING (session)"


@query(f"WITH {CAND_SQL}, {_SUM}, {_INJECT} {_CUT.format('SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, label ORDER BY round(rrf_score, 9) DESC, source_count DESC, aid) AS n FROM injected) WHERE label = 1 OR n <= 20')}")
def compact_train(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.compact(candidates(spark, folder), labels(spark, folder), ROUTE_NAMES, 20, 100)
    return rounded(rows.select("session", "aid", "rrf_score", "source_count", "best_source_rank", "label", "target_type"))


@query(f"WITH {CAND_SQL}, {_SUM} {_CUT.format('SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(rrf_score, 9) DESC, source_count DESC, aid) AS n FROM labelled) WHERE n <= 20')}")
def compact_blind(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.compact(candidates(spark, folder), labels(spark, folder), ROUTE_NAMES, 20, 100, inject=False, prioritise=False)
    return rounded(rows.select("session", "aid", "rrf_score", "source_count", "best_source_rank", "label", "target_type"))


_HEUR = " + ".join(f"coalesce(1.0 / (60.0 + nullif(source_rank_{s}, 0)), 0)" for s in ROUTE_NAMES)


@query(f"WITH {CAND_SQL} SELECT session, aid, round(score, 6) AS score, row_number() OVER (PARTITION BY session ORDER BY round(score, 9) DESC, aid) AS rank FROM (SELECT session, aid, {_HEUR} AS score FROM (SELECT session, aid, {_WIDE} FROM cand GROUP BY session, aid))")
def heuristic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.pivot(candidates(spark, folder), ROUTE_NAMES).select("session", "aid", fusion.heuristic_score(ROUTE_NAMES).alias("score"))
    return rounded(indexes.ranked_within(rows, ["session"], 2**31 - 1))


@query()
def hash_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.compact(candidates(spark, folder), labels(spark, folder), ROUTE_NAMES, 0, 100)
    return fusion.cap_negatives(rows.select("session", "aid", "label"), 10, 5)


_POOL = "SELECT session AS sample_id, aid, source AS pool, row_number() OVER (PARTITION BY session, source ORDER BY source_rank, aid) AS ordinal FROM cand"


@query(f"WITH {CAND_SQL}, pool AS ({_POOL}), free AS (SELECT p.* FROM pool p ANTI JOIN (SELECT session AS sample_id, target_aid AS aid FROM lab) b ON p.sample_id = b.sample_id AND p.aid = b.aid), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, aid ORDER BY ordinal, pool) AS k FROM free) WHERE k = 1), placed AS (SELECT sample_id, aid, row_number() OVER (PARTITION BY sample_id ORDER BY ordinal, pool, aid) AS place FROM one) SELECT * FROM placed WHERE place <= 24")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session", "source").orderBy("source_rank", "aid")
    pools = candidates(spark, folder).select(F.col("session").alias("sample_id"), "aid", F.col("source").alias("pool"), F.row_number().over(w).alias("ordinal"))
    return fusion.round_robin(pools, labels(spark, folder).select(F.col("session").alias("sample_id"), F.col("target_aid").alias("aid")), 24)


QUERIES, ORACLES = query.queries, query.oracles
