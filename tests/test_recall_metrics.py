import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import diagnostics, features, fusion, indexes, metrics, models, routes, vectors


def test_transitions_are_directed(spark):
    df = spark.createDataFrame([(1, 1, 1, "clicks", 1), (1, 2, 2, "orders", 2), (1, 3, 3, "clicks", 3)], "session long, aid long, ts long, type string, event_order long")
    got = {(r.src, r["rank"]): r.dst for r in indexes.transitions(df).collect()}
    assert got[1, 1] == 2 and got[2, 1] == 3 and not any(s == 2 and d == 1 for (s, _), d in got.items())
    assert indexes.transitions(df.limit(0)).count() == 0


def test_skipgram_weights(spark):
    df = spark.createDataFrame([(1, 1, 1, "clicks", 1), (1, 2, 2, "orders", 2)], "session long, aid long, ts long, type string, event_order long")
    got = indexes.skipgram_pairs(df, window=2).collect()
    assert {(r.center, r.context) for r in got} == {(1, 2), (2, 1)} and all(r.weight == pytest.approx(math.sqrt(6)) for r in got)


def test_budget_merge(spark):
    lists = spark.createDataFrame([("x", p, r, a, q) for p, q, items in ((0, 2, [1, 2, 3]), (1, 2, [2, 1, 4, 5, 6]), (2, None, [9, 1, 7, 8])) for r, a in enumerate(items, 1)], "stage string, part int, rank long, aid long, quota int")
    assert [r.aid for r in indexes.merge_with_budget(lists, 6).orderBy("rank").collect()] == [1, 2, 4, 5, 9, 7]


def test_routes(spark):
    samples = spark.createDataFrame([(1, [5, 6, 5, 7], [0, 1, 0, 0]), (2, [], [])], "session long, history_aids array<long>, history_type_ids array<int>")
    assert [r.aid for r in routes.recent(samples).orderBy("source_rank").collect()] == [7, 5, 6]
    edges = spark.createDataFrame([(7, 1, 1.0), (5, 1, 1.0), (5, 2, 4.0)], "src long, dst long, score double")
    got = routes.by_neighbours(samples, edges, "itemcf", 10).orderBy("source_rank").collect()
    assert [(r.aid, r.source_score) for r in got] == [(2, 2.0), (1, 1.5)]
    assert {r.stage for r in samples.select(routes.stage().alias("stage")).collect()} == {"cart", "click"}


@pytest.fixture(scope="module")
def recalled(spark):
    rows = [(1, 10, "a", 1, 0.9), (1, 11, "a", 2, 0.5), (1, 10, "b", 2, 0.4), (2, 20, "b", 1, 0.8), (2, 21, "b", 2, 0.1)]
    return spark.createDataFrame(rows, "session long, aid long, source string, source_rank long, source_score double"), spark.createDataFrame([(1, 10, "clicks"), (2, 20, "carts")], "session long, target_aid long, target_type string")


def test_route_diagnostics(recalled):
    rows, labels = recalled
    got = {r.source: r for r in diagnostics.route_diagnostics(rows, labels).collect()}
    assert got["a"].union_recall == 1.0 and got["b"].exclusive_hits == 1 and got["a"].exclusive_hits == 0
    auc = {r.source: r for r in diagnostics.auc_gauc(rows, labels).collect()}
    assert auc["a"].candidate_auc == 1.0 and auc["b"].session_gauc == 1.0


def test_compaction(spark, recalled):
    rows, labels = recalled
    more = labels.union(spark.createDataFrame([(3, 99, "orders")], labels.schema))
    got = fusion.compact(rows, more, ["a", "b"], 1, 50).collect()
    injected = next(r for r in got if r.aid == 99)
    assert len(got) == 5 and (injected.rrf_score, injected.source_count, injected.best_source_rank, injected.label) == (0.0, 0, 51, 1)
    blind = fusion.compact(rows, labels, ["a", "b"], 1, 50, inject=False, prioritise=False).collect()
    assert {(r.session, r.aid) for r in blind} == {(1, 10), (2, 20)}


def test_rrf_doesnt_see_scores(spark):
    df = spark.createDataFrame([(1, 10, 1, 0.01), (1, 20, 2, 10000.0)], "session long, aid long, source_rank_recent long, source_score_recent double")
    assert [r.aid for r in df.orderBy(F.desc(fusion.heuristic_score(["recent"]))).collect()] == [10, 20]


def test_negative_cap(spark):
    df = spark.createDataFrame([(1, a, int(a == 0)) for a in range(6)], "session long, aid long, label int")
    assert fusion.cap_negatives(df, 2, 7).count() == 3
    assert sorted(map(str, fusion.cap_negatives(df, 2, 7).collect())) == sorted(map(str, fusion.cap_negatives(df.repartition(3), 2, 7).collect()))


def test_weighted_recall(spark):
    labels = spark.createDataFrame([(1, 10, "clicks"), (2, 20, "carts"), (3, 30, "orders")], "session long, target_aid long, target_type string")
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 31)], "session long, aid long")
    r = metrics.candidate_recall(rows, labels).first()
    assert (r.candidate_recall_clicks, r.candidate_recall_carts, r.candidate_recall_orders) == (1, 1, 0) and r.weighted_candidate_recall == pytest.approx(0.4)


def test_single_positive_auc(spark):
    rows = [(0, 0, 1, 0.9), (0, 1, 0, 0.5), (0, 2, 0, -math.inf), (0, 3, 0, 0.1), (1, 0, 0, 0.5), (1, 1, 1, 0.5), (1, 2, 0, 0.4), (1, 3, 0, 0.1)]
    df = spark.createDataFrame([(*r, "clicks") for r in rows], "sample_id long, aid long, label int, final_score double, target_type string")
    r = metrics.single_positive_auc(df).first()
    assert r.auc == pytest.approx(4.5 / 5) and r.uauc == pytest.approx((1 + 5 / 6) / 2)


def test_uauc_of_ties_and_missing(spark):
    df = spark.createDataFrame([(1, 1, "clicks", 1, 0.5), (1, 2, "clicks", 0, 0.5), (2, 3, "clicks", 0, 0.3)], "sample_id long, aid long, target_type string, label int, final_score double").withColumn("visitorid", F.lit(1))
    assert metrics.uauc(df).first().uauc == pytest.approx(0.75)
    assert metrics.end_to_end(df.drop("visitorid")).filter("label = 1 AND final_score = double('-infinity')").first().sample_id == 2
    assert metrics.uauc(df.limit(0)).first().eligible_users == 0


def test_task_targets(spark):
    df = spark.createDataFrame([(1, a, t, int(a == 0)) for t in ("clicks", "carts", "orders") for a in range(4)], "session long, aid long, target_type string, label int")
    r = features.task_targets(df).agg(F.sum("label_clicks"), F.sum("label_carts"), F.sum("label_orders")).first()
    assert tuple(r) == (3, 2, 1)
    with pytest.raises(Exception, match="unknown type"):
        features.task_targets(df.withColumn("target_type", F.lit("x"))).collect()


def test_exact_neighbours_break_ties_by_id(spark):
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 1.0]), (30, [0.0, 1.0]), (15, [1.0, 1.0])], "item_id long, vector array<double>")
    got = vectors.cosine_topk(rows.withColumnRenamed("item_id", "query_id"), rows, 2, same=True, block=2).filter("query_id = 10").orderBy("rank").collect()
    assert [r.item_id for r in got] == [15, 20]


def test_causal_mask(spark):
    df = spark.createDataFrame([(0, 0, 10, 100), (0, 1, 20, 200), (0, 2, 10, 300), (1, 3, 5, 1)], "batch long, row long, aid long, ts long")
    got = {(r["row"], r.column): r.allowed for r in models.causal_mask(df).collect() if r.batch == 0}
    assert [[got[i, j] for j in range(3)] for i in range(3)] == [[True, False, False], [True, True, False], [False, True, True]]


@pytest.mark.parametrize("kind", ["shared_bottom", "mmoe", "ple"])
def test_gradients_equal_differences(kind):
    rng = np.random.default_rng(1)
    net, x, y, w = models.ExpertNet(kind, 4, 5, 2), rng.normal(size=(7, 4)), rng.integers(0, 2, (7, 3)).astype(float), np.array([1.0, 2.0, 3.0])
    net.p["g"] = rng.normal(size=net.p["g"].shape)
    grads, loss = net.gradients(x, y, w)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        value[at] += 1e-6
        assert (net.gradients(x, y, w)[1] - loss) / 1e-6 == pytest.approx(grads[name][at], abs=1e-4)
        value[at] -= 1e-6


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(a > 0), int(a > 0 and b > 0), int(a > 1)) for a, b in rng.normal(size=(600, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label_clicks int, label_carts int, label_orders int")
    net, losses = models.train_ranker(df, ["a", "b"], "ple", epochs=15, batch=16)
    assert losses[-1] < losses[0]
    scored = models.score_ranker(df, net, ["a", "b"])
    r = scored.agg(F.avg(F.when(F.col("label_clicks") == 1, F.col("p_label_clicks"))).alias("p"), F.avg(F.when(F.col("label_clicks") == 0, F.col("p_label_clicks"))).alias("n")).first()
    assert r.p > r.n + 0.3


def test_folds(spark):
    df = spark.createDataFrame([(t,) for t in range(100, 200)], "target_ts long")
    rows = diagnostics.temporal_folds(spark, df, 4, 0.2).orderBy("fold").collect()
    assert all(a.end_ts == b.start_ts for a, b in zip(rows, rows[1:])) and rows[-1].end_ts == 200
    with pytest.raises(ValueError):
        diagnostics.temporal_folds(spark, df, 0, 0.2)
