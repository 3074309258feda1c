import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.bitemporal import PersistentTree, as_known, clean_states, newest_states
from tideline.operators.events import IDENTITY, counted_events, typed_events
from tideline.operators.skew import heavy_keys, skewed_aggregate, skewed_join


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    kinds = ["clicks", " Clicks", "VIEW", "addtocart", "carts ", "orders", "transaction", "impression", "", None]
    rows = [(rng.choice([None, rng.randrange(50)]), rng.randrange(40), rng.choice([7, 7, 7, None, rng.randrange(200)]), rng.randrange(10**6), rng.choice(kinds), rng.choice([None, 1.0, 2.5]), i) for i in range(4000)]
    rows += [(*r[:6], 10_000 + i) for i, r in enumerate(rows[:1500])] + [(1, 1, 7, 1, "view", None, 20_000 + i) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "session long, visitorid long, aid long, ts long, type string, transactionid double, event_order long").selectExpr("*", "1 AS events", "2 AS __hot")


MAP = {"clicks": "clicks", "view": "clicks", "carts": "carts", "addtocart": "carts", "orders": "orders", "transaction": "orders"}


def brute(rows):
    seen = {(s, v, a, t, MAP[k.strip().lower()], x) for s, v, a, t, k, x, _ in rows if a is not None and k is not None and k.strip().lower() in MAP}
    return Counter((a, k) for _, _, a, _, k, _ in seen), seen


@pytest.mark.parametrize("share", [0.5, 0.05, 0.002])
def test_counts_equal_brute_force(spark, log, share):
    rows, df = log
    got = skewed_aggregate(typed_events(df), ["aid", "type"], {"events": ("count", None)}, distinct_on=IDENTITY, share=share).collect()
    assert {(r.aid, r.type): r.events for r in got} == dict(brute(rows)[0])
    assert counted_events(df).count() == len(brute(rows)[1])


def test_aggregates_with_null_keys(spark, log):
    rows, df = log
    got = {r.aid: (r.n, r.top, r.low, r.total) for r in skewed_aggregate(df, ["aid"], {"n": ("count", None), "top": ("max", "ts"), "low": ("min", "ts"), "total": ("sum", "ts")}, share=0.1).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[2], []).append(r[3])
    assert got == {k: (len(v), max(v), min(v), sum(v)) for k, v in want.items()}


def test_heavy_keys_are_bounded(spark, log):
    _, df = log
    found = df.select("aid", F.xxhash64("aid").alias("__h")).distinct().join(heavy_keys(df, ["aid"], share=0.05), "__h").collect()
    assert 7 in {r.aid for r in found} and len(found) <= 40
    assert heavy_keys(df.limit(0), ["aid"]).count() == 0
    assert skewed_aggregate(df.limit(0), ["aid"], {"n": ("count", None)}).count() == 0
    with pytest.raises(ValueError):
        skewed_aggregate(df, ["aid"], {"n": ("median", "ts")})


def test_no_cold_key_fills_a_task(spark):
    # 40 keys just above the bound of 1 / (4 * 8 tasks), the rest below
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        keys = [k for k in range(10) for _ in range(4000)] + [100 + i for i in range(60_000)]
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        heavy = {r["__h"] for r in heavy_keys(df, ["k"]).collect()}
        hashed = {r.k: r.h for r in df.distinct().select("k", F.xxhash64("k").alias("h")).collect()}
        assert {k for k, h in hashed.items() if h in heavy} == set(range(10))
        assert skewed_aggregate(df, ["k"], {"n": ("count", None)}).agg(F.sum("n"), F.count("k")).first()[:] == (100_000, 60_010)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, log, how):
    _, df = log
    names = spark.createDataFrame([(i, f"n{i}") for i in range(0, 200, 2)] + [(7, "seven"), (None, "none")], "aid long, name string")
    a = sorted(map(str, skewed_join(df.select("aid", "ts"), names, ["aid"], how, share=0.1).select("aid", "ts", "name").collect()))
    assert a == sorted(map(str, df.select("aid", "ts").join(names, "aid", how).select("aid", "ts", "name").collect()))


@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_tree_equals_scan(data):
    n = data.draw(st.integers(1, 40))
    positions = np.array(data.draw(st.lists(st.integers(0, n - 1), min_size=1, max_size=60)), dtype=np.int64)
    tree = PersistentTree(positions, n)
    roots = np.array(data.draw(st.lists(st.integers(-1, len(positions) - 1), min_size=1, max_size=30)), dtype=np.int64)
    keys = np.array([data.draw(st.integers(-1, n - 1)) for _ in roots], dtype=np.int64)
    for root, key, got in zip(roots, keys, tree.floor(roots, keys)):
        below = [(positions[v], v) for v in range(root + 1) if positions[v] <= key] if key >= 0 else []
        want = max(below)[1] if below else -1
        assert got == want


def scan(queries, states):
    out = []
    for q, item, known in queries:
        fit = [(t, v) for t, i, v, r in states if None not in (t, i, r) and item is not None and known is not None and i == item and r <= known and t <= known]
        out.append((q, *(max(fit, key=lambda x: x[0]) if fit else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("rows", "points"), [(50_000, 200_000), (40, 200_000), (200, 10)])
def test_known_state_equals_scan(spark, rows, points):
    rng = random.Random(3)
    states, used = [], set()
    for _ in range(1500):
        item, t = rng.choice([1, 1, 1, rng.randrange(30)]), rng.randrange(5000)
        if (item, t) not in used:
            used.add((item, t))
            states.append((t, item, rng.randrange(9), t + rng.choice([0, 0, rng.randrange(3000)])))
    states += [(None, 1, 2, 3), (3, None, 1, 5), (9_000, 1, 4, None)]
    queries = [(i, rng.choice([1, 1, None, rng.randrange(35)]), rng.choice([None, rng.randrange(8000)])) for i in range(400)] + [(0, 1, 2500), (0, 1, 2500)]
    q = spark.createDataFrame(queries, "sample_id long, itemid long, target_ts long").selectExpr("*", "1 AS value", "2 AS timestamp")
    s = spark.createDataFrame(states, "timestamp long, itemid long, value long, recorded_ts long").selectExpr("*", "5 AS target_ts")
    got = as_known(q, s, ["itemid"], ["value"], tree_rows=rows, tree_points=points).select("sample_id", "state_ts", "state_value")
    assert sorted(map(tuple, got.collect()), key=str) == scan(queries, states)


def test_known_state_of_nothing(spark):
    q = spark.createDataFrame([(1, 5, 10)], "sample_id long, itemid long, target_ts long")
    s = spark.createDataFrame([(1, 5, 3, 2)], "timestamp long, itemid long, value long, recorded_ts long")
    assert as_known(q.limit(0), s, ["itemid"], ["value"]).count() == 0
    assert as_known(q, s.limit(0), ["itemid"], ["value"]).first().state_ts is None
    assert as_known(q, s, ["itemid"], ["value"]).first().state_value == 3


def test_contradictions_go_whenever_recorded(spark):
    rows = [(1, 5, 3, 10), (1, 5, 3, 7), (2, 5, 4, 8), (2, 5, 6, 90), (3, None, 1, 3), (None, 5, 1, 3), (4, 5, None, 5), (9, 6, 1, None)]
    df = spark.createDataFrame(rows, "timestamp long, itemid long, v long, recorded_ts long")
    clean = clean_states(df, ["itemid"], "v")
    assert {tuple(r) for r in clean.collect()} == {(5, 1, 3, 7), (6, 9, 1, None)}
    assert {(r.itemid, r.v) for r in newest_states(clean, ["itemid"], "v").collect()} == {(5, 3), (6, 1)}
