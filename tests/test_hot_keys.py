"""Long sessions, busy items and large cells give the same results however they are cut."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tideline.operators import asof, indexes, snapshots, vectors


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows = [(s, 7 if rng.random() < 0.5 else rng.randrange(40), rng.randrange(20) * 86_400_000 + rng.randrange(1000), "clicks", i) for s in range(60) for i in range(rng.randrange(1, 6))]
    rows += [(999, a, a % 9 * 86_400_000, "carts", a) for a in range(300)]  # one long session
    return rows, spark.createDataFrame(rows, "session long, aid long, ts long, type string, event_order long")


def test_pairs_of_blocks_are_all_pairs(spark, log):
    rows, df = log
    held = df.select("session", "aid").distinct()
    items = {}
    for s, a, *_ in rows:
        items.setdefault(s, set()).add(a)
    want = sorted(p for own in items.values() for p in [*permutations(sorted(own), 2), *((a, a) for a in own)])
    for block in (2048, 16):
        assert sorted((r.src, r.dst) for r in indexes.session_pairs(held, [], block).collect()) == want


def rounded(df, score):
    return sorted(tuple(r) for r in df.withColumn(score, F.round(score, 8)).collect())


def test_cut_sessions_change_nothing(log):
    _, df = log
    assert rounded(indexes.item_cf(df, 20, block=16), "score") == rounded(indexes.item_cf(df, 20), "score")
    assert rounded(snapshots.cf_changes(df, block=16), "delta") == rounded(snapshots.cf_changes(df), "delta")


@pytest.mark.parametrize("cell_rows", [1_000_000, 50])
def test_asof_equals_scan(spark, cell_rows):
    rng = random.Random(5)
    states = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(2000), rng.randrange(50)) for _ in range(400)] + [(None, 3, 1), (1, None, 2)]
    more = [(rng.choice([1, 2]), rng.randrange(2000), rng.randrange(50)) for _ in range(40)]
    asked = [(i, rng.choice([1, 1, 1, 2, 4, None]), rng.choice([rng.randrange(2000), None])) for i in range(500)]
    q = spark.createDataFrame(asked, "id long, k long, t long")
    tables = [(spark.createDataFrame(s, "item long, at long, v long").withColumnRenamed("v", n), "item", "at", [n], f"{n}_") for n, s in (("a", states), ("b", more))]
    got = {r.id: (r.a_state_ts, r.a, r.b_state_ts, r.b) for r in asof.backward_asof_all(q, "k", "t", tables, bucket_ms=700, cell_rows=cell_rows).collect()}

    def last(rows, k, t):
        return max(((at, v) for i, at, v in rows if i == k and None not in (k, t, at) and at <= t), default=(None, None))

    assert got == {i: (*last(states, k, t), *last(more, k, t)) for i, k, t in asked}


def test_cells_find_neighbours_in_blocks(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + 0.3 * rng.gauss(0, 1) for c in centres[i % 12]]) for i in range(400)]
    df = spark.createDataFrame(rows, "item_id long, vector array<double>")
    exact = vectors.cosine_topk(df.withColumnRenamed("item_id", "query_id"), df, 5, same=True).select("query_id", "item_id")
    for block in (8192, 20):
        found = vectors.cell_topk(df, 5, probes=4, least_cells=12, block=block)
        assert found.groupBy("query_id").count().filter("count <> 5").count() == 0
        assert exact.join(found, ["query_id", "item_id"]).count() >= 0.9 * exact.count()
    assert vectors.cell_topk(df.limit(0), 5).count() == 0
