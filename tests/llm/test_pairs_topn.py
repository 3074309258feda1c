import math
import random
from collections import Counter
from itertools import combinations

import pytest

from tideline.llm import pairs
from tideline.llm.pairs import item_codes, pair_counts
from tideline.llm.topn import top_n


def brute_pairs(rows):
    held = {}
    for s, a in rows:
        if s is not None and a is not None:
            held.setdefault(s, set()).add(a)
    single = Counter(a for items in held.values() for a in items)
    both = Counter(p for items in held.values() for p in combinations(sorted(items), 2))
    return len(held), single, both


@pytest.fixture(scope="module")
def log():
    rng = random.Random(1)
    rows = [(s, rng.choice([rng.randrange(8), rng.randrange(300) - 150])) for s in range(120) for _ in range(rng.randrange(1, 9))]
    rows += [(7777, 10**12 + i) for i in range(70)] + [(8888, i - 20) for i in range(50)]  # long records
    rows += [(None, 1), (1, None), (None, None)] + rows[:50]
    return rows


@pytest.mark.parametrize(("block", "broadcast"), [(256, 500_000), (4, 0)])
def test_pairs_equal_brute_force(spark, log, block, broadcast, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_BROADCAST", broadcast)
    log = log + [(s, 10**9) for s in range(120)]  # an item of nearly all records
    total, single, both = brute_pairs(log)
    df = spark.createDataFrame(log, "session long, aid long").selectExpr("*", "1 AS item_a", "2 AS code", "3 AS n_ab")
    got = {(r.item_a, r.item_b): r for r in pair_counts(df, "session", "aid", block=block).collect()}
    assert {k: r.n_ab for k, r in got.items()} == dict(both)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.records) == (single[a], single[b], total)
        assert r.lift == pytest.approx(r.n_ab * total / (single[a] * single[b]))
        table = [r.n_ab + 0.5, single[a] - r.n_ab + 0.5, single[b] - r.n_ab + 0.5, total - single[a] - single[b] + r.n_ab + 0.5]
        assert r.log_odds == pytest.approx(math.log(table[0] * table[3] / (table[1] * table[2])))


def test_limits_drop_no_pair_that_meets_them(spark, log):
    total, single, both = brute_pairs(log)
    df = spark.createDataFrame(log, "session long, aid long")
    got = {(r.item_a, r.item_b) for r in pair_counts(df, "session", "aid", min_count=3, min_lift=2.0, block=5).collect()}
    assert got == {(a, b) for (a, b), n in both.items() if n >= 3 and n * total / (single[a] * single[b]) >= 2.0}


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "session long, aid long")
    assert pair_counts(empty, "session", "aid").count() == 0
    assert pair_counts(spark.createDataFrame([(1, 5), (2, 5), (None, 6)], "session long, aid long"), "session", "aid").count() == 0


def test_item_codes_are_dense_and_ordered(spark):
    ids = [random.Random(3).randrange(-(10**15), 10**15) for _ in range(500)]
    got = item_codes(spark.createDataFrame([(i,) for i in set(ids)], "i long"), "i").orderBy("i").collect()
    assert [r.code for r in got] == list(range(len(set(ids))))


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or not math.isfinite(s):
            continue
        best[g, i] = max(best.get((g, i), -math.inf), s)
    out = set()
    for g in {g for g, _ in best}:
        order = sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))
        out |= {(g, i, s, r) for r, (s, i) in enumerate(order[:n], 1)}
    return out


@pytest.mark.parametrize("heavy", [20_000, 50])
def test_top_n_equals_brute_force(spark, heavy):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, rng.randrange(40)]), rng.randrange(60), rng.choice([0.5, 0.25, round(rng.random(), 2), math.nan, math.inf, -math.inf, None])) for _ in range(3000)]
    rows += [(None, 1, 0.1), (1, None, 0.2), (99, 3, None)] + rows[:100]
    df = spark.createDataFrame(rows, "sample_id long, aid long, final_score double").selectExpr("*", "1 AS rank", "2 AS count")
    got = {(r.sample_id, r.aid, r.final_score, r.rank) for r in top_n(df, "sample_id", "aid", "final_score", 10, heavy_rows=heavy).collect()}
    assert got == brute_top(rows, 10)


def test_top_n_of_nothing(spark):
    empty = spark.createDataFrame([], "sample_id long, aid long, final_score double")
    assert top_n(empty, "sample_id", "aid", "final_score", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(empty, "sample_id", "aid", "final_score", 0)
