"""Queries of the items plan over small tables of their own: no item, vector or session is left out."""

import datetime as dt

import numpy as np
import pytest

from tideline.operators import embeddings
from tideline.plans import items


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event(i, user, item, minute):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), user, "view", 40.0, f'{{"k": {item}}}')


def test_beam_narrow_holds_all_items(spark, tmp_path):
    # 0, 140 and 280 share label, item_id % 5 and item_id div 7 % 4
    write(spark, tmp_path, "embeddings", [(i, [1.0, float(i)], label) for i, label in ((0, 3), (140, 3), (280, 3), (1, 4))], "vec_id long, embedding array<float>, label int")
    rows = [event(i, 70, item, i) for i, item in enumerate((0, 280, 140, 280, 0, 280))] + [event(9, 71, 1, 9), event(10, 72, 999, 10)]
    write(spark, tmp_path, "events", rows, EVENTS)
    got = {}
    for r in items.QUERIES["beam_narrow"](spark, str(tmp_path)).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    assert set(got) == {70, 71}
    assert got[70] == [280, 0, 140, 1] and set(got[71]) == {0, 1, 140, 280}


def test_warm_start_holds_all_items(spark, tmp_path):
    one = [0.5] * 64
    write(spark, tmp_path, "embeddings", [(0, one, 1)], "vec_id long, embedding array<float>, label int")
    write(spark, tmp_path, "events_all", [(1, 5, 2_000, 7), (1, 5, 70_000, 8), (2, 6, None, 9), (2, 6, 70_000, 9)], "session long, visitorid long, aid long, ts long")
    rows = [(70_000, one, 1), (70_000, one, 2), (90_000, one, 1), (2_000, one, 1), (2_000, [float("nan")] * 64, 2), (None, one, 1)]
    write(spark, tmp_path, "item2vec_embeddings", rows, "item_ids long, vectors array<float>, epoch int")
    got = sorted(tuple(r) for r in items.QUERIES["warm_start"](spark, str(tmp_path)).collect())
    assert got == [(2_000, False, 64), (70_000, True, 64), (90_000, True, 64)]


def test_svd_embedding_keeps_sessions_apart(spark, tmp_path):
    # sessions of visitors 0, 97 and 194 are equal modulo 97; each holds items that no other holds, so two dimensions tell the larger two apart
    rows = [event(10 * v + i, 97 * v, 10 * v + i, i) for v in range(3) for i in range(4 - v)]
    write(spark, tmp_path, "events", rows, EVENTS)
    got = {r.item_id: np.array(r.vector) for r in items.QUERIES["svd_embedding"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 10, 11, 12, 20, 21]
    assert abs(got[0] @ got[3]) == pytest.approx(1, abs=1e-6) and abs(got[10] @ got[12]) == pytest.approx(1, abs=1e-6)
    assert got[0] @ got[10] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("shape", [(7, 40), (40, 7), (6, 6)])
def test_svd_of_either_shape(spark, shape):
    x = np.random.default_rng(5).normal(size=shape)
    cells = spark.createDataFrame([(r * 10, c * 10, float(v)) for (r, c), v in np.ndenumerate(x)], "row long, col long, value double")
    got = {r.item_id: np.array(r.vector) for r in embeddings.svd(cells, "row", "col", "value", 4).collect()}
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :4] * s[:4]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    found = np.stack([got[r * 10] for r in range(shape[0])])
    assert np.allclose(np.abs(found @ found.T), np.abs(want @ want.T), atol=1e-6)


def test_sampled_auc_takes_vectors_of_the_aids(spark, tmp_path):
    def towards(d):
        return [1.0 if i == d else 0.0 for i in range(64)]

    # aids 70_000 and 70_400 are equal modulo 400 and point to opposite sides of the others
    write(spark, tmp_path, "item2vec_embeddings", [(70_000, towards(0), 1), (70_400, [-x for x in towards(0)], 1), *((80_000 + i, towards(1 + i), 1) for i in range(20))], "item_ids long, vectors array<float>, epoch int")
    write(spark, tmp_path, "embeddings", [(i, towards(i % 64), 1) for i in range(400)], "vec_id long, embedding array<float>, label int")
    write(spark, tmp_path, "validation_samples", [(1, [70_000], 70_000), (2, [70_000], 70_400), (2, [70_000], 70_400), (3, [99_999], 70_000)], "sample_id long, history_aids array<long>, target_aid long")
    got = items.QUERIES["sampled_auc"](spark, str(tmp_path)).first()
    assert got.sessions == 2 and got.gauc == pytest.approx(0.5, abs=0.01)
