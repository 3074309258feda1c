"""Training at size: what a batch, a task and the driver hold and send follows the rows in use, with the results of the plain forms."""

import numpy as np

from tideline.operators import gradients, models, towers
from tideline.operators.gradients import Node, Table, backward, take, total


def test_table_moves_as_adam_over_all_rows():
    rng, rate = np.random.default_rng(0), 0.01
    base = rng.normal(size=(50, 3))
    table, w = Table(base, rate), base.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 300):
        ids = rng.integers(0, 48, 4) if step % 3 else rng.integers(0, 5, (2, 2))
        aim = rng.normal(size=(*ids.shape, 3))
        values, plain = [], Node(w)
        for x in (plain, table):
            off = take(x, ids) - aim
            loss = total(off * off)
            backward(loss)
            values.append(float(loss.value))
        assert np.isclose(*values, atol=1e-6)
        table.move(*table.derivative())
        m, v = 0.9 * m + 0.1 * plain.grad, 0.999 * v + 0.001 * plain.grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    ids, delta = table.changes()
    assert ids.max() < 48 and np.allclose(base[ids] + delta, w[ids], atol=1e-6) and np.array_equal(w[48:], base[48:])


def test_item_features_come_in_blocks(spark):
    df = spark.createDataFrame([(1, [1, 2], [0.5], None), (3, None, [float("nan")], [1.0, 2.0]), (4, [5, 6], None, None), (9, [7, 7], [9.0], None), (None, [8, 8], [1.0], None)], "item_id long, categories array<long>, numbers array<double>, known array<float>")
    got = models._item_arrays(df, np.array([1, 3, 4]))
    assert got["categories"].tolist() == [[0, 0], [1, 2], [0, 0], [5, 6]]
    assert got["numbers"].tolist() == [[0], [0.5], [0], [0]]
    assert got["known"].dtype == np.float32 and got["known"].tolist() == [[0, 0], [0, 0], [1, 2], [0, 0]]


def test_item_vectors_are_made_in_tasks(spark):
    model = towers.Towers(20_000, 4)
    fitted = models.Fitted(model, model.start(), np.arange(20_000) * 3, [])
    df = models.tower_items(spark, fitted)
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("item_id").collect()
    assert [r.item_id for r in rows] == fitted.ids.tolist() and np.array_equal(np.array([r.vector for r in rows]), model.all_vectors(fitted.weights))


class _Counts:
    """Each task adds its rows' mean; only row 2 of the table is used."""

    tables = ("t",)

    def start(self):
        return {"t": np.zeros((5000, 2)), "w": np.zeros(1)}

    def loss(self, p, frame, epoch):
        off = take(p["t"], np.full(len(frame), 2)) - 1.0
        return total(off * off) * (1 / len(frame)) + total(p["w"] * p["w"])


def test_epochs_use_all_cores_and_unused_rows_stay(spark):
    rows = spark.range(0, 4000, 1, 1)
    weights, losses = gradients.train(_Counts(), rows, 3, rate=0.1, batch=10)
    assert losses[-1] < losses[0] and np.flatnonzero(weights["t"].any(axis=1)).tolist() == [2]
    again, _ = gradients.train(_Counts(), rows, 3, rate=0.1, batch=10)
    assert all(np.array_equal(weights[k], again[k]) for k in weights)


def test_later_draws_are_made_for_short_samples_only(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tideline.operators import fusion

    routes = spark.createDataFrame([(1, 5, "category", 1), (1, 6, "popular", 1), (2, 5, "popular", 1)], "sample_id long, aid long, source string, rank long")
    blocked = spark.createDataFrame([(s, a) for s in (1, 2, 3) for a in range(8, 8 + 10 * (s - 1))], "sample_id long, aid long")
    counts = spark.createDataFrame([(a, 1000 if a > 7 else 1 + a) for a in range(1, 29)], "aid long, n long")
    samples = spark.createDataFrame([(1,), (2,), (3,), (None,)], "sample_id long")
    asked, plain = [], fusion.drawn_items
    monkeypatch.setattr(fusion, "drawn_items", lambda rows, c, n, **kw: asked.append((n, rows.count())) or plain(rows, c, n, **kw))
    got = sorted(map(tuple, fusion.hard_negatives(routes, blocked, counts, samples, 6).collect()), key=repr)
    drawn, own = plain(samples, counts, 66, seed=7), F.col("ordinal") < 12
    drawn = drawn.select("sample_id", F.when(own, F.lit(4)).otherwise(F.lit(5)).alias("pool"), F.when(own, F.col("ordinal")).otherwise(F.col("ordinal") + 1_000_000).alias("ordinal"), "aid")
    assert got == sorted(map(tuple, fusion.round_robin(fusion.negative_pools(routes).unionByName(drawn), blocked, 6).collect()), key=repr)
    assert asked[0] == (12, 4) and asked[1][0] == 66 and 0 < asked[1][1] < 4


def test_nearest_is_exact_with_ties_to_the_smaller_row():
    from tideline.operators.vectors import Nearest

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[100:200] = x[:100]
    q = rng.normal(size=(40, 4))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    near = np.round(unit(q) @ unit(x).T, 9)
    want = np.argsort(-near, axis=1, kind="stable")[:, :7]
    r, c, rank, score = Nearest(x, 7)(q)
    assert np.array_equal(c.reshape(40, 7), want) and np.array_equal(rank.reshape(40, 7)[0], np.arange(1, 8))
    assert np.allclose(score.reshape(40, 7), np.take_along_axis(near, want, axis=1), atol=2e-9)
    assert Nearest(x[:3], 7)(q)[1].reshape(40, 3).max() == 2 and Nearest(x, 7)(q[:0]) is None


def _nodes(root):
    seen, todo = {}, [root]
    while todo:
        n = todo.pop()
        if id(n) not in seen:
            seen[id(n)] = n
            todo += n.sources
    return len(seen)


def test_recurrent_user_is_one_node_and_equals_its_steps():
    rng = np.random.default_rng(4)
    p = {k: Node(v) for k, v in towers.gru_start(rng, "g", 3, 4).items()}
    x, mask = Node(rng.normal(size=(5, 12, 3))), rng.random((5, 12)) < 0.4
    mask[0] = False
    got = towers.gru(p, "g", x, mask)
    assert _nodes(got) < 10
    w, u, b = (p[f"g_{c}"].value for c in "wub")
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for row in range(5):
        state = np.zeros(4)
        for t in np.flatnonzero(mask[row]):
            inner, outer = x.value[row, t] @ w + b, state @ u
            reset, keep = np.split(sigmoid(inner[:8] + outer[:8]), 2)
            state = keep * state + (1 - keep) * np.tanh(inner[8:] + reset * outer[8:])
        assert np.allclose(got.value[row], state, atol=1e-12)


def test_attention_and_feed_equal_their_parts():
    rng = np.random.default_rng(5)
    make = lambda *shape: rng.normal(size=shape)
    values, seen = [make(3, 4, 6), make(3, 5, 6), *(make(6, 6) for _ in range(4))], rng.random((3, 4, 5)) < 0.6
    seen[0, 1] = False
    aim, out = make(3, 4, 6), []
    for whole in (True, False):
        a, m, *w = (Node(v) for v in values)
        if whole:
            y = gradients.attention(a, m, tuple(w), 2, seen)
        else:
            split = lambda v: v.reshape(3, -1, 2, 3).swap(1, 2)
            q, k, v = split(a @ w[0]), split(m @ w[1]), split(m @ w[2])
            y = (gradients.softmax((q @ k.swap(2, 3)) * (1 / np.sqrt(3)), seen[:, None]) @ v).swap(1, 2).reshape(3, -1, 6) @ w[3]
        backward(total(y * aim))
        out.append([y.value, *(n.grad for n in (a, m, *w))])
    assert all(np.allclose(g, h, atol=1e-12) for g, h in zip(*out, strict=True))
    values, out = [make(3, 4, 6), make(6, 9), make(9), make(9, 6), make(6)], []
    for whole in (True, False):
        a, w, b, v, c = (Node(x) for x in values)
        y = gradients.feed(a, w, b, v, c) if whole else gradients.gelu(a @ w + b) @ v + c
        backward(total(y * aim))
        out.append([y.value, *(n.grad for n in (a, w, b, v, c))])
    assert all(np.allclose(g, h, atol=1e-12) for g, h in zip(*out, strict=True))
    x = make(100)
    plain = 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))
    assert np.allclose(gradients.gelu(Node(x)).value, plain, atol=1e-12) and not gradients.gelu(Node(np.array([-1e4]))).value.any()


def test_beam_computes_one_step_a_level_and_equals_decoding(monkeypatch):
    rng = np.random.default_rng(6)
    codes = np.array([[0, 0, 0], *([i % 3, i // 3 % 2, i // 6] for i in rng.permutation(15))])
    model = towers.CodeDecoder(codes, (3, 2, 3), 4, width=4, layers=2)
    w = {k: v + 0.5 * rng.normal(size=v.shape) for k, v in model.start().items()}
    history, feedback = rng.integers(0, 16, (5, 4)), rng.integers(0, 3, (5, 4))
    history[0] = 0
    p, want = {k: Node(v) for k, v in w.items()}, np.zeros((5, 15))
    for i in range(1, 16):
        z = model.decode(p, *model.encode(p, history, feedback), np.repeat(codes[i : i + 1, :-1], 5, axis=0))
        want[:, i - 1] = sum(x.value[:, t] - np.log(np.exp(x.value).sum(axis=1)) for x, t in zip(z, codes[i], strict=True))
    monkeypatch.setattr(towers.CodeDecoder, "decode", lambda *a: 1 / 0)  # no prefix is computed again
    items, score = model.beam(w, history, feedback, 15, 15)
    assert np.allclose(score, -np.sort(-want, axis=1)) and np.allclose(np.take_along_axis(want, items - 1, axis=1), score)


def test_codes_are_read_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    codes = spark.createDataFrame([(5, 0, 1), (3, 1, 0), (9, 0, 0), (None, 1, 1)], "item_id long, c1 long, c2 long").coalesce(1)
    samples = spark.range(60).select(F.array(F.lit(0), F.lit(3), F.lit(7)).cast("array<long>").alias("history"), F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<long>").alias("feedback"), F.when(F.col("id") < 50, 5).otherwise(8).cast("long").alias("target"))
    fitted = models.train_decoder(samples, codes.mapInPandas(count, codes.schema), 3, epochs=1)
    assert seen.value == 4 and fitted.ids.tolist() == [3, 5, 9] and fitted.model.codes.tolist() == [[0, 0], [1, 0], [0, 1], [0, 0]] and len(fitted.losses) == 1


def test_numbers_of_items_in_lists_with_nulls(spark):
    rows = spark.createDataFrame([(1, [5, None, 7, 9], 9), (2, None, None), (3, [], 8), (4, [9], 5)], "k int, l array<int>, s int").coalesce(1)
    got = models.numbered(rows, np.array([5, 9]), ("l",), ("s",)).orderBy("k").collect()
    assert [(r.l, r.s) for r in got] == [([1, 0, 0, 2], 2), (None, 0), ([], 0), ([2], 1)]
    assert [(r.l, r.s) for r in models.numbered(rows, np.zeros(0, dtype=np.int64), ("l",), ("s",)).orderBy("k").collect()] == [([0, 0, 0, 0], 0), (None, 0), ([], 0), ([0], 0)]


def test_catalogue_is_packed_in_tasks(spark):
    import pytest
    from pyspark.sql import functions as F

    items = spark.range(0, 30_000).select(F.when(F.col("id") > 5, (F.col("id") * 7919) % 10_007 - 5).alias("item_id"))
    assert models.catalogue(items).tolist() == sorted({(i * 7919) % 10_007 - 5 for i in range(6, 30_000)})
    assert models.catalogue(items.limit(3)).tolist() == []
    with pytest.raises(ValueError):
        models.catalogue(items, 10_006)


def test_two_tower_reads_the_samples_once(spark, monkeypatch):
    from tideline.plans import learning

    schema = "sample_id long, session long, target_aid long, target_type string, target_type_id int, target_ts long, history_aids array<long>, history_type_ids array<int>, history_time_deltas_ms array<long>"
    rows = spark.createDataFrame([(i, i, 5 + i % 3, "clicks", 0, 100 + i, [1, 2] if i % 4 else [], [0, 1] if i % 4 else [], [9, 8] if i % 4 else []) for i in range(40)], schema)
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for batch in frames:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(learning, "read_table", lambda *a: rows.coalesce(1).mapInArrow(count, schema))
    assert sorted(r.item_id for r in learning.two_tower(spark, "").collect()) == [1, 2, 5, 6, 7]
    assert seen.value == 40


def test_mapped_tables_train_as_held_ones(spark, monkeypatch):
    import os

    from tideline.operators import mapped
    from tideline.operators.mapped import Mapped

    rng = np.random.default_rng(8)
    samples = [(i, rng.integers(1, 300, 4).tolist(), [0, 1, 2, 0], [1, 2, 3, 4], int(rng.integers(1, 300)), i % 3, 100 + i) for i in range(300)]
    df = spark.createDataFrame(samples, "sample_id long, history array<long>, types array<long>, buckets array<long>, target long, target_type long, ts long").coalesce(1)
    items = spark.range(1, 10_001).withColumnRenamed("id", "item_id")
    features = spark.createDataFrame([(i, [i % 5, 1], [0.1 * i], [0.01 * i, -1.0, 0.5]) for i in range(1, 300)], "item_id long, categories array<long>, numbers array<double>, known array<float>")
    negatives = spark.createDataFrame([(i, rng.integers(1, 10_000, 6).tolist()) for i in range(300)], "sample_id long, negatives array<long>")
    fit = lambda: models.train_towers(df, items, 4, 4, 0.05, 5, features, negatives, (0.0, 0.5))
    monkeypatch.setattr(gradients, "HELD", 20_000)
    held = fit()
    monkeypatch.setattr(mapped, "LEAST", 0)
    got = fit()
    assert all(isinstance(got.weights[k], Mapped) for k in got.model.tables) and isinstance(got.model.numbers, Mapped) and not len(got.model.known)
    assert got.losses[-1] < got.losses[0] and abs(got.losses[-1] - held.losses[-1]) < 0.3
    unused = np.setdiff1d(np.arange(10_001), [0, *(x for s in samples for x in (*s[1], s[4])), *(x for r in negatives.collect() for x in r.negatives)])
    assert np.allclose(got.weights["item"][unused], held.weights["item"][unused], atol=1e-7)  # rows not in use stay
    files = {f for f in os.listdir(got.room.folder) if "-" in f}
    assert not files and len(os.listdir(got.room.folder)) == len(got.model.tables) + 2  # the tables after the last epoch, and the features
    x = models._all_vectors(spark, got)
    assert isinstance(x, Mapped) and np.allclose(x, got.model.all_vectors(got.weights), atol=1e-12)
    got.discard()
    assert not os.path.exists(got.room.folder)


class _Aims(_Counts):
    def start(self, room=None):
        p = super().start()
        if room:
            p["t"] = room.array(p["t"].shape)
        return p

    def loss(self, p, frame, epoch):
        off = take(p["t"], frame["id"].to_numpy() % 4999) - 1.0
        return total(off * off) * (1 / len(frame)) + total(p["w"] * p["w"])


def test_mapped_epoch_equals_one_summed_by_blocks(spark):
    from tideline.operators.mapped import Room
    from tideline.session import ensure_shared_dir, settle

    rows = settle(spark.range(0, 4000, 1, 8))
    room = Room(ensure_shared_dir(spark).removeprefix("file:").replace("//", "/"))
    held, losses = gradients.train(_Aims(), rows.repartition(12), 3, rate=0.1, batch=10)
    got, again = gradients.train(_Aims(), rows.repartition(12), 3, rate=0.1, batch=10, room=room)
    assert np.allclose(losses, again, rtol=1e-3) and abs(got["t"][:4000].mean() - held["t"][:4000].mean()) < 0.01 and got["t"][:4000].all() and not got["t"][4000:].any()  # rows are in other tasks
    room.remove()


def test_place_of_a_row_is_that_of_the_nearest():
    from tideline.operators.vectors import Nearest, place_of

    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 4)), 1)
    x[100:200] = x[:100]
    q, row = rng.normal(size=(60, 4)), rng.integers(0, 400, 60)
    r, c, rank, _ = Nearest(x, 50)(q)
    want = [next(iter(rank[(r == i) & (c == row[i])]), 0) for i in range(60)]
    assert place_of(x, q, row, 50, block=64).tolist() == want and 0 in want and max(want) > 0
