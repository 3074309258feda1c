import numpy as np
import pandas as pd
import pytest

from tideline.operators import gradients, towers
from tideline.operators.gradients import Node, backward


def check(model, frame, epoch=0, seed=0):
    """Derivatives of some numbers of each weight against differences."""
    rng, weights = np.random.default_rng(seed), model.start()
    weights = {k: v + 0.05 * rng.normal(size=v.shape) for k, v in weights.items()}
    nodes = {k: Node(v) for k, v in weights.items()}
    backward(model.loss(nodes, frame, epoch))
    for name, value in weights.items():
        grad = nodes[name].grad if nodes[name].grad is not None else np.zeros_like(value)
        for at in rng.choice(value.size, min(4, value.size), replace=False):
            moved = {k: v.copy() for k, v in weights.items()}
            out = []
            for step in (1e-5, -1e-5):
                moved[name].ravel()[at] = value.ravel()[at] + step
                out.append(gradients.mean_loss(model, moved, frame, epoch))
            assert grad.ravel()[at] == pytest.approx((out[0] - out[1]) / 2e-5, abs=1e-6), name


def sequences(rng, rows, items, length=6):
    n = rng.integers(0, length + 1, rows)
    return [rng.integers(1, items + 1, k).tolist() for k in n]


def tower_rows(rng, rows, items):
    h = sequences(rng, rows, items)
    return pd.DataFrame({"history": h, "types": [[int(x) for x in rng.integers(0, 3, len(v))] for v in h], "buckets": [[int(x) for x in rng.integers(0, 32, len(v))] for v in h], "target": rng.integers(1, items + 1, rows), "target_type": rng.integers(0, 3, rows), "ts": rng.integers(0, 50, rows), "negatives": [rng.integers(0, items + 1, 5).tolist() for _ in range(rows)]})


def test_tower_derivatives():
    rng = np.random.default_rng(1)
    frame = tower_rows(rng, 8, 9)
    check(towers.Towers(9, width=4, length=5), frame)
    wide = towers.Towers(9, width=4, length=5, hard=(0.0, 0.5), categories=rng.integers(0, 3, (10, 2)), numbers=rng.normal(size=(10, 3)), known=rng.normal(size=(10, 6)))
    check(wide, frame, epoch=1)
    assert wide.frozen(0) == {"known"} and not wide.frozen(2)


def attention_rows(rng, rows, items, length):
    out = []
    for h in sequences(rng, rows, items, length):
        pad = length - len(h)
        out.append(([0] * pad + h, [0] * pad + [int(x) for x in rng.integers(1, 3, len(h))], [-100] * pad + [int(x) for x in np.where(rng.random(len(h)) < 0.7, rng.integers(0, items, len(h)), -100)]))
    return pd.DataFrame(out, columns=["items", "feedback", "labels"])


def test_attention_derivatives_and_masks():
    rng = np.random.default_rng(2)
    model = towers.SelfAttention(7, 5, width=4)
    check(model, attention_rows(rng, 6, 7, 5))
    w = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in model.start().items()}
    p = {k: Node(v) for k, v in w.items()}
    a, f = np.array([[0, 0, 3, 4, 5]]), np.array([[0, 0, 2, 1, 2]])
    b = a.copy()
    b[0, 4] = 6  # what comes later changes nothing before
    assert np.allclose(model.states(p, a, f).value[:, :4], model.states(p, b, f).value[:, :4])
    w["place"][0] += 9.0  # nor does what stands under padding
    assert np.allclose(model.states(p, a, f).value[:, 2:], model.states({k: Node(v) for k, v in w.items()}, a, f).value[:, 2:])
    assert np.isfinite(model.score_all(w, np.zeros((1, 5), dtype=int), np.zeros((1, 5), dtype=int))).all()
    flipped = f.copy()
    flipped[0, 3] = 2  # feedback counts
    assert not np.allclose(model.states(p, a, f).value[:, -1], model.states(p, a, flipped).value[:, -1])


def decoder(rng, items):
    codes = np.array([[0, 0], *(divmod(i, 3) for i in rng.permutation(12)[:items])])
    return towers.CodeDecoder(codes, (4, 3), 4, width=4)


def test_decoder_derivatives_and_beam():
    rng = np.random.default_rng(3)
    model = decoder(rng, 9)
    frame = attention_rows(rng, 5, 9, 4).rename(columns={"items": "history"}).assign(target=rng.integers(1, 10, 5))
    check(model, frame)
    w = {k: v + 0.5 * rng.normal(size=v.shape) for k, v in model.start().items()}
    history, feedback = np.array(frame["history"].tolist()), np.array(frame["feedback"].tolist())
    items, score = model.beam(w, history, feedback, 9, 9)
    p = {k: Node(v) for k, v in w.items()}
    for row in range(5):
        every = []
        for i in range(1, 10):
            z = model.decode(p, *model.encode(p, history[row : row + 1], feedback[row : row + 1]), model.codes[i : i + 1, :-1])
            every.append(sum(float(x.value[0, t] - np.log(np.exp(x.value[0]).sum())) for x, t in zip(z, model.codes[i])))
        assert sorted(items[row]) == list(range(1, 10))
        assert np.allclose(score[row], sorted(every, reverse=True)) and np.allclose([every[i - 1] for i in items[row]], score[row])
    narrow, _ = model.beam(w, history, feedback, 2, 2)
    assert (narrow > 0).all()


@pytest.mark.parametrize("kind", ["static", "mlp", "gate"])
def test_fusion_head_derivatives(kind):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"z": rng.normal(size=(9, 3)).tolist(), "x": rng.normal(size=(9, 2)).tolist(), "label": rng.integers(0, 2, 9)})
    check(towers.FusionHead(kind, 2), frame)


def test_training_lowers_the_loss_and_keeps_the_best(spark):
    rng = np.random.default_rng(5)
    rows = [([0] * (4 - n) + h[:n], [0] * (4 - n) + [2] * n, [-100] * (4 - n) + h[1 : n + 1]) for h in ([int(x) for x in (rng.integers(1, 7) + np.arange(6)) % 6 + 1] for _ in range(200)) for n in (3, 4)]
    rows = [(a, b, [x - 1 if x > 0 else x for x in c]) for a, b, c in rows]  # the next item is the one after
    df = spark.createDataFrame(rows, "items array<long>, feedback array<long>, labels array<long>")
    model, seen = towers.SelfAttention(6, 4, width=8), []
    weights, losses = gradients.train(model, df, 6, rate=0.03, batch=32, checkpoint=lambda e, w, l: seen.append((e, l)))
    assert losses[-1] < 0.5 * losses[0] and seen == list(enumerate(losses))
    best = model.score_all(weights, np.array([[1, 2, 3, 4]]), np.array([[2, 2, 2, 2]])).argmax()
    assert best == 4
    scores = iter([1.0, 3.0, 2.0, 1.0, 9.0])
    _, stopped = gradients.train(model, df, 6, score=lambda w: next(scores), patience=2)
    assert len(stopped) == 4
    assert gradients.train(model, df.limit(0), 2)[1] == []
