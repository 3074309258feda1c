"""Reverse-mode derivatives over NumPy arrays, as much as the sequence models need, and their training on Spark.

A :class:`Node` holds a value and how its derivative goes back to the nodes it was made from; :func:`backward` walks them from a loss. Training
broadcasts the weights, each task runs mini-batches of its rows with Adam, and the tasks' weights are averaged by rows after each epoch. Of a
:class:`Table` a task holds and sends only the rows that its batches use; tasks run side by side, their changes are summed in tasks by blocks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.mapped import Mapped, Room, discard
from tideline.session import release, settle

#: Adam's decays and the number that keeps it from dividing by zero; rows of a table whose changes go in one message.
FIRST, SECOND, TINY, BLOCK = 0.9, 0.999, 1e-8, 4096
#: Bytes of rows in use that a task with mapped tables holds, for which there are more tasks if they use all tables together.
HELD = 3 << 27
#: Stands for a block whose changes are in files.
FILED = -1

class Node:
    """A value in a computation; ``grad`` after :func:`backward`."""

    __slots__ = ("value", "grad", "sources", "back")

    def __init__(self, value: np.ndarray, sources: tuple[Node, ...] = (), back: Callable | None = None):
        self.value, self.grad, self.sources, self.back = value, None, sources, back

    def __add__(self, other) -> Node:
        other = node(other)
        return Node(self.value + other.value, (self, other), lambda g: (g, g))

    def __sub__(self, other) -> Node:
        other = node(other)
        return Node(self.value - other.value, (self, other), lambda g: (g, -g))

    def __mul__(self, other) -> Node:
        other = node(other)
        return Node(self.value * other.value, (self, other), lambda g: (g * other.value, g * self.value))

    def __matmul__(self, other: Node) -> Node:
        if other.value.ndim == 2 and self.value.ndim > 2:  # one product over all rows
            x, w = self.value.reshape(-1, self.value.shape[-1]), other.value

            def back(g):
                g = g.reshape(-1, w.shape[1])
                return (g @ w.T).reshape(self.value.shape), x.T @ g

            return Node((x @ w).reshape(*self.value.shape[:-1], w.shape[1]), (self, other), back)
        return Node(self.value @ other.value, (self, other), lambda g: (g @ np.swapaxes(other.value, -1, -2), np.swapaxes(self.value, -1, -2) @ g))

    def __getitem__(self, at) -> Node:
        def back(g):
            out = np.zeros_like(self.value)
            out[at] = g
            return (out,)

        return Node(self.value[at], (self,), back)

    def reshape(self, *shape: int) -> Node:
        return Node(self.value.reshape(shape), (self,), lambda g: (g.reshape(self.value.shape),))

    def swap(self, a: int, b: int) -> Node:
        """Two axes exchanged."""
        return Node(np.swapaxes(self.value, a, b), (self,), lambda g: (np.swapaxes(g, a, b),))


def node(x) -> Node:
    """``x`` as a node; numbers and arrays are constants."""
    return x if isinstance(x, Node) else Node(np.asarray(x, dtype=np.float64))


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A derivative summed over the axes along which its value was repeated."""
    if g.shape == shape:
        return g
    if g.ndim > len(shape):
        g = g.reshape(-1, *g.shape[g.ndim - len(shape) :]).sum(axis=0)
    stretched = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axis=stretched, keepdims=True) if stretched else g


def backward(root: Node) -> None:
    """Derivatives of a scalar with respect to all nodes it was made from."""
    order, seen, stack = [], set(), [(root, False)]
    while stack:
        n, done = stack.pop()
        if done:
            order.append(n)
        elif id(n) not in seen:
            seen.add(id(n))
            stack += [(n, True), *((s, False) for s in n.sources)]
    root.grad = np.ones_like(root.value)
    for n in reversed(order):
        if n.back is None or n.grad is None:
            continue
        for source, g in zip(n.sources, n.back(n.grad), strict=True):
            g = _fit(g, source.value.shape)
            source.grad = g if source.grad is None else source.grad + g


class Table(Node):
    """Weights of which a batch uses few rows, with their Adam: ``base`` is only read, rows in use are copied.

    A row without a derivative still moves by what Adam remembers. These moves are made up when the row is used next, by their sum: after
    ``j`` steps they are ``m / sqrt(v) * (FIRST / sqrt(SECOND)) ** j`` times a factor of the step's number only. So a batch costs what its
    rows do, and the weights are those of Adam over the whole table.
    """

    __slots__ = ("base", "rate", "slot", "ids", "own", "first", "second", "at", "used", "step", "found", "fixed")

    def __init__(self, base: np.ndarray, rate: float, fixed: bool = False):
        super().__init__(base)
        self.fixed = fixed  # rows are read from ``base`` and don't move
        self.base, self.rate, self.used, self.step, self.found = base, rate, 0, 0, []
        self.slot = np.full(len(base), -1, dtype=np.int32)
        self._room(1024)

    def _room(self, rows: int) -> None:
        old, n = (self.ids, self.own, self.first, self.second, self.at) if self.used else None, self.used
        width = self.base.shape[1]
        self.ids, self.at = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        self.own, self.first, self.second = (np.zeros((rows, width), dtype=self.base.dtype) for _ in range(3))
        if old:
            for new, kept in zip((self.ids, self.own, self.first, self.second, self.at), old, strict=True):
                new[:n] = kept[:n]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Places of the rows ``ids`` among those in use, all of them as after the steps so far."""
        fresh = np.unique(ids[self.slot[ids] < 0])
        if len(fresh):
            end = self.used + len(fresh)
            if end > len(self.ids):
                self._room(max(end, 2 * len(self.ids)))
            self.slot[fresh] = np.arange(self.used, end)
            self.ids[self.used : end], self.own[self.used : end], self.at[self.used : end] = fresh, self.base[fresh], self.step
            self.used = end
        places = self.slot[ids]
        late = places[self.at[places] < self.step]
        if len(late):
            self._catch_up(np.unique(late))
        return places

    def _catch_up(self, places: np.ndarray) -> None:
        at = self.at[places]
        gap = (self.step - at)[:, None].astype(np.float64)
        ahead = _ahead(self.step)
        share = ahead[at][:, None] - (FIRST / np.sqrt(SECOND)) ** gap * ahead[self.step]
        tiny = np.maximum(TINY * np.sqrt(1 - SECOND**at), 1e-300)[:, None]
        self.own[places] -= self.rate * self.first[places] / (np.sqrt(self.second[places]) + tiny) * share
        self.first[places] *= FIRST**gap
        self.second[places] *= SECOND**gap
        self.at[places] = self.step

    def derivative(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and summed derivatives of the rows that the last batch used."""
        places, which = np.unique(np.concatenate([p for p, _ in self.found]) if self.found else np.zeros(0, dtype=np.int64), return_inverse=True)
        out = np.zeros((0, self.base.shape[1]))
        if len(places):
            out = _gathered(which, np.concatenate([g for _, g in self.found]), len(places))
        self.found = []
        return places, out

    def move(self, places: np.ndarray, g: np.ndarray) -> None:
        """One step of Adam, ``g`` being the derivatives of the rows at ``places``."""
        self.step += 1
        first, second = FIRST * self.first[places] + (1 - FIRST) * g, SECOND * self.second[places] + (1 - SECOND) * g * g
        self.first[places], self.second[places], self.at[places] = first, second, self.step
        self.own[places] -= self.rate * (first / (1 - FIRST**self.step)) / (np.sqrt(second / (1 - SECOND**self.step)) + TINY)

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows used so far, in their order, and how they differ from ``base``."""
        parts = list(self.parts())
        return np.concatenate([np.zeros(0, dtype=np.int64), *(i for i, _ in parts)]), np.concatenate([np.zeros((0, self.base.shape[1])), *(d for _, d in parts)])

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`changes` in parts of at most ``BLOCK`` rows."""
        order = np.argsort(self.ids[: self.used])
        for i in range(0, len(order), BLOCK):
            ids = self.ids[order[i : i + BLOCK]]
            places = self.rows(ids)
            yield ids, self.own[places] - self.base[ids]


_AHEAD = [np.zeros(0)]


def _ahead(step: int) -> np.ndarray:
    """For each step up to ``step``, the sum over all later ones of what a remembered derivative still moves, in units of ``m / sqrt(v)``."""
    if len(_AHEAD[0]) <= step:
        top, c = 2 * step + 1024, FIRST / np.sqrt(SECOND)
        k = np.arange(1, top + 1025, dtype=np.float64)  # c to the power 1024 is 0 beside the others
        factor = (np.sqrt(1 - SECOND**k) / (1 - FIRST**k)).tolist()
        out, last = np.zeros(len(factor)), 0.0
        for i in range(len(factor) - 1, -1, -1):
            last = c * (factor[i] + last)
            out[i] = last
        _AHEAD[0] = out[:top]
    return _AHEAD[0]


def _gathered(ids: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """``[rows, width]``: the sums of the rows of ``g`` (``[len(ids), width]``) by ``ids``."""
    width = g.shape[1]
    at = (ids[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, weights=g.ravel(), minlength=rows * width).reshape(rows, width)


def take(table: Node, ids: np.ndarray) -> Node:
    """Rows of a table."""
    if isinstance(table, Table):
        ids = np.asarray(ids)
        if table.fixed:
            return Node(np.asarray(table.base[ids], dtype=np.float64), (), lambda g: ())
        places = table.rows(ids.ravel())

        def keep(g):
            table.found.append((places, g.reshape(len(places), -1)))
            return ()

        return Node(table.own[places].astype(np.float64, copy=False).reshape(*ids.shape, -1), (), keep)

    def back(g):
        return (_gathered(np.asarray(ids).ravel(), g.reshape(-1, table.value.shape[1]), len(table.value)),)

    return Node(np.asarray(table.value[ids], dtype=np.float64), (table,), back)


def sigmoid(a: Node) -> Node:
    s = 1 / (1 + np.exp(-np.clip(a.value, -30, 30)))
    return Node(s, (a,), lambda g: (g * s * (1 - s),))


def tanh(a: Node) -> Node:
    t = np.tanh(a.value)
    return Node(t, (a,), lambda g: (g * (1 - t * t),))


def softplus(a: Node) -> Node:
    return Node(np.logaddexp(0, a.value), (a,), lambda g: (g / (1 + np.exp(-np.clip(a.value, -30, 30))),))


def relu(a: Node) -> Node:
    return Node(np.maximum(a.value, 0), (a,), lambda g: (g * (a.value > 0),))


def curve(x: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The common approximation of gelu by a hyperbolic tangent, and what takes its derivative back. ``(1 + tanh(u)) / 2`` is the sigmoid of ``2 u``."""
    c, square = 2 * np.sqrt(2 / np.pi), x * x
    s = square * (-0.044715 * c)
    s -= c
    s *= x
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
    s += 1
    np.divide(1.0, s, out=s)

    def back(g):
        d = square * (3 * 0.044715 * c)
        d += c
        d *= x
        d *= 1 - s
        d += 1
        d *= s
        d *= g
        return d

    return x * s, back


def gelu(a: Node) -> Node:
    value, back = curve(a.value)
    return Node(value, (a,), lambda g: (back(g),))


def feed(a: Node, w: Node, b: Node, v: Node, c: Node) -> Node:
    """``gelu(a @ w + b) @ v + c`` as one node."""
    x = a.value.reshape(-1, a.value.shape[-1])
    inner = x @ w.value
    inner += b.value
    act, slope = curve(inner)

    def back(g):
        g = g.reshape(-1, g.shape[-1])
        d = slope(g @ v.value.T)
        return (d @ w.value.T).reshape(a.value.shape), x.T @ d, d.sum(axis=0), act.T @ g, g.sum(axis=0)

    out = act @ v.value
    out += c.value
    return Node(out.reshape(*a.value.shape[:-1], -1), (a, w, b, v, c), back)


def shares(x: np.ndarray, allowed: np.ndarray | None) -> np.ndarray:
    """Softmax along the last axis, 0 where not ``allowed``; changes ``x``."""
    if allowed is not None:
        np.copyto(x, -np.inf, where=~allowed)
    top = x[..., 0].copy()
    for i in range(1, x.shape[-1]):
        np.maximum(top, x[..., i], out=top)
    top[~np.isfinite(top)] = 0.0
    x -= top[..., None]
    np.exp(x, out=x)
    x *= (1 / np.maximum(_last(x), 1e-300))[..., None]
    return x


def _last(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis; short ones go faster as a product."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1])).reshape(x.shape[:-1])


def attention(a: Node, memory: Node, weights: tuple[Node, Node, Node, Node], heads: int, allowed: np.ndarray) -> Node:
    """Attention of ``a`` (``[rows, steps, width]``) over ``memory`` by the weights of queries, keys, values and the output, as one node."""
    (rows, steps, width), (q_w, k_w, v_w, o_w) = a.value.shape, (w.value for w in weights)
    x, m, scale = a.value.reshape(-1, width), memory.value.reshape(-1, width), 1 / np.sqrt(width // heads)
    split = lambda v: v.reshape(rows, -1, heads, width // heads).swapaxes(1, 2)
    joined = lambda v: v.swapaxes(1, 2).reshape(-1, width)
    q, k, v = split(x @ q_w), split(m @ k_w), split(m @ v_w)
    z = q @ k.swapaxes(2, 3)
    z *= scale
    share = shares(z, allowed[:, None])
    mixed = joined(share @ v)

    def back(g):
        g = g.reshape(-1, width)
        y = split(g @ o_w.T)
        d = y @ v.swapaxes(2, 3)
        d -= np.einsum("rhij,rhij->rhi", d, share)[..., None]
        d *= share
        d *= scale
        dq, dk, dv = joined(d @ k), joined(d.swapaxes(2, 3) @ q), joined(share.swapaxes(2, 3) @ y)
        return (dq @ q_w.T).reshape(a.value.shape), (dk @ k_w.T + dv @ v_w.T).reshape(memory.value.shape), x.T @ dq, m.T @ dk, m.T @ dv, mixed.T @ g

    return Node((mixed @ o_w).reshape(a.value.shape), (a, memory, *weights), back)


def softmax(a: Node, allowed: np.ndarray | None = None) -> Node:
    """Along the last axis; where not ``allowed`` 0, and 0 everywhere in a row that allows nothing."""
    x = a.value if allowed is None else np.where(allowed, a.value, -np.inf)
    top = x.max(axis=-1, keepdims=True)
    e = np.exp(x - np.where(np.isfinite(top), top, 0.0))
    p = e / np.maximum(e.sum(axis=-1, keepdims=True), 1e-300)
    return Node(p, (a,), lambda g: (p * (g - (g * p).sum(axis=-1, keepdims=True)),))


def layer_norm(a: Node, gain: Node, bias: Node) -> Node:
    width = a.value.shape[-1]
    x = a.value - (_last(a.value) / width)[..., None]
    scale = (1 / np.sqrt(_last(x * x) / width + 1e-5))[..., None]
    x *= scale

    def back(g):
        d, moved = g * gain.value, g * x
        slant = (moved @ gain.value / width)[..., None]
        d -= (_last(d) / width)[..., None]
        d -= x * slant
        d *= scale
        return d, moved, g

    return Node(x * gain.value + bias.value, (a, gain, bias), back)


def unit(a: Node) -> Node:
    """Rows of length 1."""
    length = np.maximum(np.linalg.norm(a.value, axis=-1, keepdims=True), 1e-12)
    x = a.value / length
    return Node(x, (a,), lambda g: ((g - x * (g * x).sum(axis=-1, keepdims=True)) / length,))


def concat(parts: list[Node]) -> Node:
    """Put together along the last axis."""
    ends = np.cumsum([p.value.shape[-1] for p in parts])[:-1]
    return Node(np.concatenate([p.value for p in parts], axis=-1), tuple(parts), lambda g: tuple(np.split(g, ends, axis=-1)))


def stack(parts: list[Node]) -> Node:
    """Put together along a new second axis."""
    return Node(np.stack([p.value for p in parts], axis=1), tuple(parts), lambda g: tuple(g[:, i] for i in range(len(parts))))


def total(a: Node, axis: int | None = None) -> Node:
    """Sum over an axis, or of all."""
    return Node(a.value.sum(axis=axis), (a,), lambda g: (np.broadcast_to(g if axis is None else np.expand_dims(g, axis), a.value.shape),))


def cross_entropy(logits: Node, target: np.ndarray, weight: np.ndarray, allowed: np.ndarray | None = None) -> Node:
    """Weighted mean of ``-log softmax`` at the targets, over the rows of the last axis but one; rows of weight 0 don't count."""
    x = logits.value if allowed is None else np.where(allowed, logits.value, -np.inf)
    x = x - x.max(axis=-1, keepdims=True)
    log = x - np.log(np.exp(x).sum(axis=-1, keepdims=True))
    at = np.expand_dims(target, -1)
    whole = max(float(weight.sum()), 1e-12)
    loss = -(np.take_along_axis(log, at, axis=-1)[..., 0] * weight)[weight > 0].sum() / whole

    def back(g):
        d = np.exp(log)
        np.put_along_axis(d, at, np.take_along_axis(d, at, axis=-1) - 1, axis=-1)
        return (g * np.where(weight > 0, weight, 0.0)[..., None] * d / whole,)

    return Node(np.float64(loss), (logits,), back)


def binary_entropy(logits: Node, label: np.ndarray, weight: np.ndarray) -> Node:
    """Weighted mean of the cross-entropy of sigmoids."""
    z, whole = logits.value, max(float(weight.sum()), 1e-12)
    loss = (weight * (np.logaddexp(0, z) - label * z)).sum() / whole
    return Node(np.float64(loss), (logits,), lambda g: (g * weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / whole,))


def mean_loss(model, weights: dict[str, np.ndarray], batch: pd.DataFrame, epoch: int = 0) -> float:
    """Loss of a batch without training."""
    return float(model.loss({k: Node(v) for k, v in weights.items()}, batch, epoch).value)


MESSAGE = "name string, block long, task long, rows long, loss double, ids binary, delta binary"


def _adam(w: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, rate: float, step: int) -> None:
    """One step of Adam in place."""
    first *= FIRST
    first += (1 - FIRST) * g
    second *= SECOND
    second += (1 - SECOND) * g * g
    w -= rate * (first / (1 - FIRST**step)) / (np.sqrt(second / (1 - SECOND**step)) + TINY)


def _epoch(shared, rate: float, batch: int, seed: int, clip: float, folder: str | None = None):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        if first is None:
            return
        np.empty(3 << 20)  # once freed, the allocator keeps pieces up to this size, and batches don't fault in their memory again
        model, start, epoch, frozen = shared.value
        tables = {k: Table(start[k], rate, k in frozen) for k in getattr(model, "tables", ())}
        names = [k for k in start if k not in tables]
        flat = np.concatenate([start[k].ravel() for k in names] or [np.zeros(0)]).astype(np.float64)  # the other weights follow each other, so that a step moves all of them at once
        batches = chain([first], batches)
        first, second, ends = np.zeros_like(flat), np.zeros_like(flat), np.cumsum([start[k].size for k in names]).tolist()
        spans = {k: slice(e - start[k].size, e) for k, e in zip(names, ends, strict=True)}
        weights = {k: flat[at].reshape(start[k].shape) for k, at in spans.items()}
        rows, loss, step, rng = 0, 0.0, 0, np.random.default_rng((seed, epoch))
        for frame in batches:
            frame = frame.iloc[rng.permutation(len(frame))]
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                nodes = {k: Node(v) for k, v in weights.items()} | tables
                result = model.loss(nodes, part, epoch)
                backward(result)
                grads = {k: nodes[k].grad for k in names if nodes[k].grad is not None and k not in frozen}
                moved = {k: t.derivative() for k, t in tables.items()}
                moved = {k: x for k, x in moved.items() if k not in frozen}
                whole = np.concatenate([grads[k].ravel() for k in grads] or [np.zeros(0)])
                length = np.sqrt(float(whole @ whole) + sum(float((g * g).sum()) for _, g in moved.values()))
                scale = min(1.0, clip / max(length, 1e-12))
                step += 1
                whole *= scale
                runs = []  # of weights with a derivative, as far as they follow each other
                for k in grads:
                    if runs and runs[-1][1] == spans[k].start:
                        runs[-1][1] = spans[k].stop
                    else:
                        runs.append([spans[k].start, spans[k].stop])
                for begin, end in runs:
                    g, whole = whole[: end - begin], whole[end - begin :]
                    _adam(flat[begin:end], first[begin:end], second[begin:end], g, rate, step)
                for k, (places, g) in moved.items():
                    tables[k].move(places, g * scale)
                rows, loss = rows + len(part), loss + float(result.value) * len(part)
        if not rows:
            return
        task = TaskContext.get().partitionId()
        line = lambda name, block, ids, delta: pd.DataFrame({"name": [name], "block": [block], "task": [task], "rows": [rows], "loss": [loss], "ids": [ids.tobytes()], "delta": [delta.tobytes()]})
        yield line("", 0, np.zeros(0, dtype=np.int64), np.zeros(0))
        changes = [(k, np.arange(len(v)), v - start[k]) for k, v in weights.items() if k not in frozen]
        for k, t in tables.items():
            if k in frozen:
                continue
            if folder is None or not isinstance(t.base, Mapped):
                changes.append((k, *t.changes()))
                continue
            path = f"{folder}/{epoch}-{task}-{TaskContext.get().taskAttemptId()}-{k}"
            with open(f"{path}.ids", "wb") as ids, open(f"{path}.delta", "wb") as deltas:
                for some, delta in t.parts():
                    ids.write(some.tobytes())
                    deltas.write(delta.astype(np.float32, copy=False).tobytes())
            yield line(k, FILED, np.frombuffer(path.encode(), dtype=np.uint8), np.zeros(0))
        for name, ids, delta in changes:
            ends = np.searchsorted(ids, np.arange(0, (ids[-1] if len(ids) else 0) + BLOCK + 1, BLOCK))
            for block, (b, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if e > b:
                    yield line(name, block, ids[b:e], delta[b:e])

    return kernel


def _sum(sizes: dict[str, int]):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        """The tasks' changes of one block, each times the task's rows, in the order of the tasks."""
        rows = rows.sort_values("task", ignore_index=True)
        name, block = rows["name"].iloc[0], int(rows["block"].iloc[0])
        seen = np.unique(np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["ids"]]))
        out = np.zeros((len(seen), sizes.get(name, 1)))
        for n, ids, delta in zip(rows["rows"], rows["ids"], rows["delta"], strict=True):
            if len(ids):
                out[np.searchsorted(seen, np.frombuffer(ids, dtype=np.int64))] += n * np.frombuffer(delta).reshape(-1, out.shape[1])
        return pd.DataFrame({"name": [name], "block": [block], "task": [0], "rows": [rows["rows"].sum()], "loss": [rows["loss"].sum()], "ids": [seen.tobytes()], "delta": [out.tobytes()]})

    return kernel


def train(model, rows: DataFrame, epochs: int, rate: float = 1e-2, batch: int = 256, seed: int = 7, clip: float = 1.0, schedule: Callable[[int], float] | None = None, score: Callable[[dict], float] | None = None, patience: int = 2, checkpoint: Callable[[int, dict, float], None] | None = None, room: Room | None = None, uses: int = 1) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights of ``model`` (``start()``, ``loss(nodes, frame, epoch)`` and, optionally, ``frozen(epoch)`` and ``tables``, the names of weights
    that ``loss`` reads by :func:`take` only) and the mean loss of each epoch.

    ``schedule`` gives a factor of the rate per epoch. With ``score`` (of the weights, greater is better) the best epoch's weights stay and
    training stops after ``patience`` epochs without a better one. ``checkpoint`` gets each epoch's number, weights and loss. Weights must fit
    on the driver, twice, and once in each task. Rows are settled and given to as many tasks as there are cores or partitions, but where they
    are few, to fewer, so that a task has twenty batches. Without rows the start weights come back. Runs a job per epoch.

    With a ``room`` (``start`` takes it) tables are mapped files: driver and tasks hold the rows in use only, as single precision. Tasks leave
    their changes of tables in files, which other tasks sum by ranges of rows, after every wave of twice as many tasks as there are cores. A row
    reads about ``uses`` rows of a table, by which there are so many tasks that each holds at most about ``HELD`` bytes.
    """
    spark, rows = rows.sparkSession, settle(rows)
    parts, count = rows.rdd.getNumPartitions(), rows.count()
    cores, most = spark.sparkContext.defaultParallelism, max(1, count // (20 * batch))
    tasks = min(most, max(parts, cores))
    weights, losses, best, kept, stale = model.start() if room is None else model.start(room), [], -np.inf, None, 0
    sizes = {k: int(np.prod(v.shape[1:])) for k, v in weights.items()}
    if room is not None:
        longest = max(len(weights[k]) for k in model.tables)
        row = sum(3 * 4 * sizes[k] * len(weights[k]) // longest for k in model.tables)  # weights and two moments
        if longest * row > HELD:
            tasks = min(most, max(tasks, -(-count * uses * row // HELD)))
        tasks -= tasks % cores if tasks > cores else 0
        rows = settle(rows.repartition(tasks))
        release(spark)
    else:
        rows = rows.coalesce(tasks) if tasks <= parts else rows.repartition(tasks)
    for epoch in range(epochs):
        frozen = model.frozen(epoch) if hasattr(model, "frozen") else frozenset()
        shared = spark.sparkContext.broadcast((model, weights, epoch, frozen))
        kernel = _epoch(shared, rate * (schedule(epoch) if schedule else 1.0), batch, seed, clip, room and room.folder)
        seen, loss, total, moved = 0, 0.0, {}, {}
        if room is None:
            sums = rows.mapInPandas(kernel, MESSAGE).groupBy("name", "block").applyInPandas(_sum(sizes), MESSAGE).toLocalIterator(prefetchPartitions=True)  # a block at a time
        else:
            moved, sums = _waves(room, rows, kernel, tasks, 2 * cores, weights, sizes, count)
        for part in sums:
            if not part["name"]:
                seen, loss = part["rows"], part["loss"]
                continue
            name = part["name"]
            if name not in total:
                total[name] = np.zeros(weights[name].shape)
            ids = np.frombuffer(part["ids"], dtype=np.int64)
            total[name][ids] = np.frombuffer(part["delta"]).reshape(len(ids), *weights[name].shape[1:])
        shared.destroy()
        if not seen:
            break
        old, weights = weights, {k: moved[k] if k in moved else _moved(v, total[k], seen) if k in total else v for k, v in weights.items()}
        for k in moved:
            if kept is None or old[k] is not kept[k]:
                discard(old[k])
        del old
        losses.append(loss / seen)
        if checkpoint:
            checkpoint(epoch, weights, losses[-1])
        if score:
            now = score(weights)
            stale = 0 if now > best else stale + 1
            if now > best:
                best, kept = now, weights
            if stale >= patience:
                break
    return (kept if kept is not None else weights), losses


def _waves(room: Room, rows: DataFrame, kernel, tasks: int, wave: int, weights: dict[str, np.ndarray], sizes: dict[str, int], count: int) -> tuple[dict[str, np.ndarray], Iterator[pd.Series]]:
    """An epoch over all ``tasks`` partitions, ``wave`` of them at a time: the tables after it, and the summed changes of the other weights."""
    messages, sums = [], {}
    for begin in range(0, tasks, wave):
        last = begin + wave >= tasks
        some = rows.filter(F.spark_partition_id().between(begin, begin + wave - 1)) if tasks > wave else rows
        found = some.mapInPandas(kernel, MESSAGE).collect()
        messages += [m for m in found if m["block"] != FILED]
        filed: dict[str, list[tuple[int, int, str]]] = {k: [] for k in sums}
        for m in found:
            if m["block"] == FILED:
                filed.setdefault(m["name"], []).append((m["task"], m["rows"], m["ids"].decode()))
        jobs = []
        for name, files in filed.items():
            out = room.array(weights[name].shape)
            jobs.append((sorted(files), sums.get(name), weights[name] if last else None, out))
        if jobs:
            _add_ranges(rows.sparkSession, jobs, count)
        for files, before, _, _ in jobs:
            for _, _, path in files:
                os.unlink(f"{path}.ids")
                os.unlink(f"{path}.delta")
            if before is not None:
                discard(before)
        sums = {name: job[3] for name, job in zip(filed, jobs, strict=True)}
        jobs = before = None  # else the disk of removed files stays in use
    frame = pd.DataFrame([m.asDict() for m in messages], columns=[c.split()[0] for c in MESSAGE.split(", ")])
    return sums, (_sum(sizes)(part).iloc[0] for _, part in frame.groupby(["name", "block"]))


def _add_ranges(spark: SparkSession, jobs: list[tuple], count: int) -> None:
    """Per table: what was summed before and the tasks' changes in files, each times the task's rows and in the order of the tasks; where there
    are weights, these plus the sum's mean. Tasks write ranges of rows of a new file, so one that runs again writes the same."""
    step = 1 << 16
    ranges = [(j, i) for j, job in enumerate(jobs) for i in range(0, len(job[3]), step)]
    for job in jobs:
        job[3].flush()
    shared = spark.sparkContext.broadcast((ranges, [(*job[:3], str(job[3].filename), job[3].shape) for job in jobs]))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, jobs = shared.value
        for frame in batches:
            for at in frame["id"].tolist():
                job, begin = ranges[at]
                files, before, weights, path, shape = jobs[job]
                end = min(begin + step, shape[0])
                total = np.zeros((end - begin, shape[1])) if before is None else np.array(before[begin:end], dtype=np.float64)
                for _, n, name in files:
                    if not os.path.getsize(f"{name}.ids"):
                        continue
                    ids = np.memmap(f"{name}.ids", dtype=np.int64, mode="r")
                    i, j = np.searchsorted(ids, (begin, end)).tolist()
                    if j > i:
                        total[ids[i:j] - begin] += n * np.fromfile(f"{name}.delta", dtype=np.float32, count=(j - i) * shape[1], offset=i * shape[1] * 4).astype(np.float64).reshape(j - i, -1)
                if weights is not None:
                    total = weights[begin:end] + total / count
                out = Mapped(path, dtype=np.float32, mode="r+", shape=shape)
                out[begin:end] = total
                out.flush()
        yield pd.DataFrame({"n": [1]})

    parts = max(1, min(len(ranges), 2 * spark.sparkContext.defaultParallelism))
    spark.range(0, len(ranges), 1, parts).mapInPandas(kernel, "n long").collect()
    shared.destroy()


def _moved(start: np.ndarray, total: np.ndarray, rows: int) -> np.ndarray:
    total /= rows
    total += start
    return total
