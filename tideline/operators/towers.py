"""Models of the next item: two towers, self-attention over items, and a decoder of item codes; trained by :func:`gradients.train`.

Items are numbers from 1, 0 being padding; histories are padded on the left by the models themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from tideline.operators.gradients import Node, attention, binary_entropy, concat, cross_entropy, curve, feed, gelu, layer_norm, node, relu, shares, softmax, softplus, stack, take, total, unit
from tideline.operators.mapped import Room, rows_of

#: Weights of targets that are clicks, carts and orders.
ACTION_WEIGHTS = np.sqrt(np.array([1.0, 3.0, 6.0]))


def padded(lists, length: int, shift: int = 0) -> np.ndarray:
    """``[rows, length]``: the last values of each list, on the right; 0 elsewhere."""
    out = np.zeros((len(lists), length), dtype=np.int64)
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    if sizes.any():
        values = np.concatenate([np.asarray(v, dtype=np.int64) for v in lists])
        row = np.repeat(np.arange(len(lists)), sizes)
        column = length - np.cumsum(sizes)[row] + np.arange(len(values))
        kept = column >= 0
        out[row[kept], column[kept]] = values[kept] + shift
    return out


def causal(target: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """Which targets of a batch may be another row's negatives: those known by its time that aren't its own item; and its own target."""
    allowed = (ts[None, :] <= ts[:, None]) & (target[None, :] != target[:, None])
    np.fill_diagonal(allowed, True)
    return allowed


def _normal(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return rng.normal(0, scale if scale is not None else np.sqrt(1 / shape[-2]), shape)


def _table(rng: np.random.Generator, rows: int, width: int, room: Room | None = None) -> np.ndarray:
    out = rows_of(room, (rows, width))
    for i in range(0, rows, 8192):  # the same numbers as at once
        out[i : i + 8192] = rng.normal(0, 0.1, (min(8192, rows - i), width))
    out[0] = 0
    return out


def gru(p: dict[str, Node], name: str, x: Node, mask: np.ndarray) -> Node:
    """Last state of a gated recurrent unit over ``[rows, steps, width]``; masked steps leave the state as it is. One node: a step computes
    only the rows that it isn't masked in."""
    w, u, b = p[f"{name}_w"], p[f"{name}_u"], p[f"{name}_b"]
    width, inputs = u.value.shape[0], x.value.shape[2]
    steps, rows = np.nonzero(mask.T)  # in the order of the steps
    ends = np.searchsorted(steps, np.flatnonzero(mask.any(axis=0)), side="right").tolist()
    spans = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
    picked = x.value[rows, steps]
    inner = picked @ w.value + b.value
    state = np.zeros((x.value.shape[0], width))
    before, gates, fresh, carried = np.zeros((len(rows), width)), np.zeros((len(rows), 2 * width)), np.zeros((len(rows), width)), np.zeros((len(rows), width))
    for i, j in spans:
        at = rows[i:j]
        old = before[i:j] = state[at]
        outer = old @ u.value
        g = gates[i:j] = 1 / (1 + np.exp(-np.clip(inner[i:j, : 2 * width] + outer[:, : 2 * width], -30, 30)))
        carried[i:j] = outer[:, 2 * width :]
        new = fresh[i:j] = np.tanh(inner[i:j, 2 * width :] + g[:, :width] * outer[:, 2 * width :])
        state[at] = new + g[:, width:] * (old - new)

    def back(g):
        later, d_inner, d_outer = g.copy(), np.zeros((len(rows), 3 * width)), np.zeros((len(rows), 3 * width))
        reset, keep = gates[:, :width], gates[:, width:]
        slope, share = (1 - keep) * (1 - fresh * fresh), (before - fresh) * keep * (1 - keep)
        turn = carried * reset * (1 - reset)
        for i, j in reversed(spans):
            at = rows[i:j]
            d = later[at]
            into = d * slope[i:j]
            d_inner[i:j, :width], d_inner[i:j, width : 2 * width], d_inner[i:j, 2 * width :] = into * turn[i:j], d * share[i:j], into
            d_outer[i:j, : 2 * width], d_outer[i:j, 2 * width :] = d_inner[i:j, : 2 * width], into * reset[i:j]
            later[at] = d * keep[i:j] + d_outer[i:j] @ u.value.T
        out = np.zeros((*mask.shape, inputs))
        out[rows, steps] = d_inner @ w.value.T
        return out, picked.T @ d_inner, before.T @ d_outer, d_inner.sum(axis=0)

    return Node(state, (x, w, u, b), back)


def gru_start(rng: np.random.Generator, name: str, inputs: int, width: int) -> dict[str, np.ndarray]:
    return {f"{name}_w": _normal(rng, inputs, 3 * width), f"{name}_u": _normal(rng, width, 3 * width), f"{name}_b": np.zeros(3 * width)}


@dataclass
class Towers:
    """Two towers. The user's: a recurrent unit over items, types and time buckets of the history, plus the mean of the items. The item's: its
    vector, plus, with ``features`` (``categories``: numbers ``[items + 1, kinds]``, ``numbers``: ``[items + 1, columns]``), a layer over
    category vectors, statistics and a known vector.

    Loss per row: softmax over the batch's targets that :func:`causal` allows, mixed with a softmax over the row's hard negatives, whose
    share rises by epoch (``hard``); weighted by the target's type. Rows: ``history, types, buckets, target, target_type, ts`` and, where
    hard negatives have a share, ``negatives``. Known vectors are frozen in the first epochs.
    """

    items: int
    width: int = 16
    length: int = 30
    temperature: float = 0.07
    hard: tuple[float, ...] = (0.0,)
    thaw: int = 2
    categories: np.ndarray | None = None
    numbers: np.ndarray | None = None
    known: np.ndarray | None = None
    seed: int = 7

    def start(self, room: Room | None = None) -> dict[str, np.ndarray]:
        """The first weights; the ``tables`` among them in a room, if there is one."""
        rng, w = np.random.default_rng(self.seed), self.width
        p = {"item": _table(rng, self.items + 1, w, room), "type": _table(rng, 4, w), "time": _table(rng, 34, w), "out": np.eye(w), "out_b": np.zeros(w)}
        p |= gru_start(rng, "gru", w, w)
        wide = 0
        if self.categories is not None:
            for k in range(self.categories.shape[1]):
                p[f"cat{k}"] = _table(rng, int(self.categories[:, k].max(initial=0)) + 1, w, room)
            wide += w
        if self.numbers is not None:
            p |= {"stat": _normal(rng, self.numbers.shape[1], w), "stat_b": np.zeros(w)}
            wide += w
        if self.known is not None:
            p |= {"known": self.known if room else self.known.astype(np.float64).copy(), "known_w": _normal(rng, self.known.shape[1], w)}
            wide += w
            if room:  # the weight is the only one that needs the file
                self.known = self.known[:0]
        if wide:
            p |= {"mix": _normal(rng, wide + w, w), "mix_b": np.zeros(w), "mix_g": np.ones(w), "mix_o": np.zeros(w)}
        return p

    @property
    def tables(self) -> tuple[str, ...]:
        return ("item", *(f"cat{k}" for k in range(self.categories.shape[1] if self.categories is not None else 0)), *(("known",) if self.known is not None else ()))

    def __getstate__(self) -> dict:
        """Without the known vectors themselves, which are the start of a weight and aren't needed after."""
        return self.__dict__ | {"known": None if self.known is None else self.known[:0]}

    def frozen(self, epoch: int) -> frozenset[str]:
        return frozenset({"known"}) if epoch < self.thaw else frozenset()

    def users(self, p: dict[str, Node], frame: pd.DataFrame) -> Node:
        items, types, times = padded(frame["history"], self.length), padded(frame["types"], self.length, 1), padded(frame["buckets"], self.length, 1)
        mask = items > 0
        vectors = take(p["item"], items)
        state = gru(p, "gru", vectors + take(p["type"], types) + take(p["time"], np.minimum(times, 33)), mask)
        mean = total(vectors * mask[..., None].astype(np.float64), 1) * (1 / np.maximum(mask.sum(axis=1), 1))[:, None]
        return unit((state + mean) @ p["out"] + p["out_b"])

    def vectors(self, p: dict[str, Node], ids: np.ndarray) -> Node:
        flat = ids.ravel()
        own = take(p["item"], flat)
        parts = [own]
        if self.categories is not None:
            tables = [take(p[f"cat{k}"], np.asarray(self.categories[flat, k])) for k in range(self.categories.shape[1])]
            added = tables[0]
            for t in tables[1:]:
                added = added + t
            parts.append(added)
        if self.numbers is not None:
            parts.append(gelu(node(np.asarray(self.numbers[flat], dtype=np.float64)) @ p["stat"] + p["stat_b"]))
        if self.known is not None:
            parts.append(take(p["known"], flat) @ p["known_w"])
        if len(parts) > 1:
            own = own + layer_norm(gelu(concat(parts) @ p["mix"] + p["mix_b"]), p["mix_g"], p["mix_o"])
        return unit(own).reshape(*ids.shape, self.width)

    def loss(self, p: dict[str, Node], frame: pd.DataFrame, epoch: int) -> Node:
        target, ts = frame["target"].to_numpy(dtype=np.int64), frame["ts"].to_numpy(dtype=np.int64)
        weight = ACTION_WEIGHTS[frame["target_type"].to_numpy(dtype=np.int64)]
        users, right = self.users(p, frame), self.vectors(p, target)
        near = (users @ right.swap(0, 1)) * (1 / self.temperature)
        loss = cross_entropy(near, np.arange(len(target)), weight, causal(target, ts))
        share = self.hard[min(epoch, len(self.hard) - 1)]
        if share:
            lists = np.array(frame["negatives"].tolist(), dtype=np.int64)
            others = total(users.reshape(len(target), 1, self.width) * self.vectors(p, lists), 2)
            both = concat([total(users * right, 1).reshape(len(target), 1), others]) * (1 / self.temperature)
            allowed = np.concatenate((np.ones((len(target), 1), dtype=bool), lists > 0), axis=1)
            loss = loss * (1 - share) + cross_entropy(both, np.zeros(len(target), dtype=np.int64), weight, allowed) * share
        return loss

    def all_vectors(self, weights: dict[str, np.ndarray]) -> np.ndarray:
        """``[items, width]``, of the items from 1."""
        p = {k: Node(v) for k, v in weights.items()}
        return np.concatenate([self.vectors(p, np.arange(i, min(i + 8192, self.items + 1))).value for i in range(1, self.items + 1, 8192)]) if self.items else np.zeros((0, self.width))


@dataclass
class _Blocks:
    """Layers of attention and a feed-forward part, each normed before and added to its input."""

    width: int
    heads: int
    layers: int
    names: list[str] = field(default_factory=list)

    def start(self, rng: np.random.Generator, name: str, across: bool = False) -> dict[str, np.ndarray]:
        d, p = self.width, {}
        for i in range(self.layers):
            for part in ("self", "cross") if across else ("self",):
                p |= {f"{name}{i}{part}_{c}": _normal(rng, d, d) for c in "qkvo"} | {f"{name}{i}{part}_g": np.ones(d), f"{name}{i}{part}_n": np.zeros(d)}
            p |= {f"{name}{i}_1": _normal(rng, d, 4 * d), f"{name}{i}_1b": np.zeros(4 * d), f"{name}{i}_2": _normal(rng, 4 * d, d), f"{name}{i}_2b": np.zeros(d), f"{name}{i}_g": np.ones(d), f"{name}{i}_n": np.zeros(d)}
        return p | {f"{name}_g": np.ones(d), f"{name}_n": np.zeros(d)}

    def _attend(self, p: dict[str, Node], name: str, x: Node, memory: Node, allowed: np.ndarray) -> Node:
        return attention(x, memory, tuple(p[f"{name}_{c}"] for c in "qkvo"), self.heads, allowed)

    def run(self, p: dict[str, Node], name: str, x: Node, allowed: np.ndarray, memory: Node | None = None, seen: np.ndarray | None = None) -> Node:
        for i in range(self.layers):
            h = layer_norm(x, p[f"{name}{i}self_g"], p[f"{name}{i}self_n"])
            x = x + self._attend(p, f"{name}{i}self", h, h, allowed)
            if memory is not None:
                h = layer_norm(x, p[f"{name}{i}cross_g"], p[f"{name}{i}cross_n"])
                x = x + self._attend(p, f"{name}{i}cross", h, memory, seen)
            h = layer_norm(x, p[f"{name}{i}_g"], p[f"{name}{i}_n"])
            x = x + feed(h, *(p[f"{name}{i}_{c}"] for c in ("1", "1b", "2", "2b")))
        return layer_norm(x, p[f"{name}_g"], p[f"{name}_n"])


    def steps(self, p: dict[str, Node], name: str, memory: Node, seen: np.ndarray) -> _Steps:
        """:meth:`run` of a causal decoder a step at a time, without derivatives."""
        return _Steps(self, {k: n.value for k, n in p.items()}, name, memory.value, seen)


class _Steps:
    """Layers of :class:`_Blocks` over one more step of each entry; entries of one row follow each other."""

    def __init__(self, blocks: _Blocks, w: dict[str, np.ndarray], name: str, memory: np.ndarray, seen: np.ndarray):
        self.blocks, self.w, self.name, self.seen = blocks, w, name, seen
        rows, split = len(memory), lambda v: v.reshape(len(memory), -1, blocks.heads, blocks.width // blocks.heads).swapaxes(1, 2)
        flat = memory.reshape(-1, blocks.width) if rows else np.zeros((0, blocks.width))
        self.memory = [tuple(np.ascontiguousarray(split(flat @ w[f"{name}{i}cross_{c}"])) for c in "kv") for i in range(blocks.layers)]
        self.past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(blocks.layers)]

    def keep(self, entries: np.ndarray) -> None:
        """The entries from which the next step goes on."""
        self.past = [[(k[entries], v[entries]) for k, v in layer] for layer in self.past]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return layer_norm(Node(x), Node(self.w[f"{name}_g"]), Node(self.w[f"{name}_n"])).value

    def __call__(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        b, w = self.blocks, self.w
        size = b.width // b.heads
        lines = lambda v: v.reshape(-1, b.heads, size)
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        most = int(place.max(initial=-1)) + 1
        for i in range(b.layers):
            at = f"{self.name}{i}"
            h = self._norm(x, f"{at}self")
            q = lines(h @ w[f"{at}self_q"])
            self.past[i].append((lines(h @ w[f"{at}self_k"]), lines(h @ w[f"{at}self_v"])))
            z = np.stack([np.einsum("nhd,nhd->nh", q, k) for k, _ in self.past[i]], axis=2) / np.sqrt(size)
            share = shares(z, None)
            mixed = sum(share[:, :, j, None] * v for j, (_, v) in enumerate(self.past[i]))
            x = x + mixed.reshape(-1, b.width) @ w[f"{at}self_o"]
            h = self._norm(x, f"{at}cross")
            q = np.zeros((len(self.seen), b.heads, most, size))
            q[row, :, place] = lines(h @ w[f"{at}cross_q"])
            k, v = self.memory[i]
            z = q @ k.swapaxes(2, 3)
            z /= np.sqrt(size)
            mixed = (shares(z, self.seen[:, None, None]) @ v)[row, :, place]
            x = x + mixed.reshape(-1, b.width) @ w[f"{at}cross_o"]
            h = self._norm(x, at)
            x = x + curve(h @ w[f"{at}_1"] + w[f"{at}_1b"])[0] @ w[f"{at}_2"] + w[f"{at}_2b"]
        return self._norm(x, self.name)


@dataclass
class SelfAttention:
    """Causal self-attention over a history of items with their feedback (1 negative, 2 positive); items are scored by their own vectors.

    Rows: ``items, feedback`` (padded with 0 on the left) and ``labels``, the next item at each position from 0 or -100 where it doesn't count.
    """

    items: int
    length: int
    width: int = 16
    heads: int = 2
    layers: int = 1
    seed: int = 7

    def __post_init__(self):
        self.blocks = _Blocks(self.width, self.heads, self.layers)

    def start(self) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        p = {"item": _table(rng, self.items + 1, self.width), "place": _table(rng, self.length, self.width), "feedback": _table(rng, 3, self.width), "bias": np.zeros(self.items)}
        return p | self.blocks.start(rng, "enc")

    def states(self, p: dict[str, Node], items: np.ndarray, feedback: np.ndarray) -> Node:
        """``[rows, length, width]``; padding is seen by no other position, and itself by itself only."""
        steps = items.shape[1]
        x = take(p["item"], items) * np.sqrt(self.width) + take(p["place"], np.arange(steps)) + take(p["feedback"], feedback)
        allowed = np.tril(np.ones((steps, steps), dtype=bool))[None] & (items > 0)[:, None, :]
        allowed = allowed | np.eye(steps, dtype=bool)[None]
        return self.blocks.run(p, "enc", x, allowed)

    def loss(self, p: dict[str, Node], frame: pd.DataFrame, epoch: int) -> Node:
        items, feedback, labels = (np.array(frame[c].tolist(), dtype=np.int64) for c in ("items", "feedback", "labels"))
        state = self.states(p, items, feedback)
        row, column = np.nonzero(labels >= 0)
        if not len(row):
            return total(state) * 0.0
        picked = state[row, column]
        logits = picked @ p["item"][1:].swap(0, 1) + p["bias"]
        return cross_entropy(logits, labels[row, column], np.ones(len(row)))

    def score_all(self, weights: dict[str, np.ndarray], items: np.ndarray, feedback: np.ndarray) -> np.ndarray:
        """``[rows, items]``: scores of the item that comes next."""
        p = {k: Node(v) for k, v in weights.items()}
        return self.states(p, items, feedback).value[:, -1] @ weights["item"][1:].T + weights["bias"]


@dataclass
class CodeDecoder:
    """Encoder over the codes of a history and decoder of the next item's code, token by token.

    Rows: ``history`` (item numbers from 1, padded with 0 on the left), ``feedback`` and ``target`` (an item number). ``codes`` is ``[items + 1,
    levels]``, tokens from 0; row 0 is padding.
    """

    codes: np.ndarray
    sizes: tuple[int, ...]
    length: int
    width: int = 16
    heads: int = 2
    layers: int = 1
    seed: int = 7

    def __post_init__(self):
        self.blocks = _Blocks(self.width, self.heads, self.layers)

    def start(self) -> dict[str, np.ndarray]:
        rng, d = np.random.default_rng(self.seed), self.width
        p = {"place": _table(rng, self.length, d), "feedback": _table(rng, 3, d), "level": _table(rng, len(self.sizes), d), "begin": np.zeros(d)}
        for i, size in enumerate(self.sizes):
            p |= {f"in{i}": _table(rng, size + 1, d), f"tok{i}": _normal(rng, size, d, scale=0.1), f"head{i}": _normal(rng, d, size), f"head{i}_b": np.zeros(size)}
        return p | self.blocks.start(rng, "enc") | self.blocks.start(rng, "dec", across=True)

    def encode(self, p: dict[str, Node], history: np.ndarray, feedback: np.ndarray) -> tuple[Node, np.ndarray]:
        real = history > 0
        x = take(p["place"], np.arange(history.shape[1])) + take(p["feedback"], feedback)
        for i in range(len(self.sizes)):
            x = x + take(p[f"in{i}"], np.where(real, self.codes[history, i] + 1, 0))
        allowed = np.broadcast_to(real[:, None, :], (len(history), history.shape[1], history.shape[1])) | np.eye(history.shape[1], dtype=bool)[None]
        return self.blocks.run(p, "enc", x, allowed), real

    def decode(self, p: dict[str, Node], memory: Node, real: np.ndarray, prefix: np.ndarray) -> list[Node]:
        """Logits of the levels up to the one after ``prefix`` (``[rows, known tokens]``)."""
        rows, steps = len(real), min(prefix.shape[1] + 1, len(self.sizes))
        inputs = [node(np.zeros((rows, self.width))) + p["begin"], *(take(p[f"tok{i}"], prefix[:, i]) for i in range(steps - 1))]
        x = stack(inputs) + take(p["level"], np.arange(steps))
        allowed = np.broadcast_to(np.tril(np.ones((steps, steps), dtype=bool))[None], (rows, steps, steps))
        seen = np.broadcast_to(real[:, None, :], (rows, steps, real.shape[1]))
        h = self.blocks.run(p, "dec", x, allowed, memory, seen)
        return [h[:, i] @ p[f"head{i}"] + p[f"head{i}_b"] for i in range(steps)]

    def loss(self, p: dict[str, Node], frame: pd.DataFrame, epoch: int) -> Node:
        history, feedback = (np.array(frame[c].tolist(), dtype=np.int64) for c in ("history", "feedback"))
        codes = self.codes[frame["target"].to_numpy(dtype=np.int64)]
        logits = self.decode(p, *self.encode(p, history, feedback), codes[:, :-1])
        out = None
        for i, z in enumerate(logits):
            one = cross_entropy(z, codes[:, i], np.ones(len(codes))) * (1 / len(logits))
            out = one if out is None else out + one
        return out

    def legal(self) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Items in the order of their codes, the codes so ordered, and of each level's prefixes the first item and the prefix one shorter."""
        if not hasattr(self, "_legal"):
            order = np.lexsort(self.codes[1:].T[::-1]) + 1
            codes, levels, parent = self.codes[order], [], np.zeros(len(order), dtype=np.int64)
            fresh = np.arange(len(order)) == 0
            for level in range(codes.shape[1]):
                fresh[1:] |= codes[1:, level] != codes[:-1, level]
                firsts = np.flatnonzero(fresh)
                levels.append((firsts, parent[firsts]))
                parent = np.cumsum(fresh) - 1
            self._legal = order, codes, levels
        return self._legal

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_legal"}

    def beam(self, weights: dict[str, np.ndarray], history: np.ndarray, feedback: np.ndarray, beam: int, topk: int) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers (0: none) and summed log probabilities of the ``topk`` best legal codes; ties go to the smaller code.

        A level computes its own step only: keys and values of the steps before stay with the entries, those of the history with its row.
        """
        p = {k: Node(v) for k, v in weights.items()}
        memory, real = self.encode(p, history, feedback)
        rows, levels = len(history), len(self.sizes)
        order, sorted_codes, prefixes = self.legal()
        line, held, score = np.arange(rows), np.zeros(rows, dtype=np.int64), np.zeros(rows)  # a beam entry: its row, prefix and score
        token, steps = None, self.blocks.steps(p, "dec", memory, real)
        for level in range(levels):
            firsts, parent = prefixes[level]
            x = weights["level"][level] + (weights["begin"] if token is None else weights[f"tok{level - 1}"][token])
            z = steps(np.broadcast_to(x, (len(line), self.width)), line) @ weights[f"head{level}"] + weights[f"head{level}_b"]
            z = z - z.max(axis=1, keepdims=True)
            z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            begin, end = np.searchsorted(parent, held, side="left"), np.searchsorted(parent, held, side="right")
            entry = np.repeat(np.arange(len(line)), end - begin)  # children follow each other in the order of codes
            child = np.arange(len(entry)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[entry]
            own = sorted_codes[firsts, level][child]
            grown = score[entry] + z[entry, own]
            best = np.lexsort((child, -np.round(grown, 9), line[entry]))
            place = np.arange(len(best)) - np.searchsorted(line[entry][best], line[entry][best], side="left")
            kept = best[place < (beam if level + 1 < levels else topk)]
            token, line, held, score = own[kept], line[entry[kept]], child[kept], grown[kept]
            steps.keep(entry[kept])
        place = np.arange(len(line)) - np.searchsorted(line, line, side="left")
        items, scores = np.zeros((rows, topk), dtype=np.int64), np.full((rows, topk), -np.inf)
        items[line, place], scores[line, place] = order[firsts][held], score
        return items, scores


@dataclass
class FusionHead:
    """A logit from three logits ``z`` and a context ``x``: ``static`` (softplus weights), ``mlp`` or ``gate`` (softmax weights by the context)."""

    kind: str
    context: int
    hidden: int = 8
    seed: int = 7

    def start(self) -> dict[str, np.ndarray]:
        rng, h = np.random.default_rng(self.seed), self.hidden
        if self.kind == "static":
            return {"raw": np.zeros(3), "bias": np.zeros(1)}
        if self.kind not in ("mlp", "gate"):
            raise ValueError(f"unknown kind {self.kind}")
        inputs, outputs = (self.context + 3, 1) if self.kind == "mlp" else (self.context, 3)
        return {"w": _normal(rng, inputs, h), "b": np.zeros(h), "v": _normal(rng, h, outputs), "bias": np.zeros(1)}

    def logit(self, p: dict[str, Node], z: np.ndarray, x: np.ndarray) -> Node:
        if self.kind == "static":
            return total(node(z) * softplus(p["raw"]), 1) + p["bias"]
        if self.kind == "mlp":
            return total(relu(node(np.concatenate((z, x), axis=1)) @ p["w"] + p["b"]) @ p["v"], 1) + p["bias"]
        return total(node(z) * softmax(relu(node(x) @ p["w"] + p["b"]) @ p["v"]), 1) + p["bias"]

    def loss(self, p: dict[str, Node], frame: pd.DataFrame, epoch: int) -> Node:
        """Rows: ``z`` and ``x`` as arrays, and ``label``."""
        z, x = np.array(frame["z"].tolist(), dtype=np.float64), np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), -1)
        return binary_entropy(self.logit(p, z, x), frame["label"].to_numpy(dtype=np.float64), np.ones(len(frame)))
