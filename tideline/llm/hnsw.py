"""Hierarchical navigable small-world graph in flat arrays, built and searched for many vectors at a time."""

from __future__ import annotations

import numpy as np

#: Nodes that are linked by their exact similarities before the graph is searched, and nodes inserted at a time after that.
FIRST, BATCH = 4096, 1024
#: Links a node may have beyond its limit before its list is cut back.
SLACK = 8


class Hnsw:
    """Graph over unit vectors (float32 rows); similarity is the inner product.

    Nodes are renumbered so that level ``l`` holds the nodes ``0 .. sizes[l] - 1``; ``links[l]`` is its array of neighbours,
    filled up with -1. Levels are built from the top; on each, nodes are inserted in batches: a batch searches the graph so
    far, also looks at its own members, keeps neighbours that are nearer to the node than to each other, and is linked back.
    """

    def __init__(self, vectors: np.ndarray, m: int = 12, width: int = 40, seed: int = 3):
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1.0 - rng.random(n)) / np.log(m)).astype(np.int64), 6)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        sizes = [int((level >= low).sum()) for low in range(int(level.max(initial=0)) + 1)]
        self.sizes = [s for s in sizes if s > 0]
        self.width = width
        self.links: list[np.ndarray] = [np.empty((0, 0), dtype=np.int32)] * len(self.sizes)
        for low in reversed(range(len(self.sizes))):
            self._build(low, 2 * m if low == 0 else m)

    def _build(self, level: int, m: int) -> None:
        n = self.sizes[level]
        first = min(n, FIRST)
        links = np.full((n, m + SLACK), -1, dtype=np.int32)
        self.links[level] = links
        count = np.zeros(n, dtype=np.int64)
        take = min(self.width, first - 1)
        if take > 0:
            found = [self._exact(i, min(first, i + BATCH), first, take) for i in range(0, first, BATCH)]
            self._link(links, count, 0, np.concatenate([ids for ids, _ in found]), np.concatenate([near for _, near in found]), m)
        start = first
        while start < n:
            end = min(n, start + BATCH)
            queries = self.x[start:end]
            ids, near = self._beam(level, queries, self._enter(level, queries, start), self.width, start)
            own = queries @ queries.T
            np.fill_diagonal(own, -np.inf)
            most = min(8, end - start - 1)
            if most > 0:
                mates = np.argpartition(-own, most - 1, axis=1)[:, :most]
                ids = np.concatenate((ids, (mates + start).astype(ids.dtype)), axis=1)
                near = np.concatenate((near, np.take_along_axis(own, mates, axis=1)), axis=1)
            self._link(links, count, start, ids, near, m)
            start = end

    def _exact(self, start: int, end: int, nodes: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``take`` nearest of the first ``nodes`` of each node from ``start`` on, itself left out."""
        near = self.x[start:end] @ self.x[:nodes].T
        near[np.arange(end - start), np.arange(start, end)] = -np.inf
        ids = np.argpartition(-near, take - 1, axis=1)[:, :take]
        return ids, np.take_along_axis(near, ids, axis=1)

    def _enter(self, level: int, queries: np.ndarray, below: int) -> np.ndarray:
        """Entry node of each query on ``level``: the best found on the levels above."""
        entry = np.zeros(len(queries), dtype=np.int64)
        for upper in range(len(self.sizes) - 1, level, -1):
            ids, _ = self._beam(upper, queries, entry, 4, self.sizes[upper])
            entry = ids[:, 0].astype(np.int64)
        return np.where(entry < below, entry, 0)

    def _diverse(self, ids: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` of the candidates, best first: those nearer to their node than to any chosen before; then the rest by similarity."""
        order = np.argsort(-near, axis=1, kind="stable")[:, : m + m // 2 + 6]
        ids, near = np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)
        x = self.x[np.maximum(ids, 0)]
        mutual = x @ x.transpose(0, 2, 1)
        valid = (ids >= 0) & np.isfinite(near)
        kept = np.zeros(ids.shape, dtype=bool)
        chosen = np.zeros(len(ids), dtype=np.int64)
        worst = np.full(ids.shape, -np.inf, dtype=np.float32)
        for j in range(ids.shape[1]):
            good = valid[:, j] & (worst[:, j] <= near[:, j]) & (chosen < m)
            kept[:, j] = good
            chosen += good
            np.maximum(worst, mutual[:, j, :], out=worst, where=good[:, None])
        rank = np.where(kept, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :m]
        out = np.where(np.take_along_axis(valid, best, axis=1), np.take_along_axis(ids, best, axis=1), -1)
        return out

    def _link(self, links: np.ndarray, count: np.ndarray, start: int, ids: np.ndarray, near: np.ndarray, m: int) -> None:
        chosen = self._diverse(ids, near, m)
        links[start : start + len(ids), : chosen.shape[1]] = chosen
        count[start : start + len(ids)] = (chosen >= 0).sum(axis=1)
        source = np.repeat(np.arange(start, start + len(ids)), chosen.shape[1])
        target = chosen.ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        in_batch = target >= start  # links within the batch may stand on both sides already
        if in_batch.any():
            mutual = np.zeros(len(target), dtype=bool)
            mutual[in_batch] = (links[target[in_batch]] == source[in_batch, None]).any(axis=1)
            source, target = source[~mutual], target[~mutual]
        while len(target):
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            begins = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            place = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target)))) + count[target]
            fits = place < links.shape[1]
            links[target[fits], place[fits]] = source[fits]
            np.add.at(count, target[fits], 1)
            full = np.unique(target[~fits])
            for i in range(0, len(full), 4096):
                part = full[i : i + 4096]
                lists = links[part]
                near = np.einsum("bmd,bd->bm", self.x[np.maximum(lists, 0)], self.x[part])
                near[lists < 0] = -np.inf
                links[part] = -1
                cut = self._diverse(lists, near, m)
                links[part, : cut.shape[1]] = cut
                count[part] = (cut >= 0).sum(axis=1)
            source, target = source[~fits], target[~fits]

    def _beam(self, level: int, queries: np.ndarray, entry: np.ndarray, ef: int, nodes: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """``ef`` best nodes and similarities of each query, best first (-1 and -inf where fewer): beam search of all queries at once."""
        links, x = self.links[level], self.x
        total = len(queries)
        final_ids = np.full((total, ef), -1, dtype=np.int32)
        final_near = np.full((total, ef), -np.inf, dtype=np.float32)
        rows = np.arange(total)
        ids, near = final_ids.copy(), final_near.copy()
        ids[:, 0] = entry
        near[:, 0] = np.einsum("bd,bd->b", x[entry], queries)
        open_ = np.zeros((total, ef), dtype=bool)
        open_[:, 0] = True
        seen = np.zeros((total, nodes), dtype=np.int16)
        seen[rows, entry] = 1
        expand = min(expand, ef)
        stamps = np.arange(1, expand * links.shape[1] + 1, dtype=np.int16)
        while True:
            going = open_.any(axis=1)
            if not going.all():
                done = ~going
                final_ids[rows[done]], final_near[rows[done]] = ids[done], near[done]
                rows, ids, near, open_ = rows[going], ids[going], near[going], open_[going]
            if not len(rows):
                return final_ids, final_near
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :expand]
            line = np.arange(len(rows))[:, None]
            picked = np.where(open_[line, pick], ids[line, pick], -1)
            open_[line, pick] = False
            around = links[np.maximum(picked, 0)]
            around[picked < 0] = -1
            around = around.reshape(len(rows), -1)
            place = rows[:, None] * nodes + np.maximum(around, 0)
            flat = seen.reshape(-1)
            fresh = (around >= 0) & (flat[place] == 0)
            r, c = np.nonzero(fresh)
            at, stamp = place[r, c], stamps[c]
            flat[at] = stamp
            single = flat[at] == stamp
            r, c = r[single], c[single]
            found = around[r, c]
            score = np.einsum("id,id->i", x[found], queries[rows[r]])
            better = score > near[r, -1]
            r, c, found, score = r[better], c[better], found[better], score[better]
            if not len(r):
                continue
            counts = np.bincount(r, minlength=len(rows))
            wide = int(counts.max())
            slot = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_ids = np.full((len(rows), wide), -1, dtype=np.int32)
            new_near = np.full((len(rows), wide), -np.inf, dtype=np.float32)
            new_ids[r, slot], new_near[r, slot] = found, score
            all_ids, all_near = np.concatenate((ids, new_ids), axis=1), np.concatenate((near, new_near), axis=1)
            all_open = np.concatenate((open_, new_ids >= 0), axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :ef]
            ids, near, open_ = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_near, best, axis=1), np.take_along_axis(all_open, best, axis=1)

    def search(self, queries: np.ndarray, k: int, ef: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Positions (in the given vectors; -1: none) and similarities of the ``k`` nearest found."""
        out_ids, out_near = [], []
        for i in range(0, len(queries), batch):
            part = np.ascontiguousarray(queries[i : i + batch], dtype=np.float32)
            ids, near = self._beam(0, part, self._enter(0, part, self.sizes[0]), max(ef, k), self.sizes[0])
            out_ids.append(ids[:, :k])
            out_near.append(near[:, :k])
        return self._given(np.concatenate(out_ids)), np.concatenate(out_near)

    def search_own(self, k: int, ef: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`search`, for the graph's own vectors in the given order; each starts at its own node and isn't its own neighbour."""
        n = self.sizes[0]
        ids, near = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf, dtype=np.float32)
        for i in range(0, n, batch):
            own = np.arange(i, min(n, i + batch))
            found, score = self._beam(0, self.x[own], own, max(ef, k + 1), n)
            score = np.where(found == own[:, None], -np.inf, score)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found, score = np.take_along_axis(found, best, axis=1), np.take_along_axis(score, best, axis=1)
            ids[self.order[own], : found.shape[1]] = self._given(np.where(np.isfinite(score), found, -1))
            near[self.order[own], : found.shape[1]] = score
        return ids, near

    def _given(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1)
