"""Vectors: products, norms, exact and approximate neighbours, session vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.sessions import number_rows
from tideline.session import settle


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The array divided by its length; of length 0 as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


class Nearest:
    """Exactly the ``k`` rows of ``x`` nearest to each vector by cosine, similarities rounded to nine decimals, ties to the smaller row.

    Products in single precision say which rows can be among the ``k``, as they are off by less than their margin; those rows get exact ones.
    """

    def __init__(self, x: np.ndarray, k: int):
        self.x = self._scaled(x)
        self.k, self.low = min(k, len(x)), np.ascontiguousarray(self.x.astype(np.float32).T)
        self.margin = np.float32(4e-7 * (x.shape[1] + 8) + 2e-9)

    @staticmethod
    def _scaled(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """``query, row, rank`` (from 1) and ``similarity``, best first for each query; None without queries or rows."""
        if not len(queries) or not self.k:
            return None
        q, out = self._scaled(np.asarray(queries, dtype=np.float64)), []
        step = max(1, (1 << 23) // len(self.x))
        for i in range(0, len(q), step):
            near = q[i : i + step].astype(np.float32) @ self.low
            least = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
            r, c = np.nonzero(near >= least[:, None] - self.margin)
            score = np.round(np.einsum("id,id->i", q[i + r], self.x[c]), 9)
            order = np.lexsort((c, -score, r))
            r, c, score = r[order], c[order], score[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1
            kept = rank <= self.k
            out.append((r[kept] + i, c[kept], rank[kept], score[kept]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def place_of(x: np.ndarray, queries: np.ndarray, row: np.ndarray, k: int, block: int = 8192) -> np.ndarray:
    """Place (from 1) of a row of ``x`` for each of the queries in the order of :class:`Nearest`; 0 beyond ``k``. ``x`` is read in blocks."""
    q = Nearest._scaled(np.asarray(queries, dtype=np.float64))
    own = np.round(np.einsum("id,id->i", q, Nearest._scaled(np.asarray(x[row], dtype=np.float64))), 9)
    single, ahead, left = q.astype(np.float32), np.zeros(len(q), dtype=np.int64), np.arange(len(q))
    margin = 4e-7 * (x.shape[1] + 8) + 2e-9
    for i in range(0, len(x), block):
        part = Nearest._scaled(np.asarray(x[i : i + block], dtype=np.float64))
        near = single[left] @ np.ascontiguousarray(part.astype(np.float32).T)
        at = own[left, None].astype(np.float32)
        above = near > at + np.float32(margin)
        ahead[left] += np.count_nonzero(above, axis=1)
        r, c = np.nonzero((near >= at - np.float32(margin)) & ~above)
        score = np.round(np.einsum("id,id->i", q[left[r]], part[c]), 9)
        first = (score > own[left[r]]) | ((score == own[left[r]]) & (c + i < row[left[r]]))
        np.add.at(ahead, left[r[first]], 1)
        left = left[ahead[left] < k]
        if not len(left):
            break
    return np.where(ahead < k, ahead + 1, 0)


def _top(k: int, same: bool):
    def kernel(catalogue: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if catalogue.empty or queries.empty:
            return pd.DataFrame(columns=["query_id", "item_id", "similarity"])
        catalogue = catalogue.sort_values("item_id")
        ids, asked = catalogue["item_id"].to_numpy(), queries["query_id"].to_numpy()
        scale = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        x, q = scale(np.array(catalogue["vector"].tolist(), dtype=np.float64)), scale(np.array(queries["vector"].tolist(), dtype=np.float64))
        out = []
        step = max(1, (1 << 24) // len(x))
        for i in range(0, len(q), step):
            near = np.round(q[i : i + step] @ x.T, 9)
            if same:
                near[asked[i : i + step, None] == ids] = -np.inf
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(near, best, axis=1)
            r, c = np.nonzero(np.isfinite(score))
            out.append(pd.DataFrame({"query_id": asked[i : i + step][r], "item_id": ids[best[r, c]], "similarity": score[r, c]}))
        return pd.concat(out)

    return kernel


def cosine_topk(queries: DataFrame, catalogue: DataFrame, k: int, same: bool = False, block: int = 8192) -> DataFrame:
    """``query_id, item_id, similarity, rank``: exactly the ``k`` nearest of ``catalogue`` (``item_id, vector``) for each of ``queries``.

    All queries meet all items, in blocks: the catalogue is divided by hash, queries go to every block, each pair of blocks is one
    product of matrices, and the blocks' bests are merged. Similarities are rounded to nine decimals, ties go to the smaller item.
    ``same`` leaves out the item with the query's id. Runs a count of both.
    """
    rows, asked = catalogue.count(), queries.count()
    blocks, parts = max(1, math.ceil(rows / block)), max(1, math.ceil(asked / block))
    left = catalogue.select("item_id", "vector", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    right = queries.select("query_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("p"))
    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(_top(k, same), "query_id long, item_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def cell_topk(vectors: DataFrame, k: int, probes: int = 16, cell_rows: int = 4096, least_cells: int = 48, block: int = 8192, seed: int = 7) -> DataFrame:
    """``query_id, item_id, similarity, rank``: about the ``k`` nearest other items, among those of the ``probes`` nearest cells.

    Cells of about ``cell_rows`` items (but ``least_cells`` at least) lie around centres that MLlib fits on a sample of 64 items for each; all items are
    put into the cell of their nearest centre and ask ``probes`` cells. A cell's items and askers meet in blocks of at most ``block`` rows on
    each side, one product of matrices each, so a large cell is spread over many tasks. Similarities are exact, rounded to nine decimals,
    ties go to the smaller item. The centres, a row per cell, are broadcast. Runs jobs.
    """
    asked = asked_cells(vectors, probes, cell_rows, least_cells, seed)
    if asked is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, item_id long, similarity double, rank long")
    cell = F.explode("cells").alias("cell")
    own, asks = asked.select("item_id", "vector", F.col("cells")[0].alias("cell")), asked.select(F.col("item_id").alias("query_id"), F.col("vector").alias("vector"), cell)
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    sizes = count(own, "parts").join(count(asks, "slices"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(F.broadcast(sizes), "cell").select("cell", "item_id", "vector", F.pmod(F.xxhash64("item_id"), F.col("parts").cast("long")).cast("int").alias("b"), every("slices").alias("p"))
    right = asks.join(F.broadcast(sizes), "cell").select("cell", "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.col("slices").cast("long")).cast("int").alias("p"), every("parts").alias("b"))
    found = left.groupBy("cell", "b", "p").cogroup(right.groupBy("cell", "b", "p")).applyInPandas(_top(k, True), "query_id long, item_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def asked_cells(vectors: DataFrame, probes: int = 16, cell_rows: int = 4096, least_cells: int = 48, seed: int = 7) -> DataFrame | None:
    """``item_id, vector, cells``: the ``probes`` nearest cells of each item, its own first (see :func:`cell_topk`); None without items."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = settle(vectors.select("item_id", unit("vector").alias("vector")))
    n = rows.count()
    if not n:
        return None
    cells = min(n, max(least_cells, math.ceil(n / cell_rows)))
    sample = rows.sample(False, min(1.0, 64 * cells / n), seed) if 64 * cells < n else rows
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample.select(array_to_vector("vector").alias("features")))
    shared = rows.sparkSession.sparkContext.broadcast(np.array(model.clusterCenters()))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            x = np.array(batch["vector"].tolist()).reshape(len(batch), -1)
            order = np.argsort((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1, kind="stable")[:, :probes]
            yield batch.assign(cells=order.tolist())

    return settle(rows.mapInPandas(kernel, "item_id long, vector array<double>, cells array<int>"))


def session_vectors(samples: DataFrame, vectors: DataFrame, last: int = 5) -> DataFrame:
    """``session, vector``: unit vector of the last ``last`` events with a vector, weighted by ``1 / sqrt(recency + 1)``.

    Summed per dimension, so vectors of any width need one shuffle.
    """
    recent = F.slice(F.reverse("history_aids"), 1, last)
    rows = samples.select("session", F.posexplode(recent).alias("recency", "item_id")).join(vectors.select("item_id", "vector"), "item_id")
    weighted = rows.select("session", F.posexplode("vector").alias("d", "x"), (F.lit(1.0) / F.sqrt(F.col("recency") + 1.0)).alias("w"))
    sums = weighted.groupBy("session", "d").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("x"))
    arrays = sums.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("vector"))
    return arrays.select("session", unit("vector").alias("vector"))


def sampled_auc(samples: DataFrame, vectors: DataFrame, negatives: int = 100, seed: int = 7) -> DataFrame:
    """One row: share of hash-drawn items that score less than the target by the session's vector, over pairs and as a mean over sessions."""
    ids = number_rows(vectors.select("item_id"), "__i", "item_id")
    n = vectors.count()
    user = session_vectors(samples, vectors).withColumnRenamed("vector", "u")
    known = vectors.select("item_id", F.col("vector").alias("v"), norm("vector").alias("l"))
    score = F.when(F.col("l") > 0, dot("u", "v") / F.col("l")).otherwise(0.0)
    rows = samples.select("session", F.col("target_aid").alias("item_id")).join(known, "item_id").join(user, "session")
    rows = settle(rows.select(F.monotonically_increasing_id().alias("__row"), "session", F.col("item_id").alias("target"), "u", score.alias("s")))
    drawn = rows.select("__row", "target", F.explode(F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda j: F.pmod(F.xxhash64("session", j, F.lit(seed)), F.lit(n)))).alias("__i"))
    # the drawn items are known by number before vectors come to them
    pairs = drawn.join(ids, "__i").filter(F.col("item_id") != F.col("target")).select("__row", "item_id")
    scored = pairs.join(rows.drop("target"), "__row").join(known, "item_id").select("session", "s", score.alias("other"))
    won = F.when(F.col("s") > F.col("other"), 1.0).when(F.col("s") == F.col("other"), 0.5).otherwise(0.0)
    per = scored.groupBy("session").agg(F.sum(won).alias("w"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("w") / F.sum("n")).alias("auc"), F.avg(F.col("w") / F.col("n")).alias("gauc"), F.count(F.lit(1)).alias("sessions"))
