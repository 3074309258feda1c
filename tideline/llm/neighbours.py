"""The most similar vectors of every vector."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.hnsw import Hnsw
from tideline.session import settle, spread

RESULT = "item long, neighbour long, similarity double"
#: Centres a cell that is too large gets at a time, and vectors they are fitted on for each.
PIECES, PER_PIECE = 256, 64
#: Times that cells are divided by centres, which is enough for 256 to that power cells; what is too large then differs by rounding only.
ROUNDS = 8
#: Groups of equal vectors whose lists are broadcast to their members at most.
MOST_BROADCAST = 50_000


def valid_vectors(exports: DataFrame, item: str, vector: str, version: str, width: int) -> DataFrame:
    """``item, vector``: each item's vector of its highest version, if it has ``width`` finite numbers that aren't all zero.

    An item whose newest vector is invalid has none. Repeated rows count once; of different vectors of one version the
    greatest by element order stays (null is least, as is a null version). Rows with a null item don't count.
    """
    newest = exports.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.max(F.struct(F.col(version).alias("e"), F.col(vector).cast("array<float>").alias("v"))).alias("m"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return newest.select("item", F.col("m.v").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == width)).filter(usable).select("item", F.col("v").alias("vector"))


def _unit(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = lists.flatten() if isinstance(lists, pa.Array) else lists.combine_chunks().flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(largest > 0, largest, 1.0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _cells(shared, probes: int, gap: float, width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell, the vectors that are nearest to its centre and those that only ask it."""
        own, asked = np.zeros(len(shared.value), dtype=np.int64), np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                cells, asking = _asked(_unit(batch.column(1), width), shared.value, probes, gap)
                own += np.bincount(cells[:, 0], minlength=len(own))
                asked += np.bincount(cells[:, 1:][asking[:, 1:]], minlength=len(own))
        some = np.flatnonzero(own + asked)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some]), pa.array(asked[some])], names=["cell", "own", "asked"])

    return kernel


def _asked(x: np.ndarray, centres: np.ndarray, probes: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cells of each vector, best first, and which of them it asks; the first is its own."""
    near = x.astype(np.float32) @ centres.T
    take = min(probes, near.shape[1])
    best = np.argpartition(-near, take - 1, axis=1)[:, :take]
    score = np.take_along_axis(near, best, axis=1)
    order = np.argsort(-score, axis=1)
    best, score = np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)
    return best, score >= score[:, :1] - gap


def _members(shared, chance: dict[int, float], width: int, seed: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bounded random part of the vectors of the given cells."""
        for n, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1), width).astype(np.float32)
            cell = np.argmax(x @ shared.value.T, axis=1)
            wanted = np.array([chance.get(c, 0.0) for c in cell.tolist()])
            taken = np.flatnonzero(np.random.default_rng((seed, n, int(batch.column(0)[0].as_py()) & 0xFFFFFFFF)).random(len(cell)) < wanted)
            yield pa.RecordBatch.from_arrays([pa.array(cell[taken]), pa.array([r.tobytes() for r in x[taken]], pa.binary())], names=["cell", "raw"])

    return kernel


def _finer(pieces: dict[int, int], width: int, seed: int):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.frombuffer(b"".join(rows["raw"]), dtype=np.float32).reshape(-1, width), axis=0)
        cell = int(rows["cell"].iloc[0])
        centres = np.unique(_kmeans(x, pieces[cell], np.random.default_rng((seed, cell))).astype(np.float32), axis=0)
        return pd.DataFrame({"cell": cell, "raw": [c.tobytes() for c in centres]})

    return kernel


def _fit_cells(rows: DataFrame, total: int, shard_rows: int, probes: int, gap: float, sample_rows: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of cells of at most ``2 * shard_rows`` vectors where centres can tell them apart, and the cells' own and asking vectors.

    The first centres come from a sample on the driver; a cell that is too large gets up to :data:`PIECES` centres of its own from a
    sample of its vectors, fitted in a task, and so on. A cell whose vectors centres can't tell apart stays as it is.
    """
    spark = rows.sparkSession
    taken = rows.select("vector").sample(False, min(1.0, sample_rows / total), seed).limit(2 * sample_rows).toPandas()["vector"]
    sample = _unit(pa.array(list(taken), pa.list_(pa.float32())), width).astype(np.float32) if len(taken) else np.eye(1, width, dtype=np.float32)
    centres = _kmeans(sample, max(1, min(math.ceil(total / shard_rows), len(sample) // 32)), np.random.default_rng(seed)).astype(np.float32)
    stuck: set[bytes] = set()
    for attempt in range(ROUNDS):
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(centres))
        own, asked = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
        for r in rows.mapInArrow(_cells(shared, probes, gap, width), "cell long, own long, asked long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("asked").alias("asked")).collect():
            own[r["cell"]], asked[r["cell"]] = r["own"], r["asked"]
        large = {int(c): min(PIECES, math.ceil(own[c] / shard_rows)) for c in np.flatnonzero(own > 2 * shard_rows) if centres[c].tobytes() not in stuck}
        if not large or attempt == ROUNDS - 1:
            return centres, own, asked
        chance = {c: min(1.0, PER_PIECE * k / float(own[c])) for c, k in large.items()}
        finer: dict[int, list[np.ndarray]] = {c: [] for c in large}
        for r in rows.mapInArrow(_members(shared, chance, width, seed), "cell long, raw binary").groupBy("cell").applyInPandas(_finer(large, width, seed), "cell long, raw binary").collect():
            finer[r["cell"]].append(np.frombuffer(r["raw"], dtype=np.float32))
        stuck |= {centres[c].tobytes() for c, found in finer.items() if len(found) < 2}
        divided = [c for c, found in finer.items() if len(found) > 1]
        centres = np.concatenate([np.delete(centres, divided, axis=0), *(np.stack(finer[c]) for c in divided)])


def _route(shared, first: np.ndarray, parts: np.ndarray, slices: np.ndarray, hot: bool, probes: int, gap: float, width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per shard that indexes (``own``) or only asks for the vector; the vector goes on as 4-byte unit numbers. With ``hot``, the
        rows that ask shards with more askers than one task takes, by slice; else all other rows."""
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column(0).to_numpy()
            x = _unit(batch.column(1), width)
            best, asking = _asked(x, shared.value, probes, gap)
            rows, columns = np.nonzero(asking)
            cell, own = best[rows, columns], columns == 0
            part = items[rows] % parts[cell]  # of a cell that centres can't divide, all parts are asked
            more = np.repeat(np.arange(len(rows)), parts[cell] - 1)
            step = np.arange(len(more)) - np.repeat(np.cumsum(parts[cell] - 1) - (parts[cell] - 1), parts[cell] - 1) + 1
            part = np.concatenate((part, (part[more] + step) % parts[cell[more]]))
            rows, cell, own = np.concatenate((rows, rows[more])), np.concatenate((cell, cell[more])), np.concatenate((own, np.zeros(len(more), dtype=bool)))
            shard = first[cell] + part
            kept = ((slices[shard] > 0) & ~own) == hot
            rows, shard, own = rows[kept], shard[kept], own[kept]
            piece = items[rows] // 7 % np.maximum(slices[shard], 1)
            raw = x.astype(np.float32)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(piece.astype(np.int64)), pa.array(own), pa.array(items[rows]), pa.array([r.tobytes() for r in raw], pa.binary())], names=["shard", "slice", "own", "item", "raw"])

    return kernel


def _answers(asker: np.ndarray, asking: np.ndarray, items: np.ndarray, x: np.ndarray, found: np.ndarray, least: float) -> pd.DataFrame:
    """Exact similarities of what a graph found; ``asker`` are the items that ask, ``asking`` their vectors."""
    row, column = np.nonzero(found >= 0)
    other = found[row, column]
    similarity = np.empty(len(row))
    for i in range(0, len(row), 1 << 18):
        a, b = asking[row[i : i + (1 << 18)]].astype(np.float64), x[other[i : i + (1 << 18)]].astype(np.float64)
        similarity[i : i + (1 << 18)] = np.einsum("id,id->i", a, b) / np.sqrt(np.einsum("id,id->i", a, a) * np.einsum("id,id->i", b, b))
    good = similarity >= least
    return pd.DataFrame({"item": asker[row[good]], "neighbour": items[other[good]], "similarity": similarity[good]})


def _floats(raw: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, width)


def _build(k: int, m: int, build_width: int, ef: int, least: float, width: int, hot: frozenset[int]):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        """A shard's answers to its own vectors and, unless it is hot, to all others; of a hot shard the graph, too."""
        rows = rows.sort_values(["own", "item"], ascending=[False, True], ignore_index=True)
        x, items, n, shard = _floats(rows["raw"], width), rows["item"].to_numpy(), int(rows["own"].sum()), int(rows["shard"].iloc[0])
        if n == 0:
            return pd.DataFrame({"item": [], "neighbour": [], "similarity": [], "shard": [], "graph": []})
        graph = Hnsw(x[:n], m, build_width)
        found, _ = graph.search_own(k, ef)
        if len(x) > n:
            found = np.concatenate((found, graph.search(x[n:], k, ef)[0]))
        out = _answers(items, x, items, x, found, least).assign(shard=shard, graph=None)
        if shard in hot:
            out = pd.concat([out, pd.DataFrame({"item": [0], "neighbour": [0], "similarity": [0.0], "shard": [shard], "graph": [pickle.dumps((graph, items[:n]))]})])
        return out

    return kernel


def _ask(k: int, ef: int, least: float, width: int):
    def kernel(graphs: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
        """Answers of a stored graph to one slice of its askers."""
        if graphs.empty or askers.empty:
            return pd.DataFrame({"item": [], "neighbour": [], "similarity": []})
        graph, items = pickle.loads(graphs["graph"].iloc[0])
        x = np.empty_like(graph.x)
        x[graph.order] = graph.x
        asking = _floats(askers["raw"], width)
        return _answers(askers["item"].to_numpy(), asking, items, x, graph.search(asking, k, ef)[0], least)

    return kernel


def nearest(vectors: DataFrame, k: int, item: str = "item", vector: str = "vector", width: int = 64, shard_rows: int = 12_000, probes: int = 4, gap: float = 2.0, m: int = 12, build_width: int = 24, ef: int = 16, least: float = -1.0, sample_rows: int = 40_000, ask_rows: int | None = None, seed: int = 5) -> DataFrame:
    """``item, neighbour, similarity``: about the ``k`` most similar other vectors of every vector by cosine, as found by HNSW.

    ``vectors`` has one row per item (bigint), each vector ``width`` finite numbers that aren't all zero (see
    :func:`valid_vectors`). Only neighbours with a similarity of ``least`` or more come out; similarities are exact, the
    search is approximate. Fewer other vectors than ``k``: all that are found. Empty input: no rows.

    Items with the same vector are told apart by their smallest ``k + 1`` only: one of them is indexed and asks, and its answers, their copies
    among them, go to all, so a group of copies costs what one vector does.

    Vectors go to shards of about ``shard_rows`` around centres; every vector is indexed, in the shard of its nearest centre, and
    asks the ``probes`` nearest shards whose centres are at most ``gap`` less similar than the nearest. Centres are fitted on a
    sample of at most ``sample_rows`` vectors; a cell with far more vectors than a shard gets centres of its own, fitted in tasks, as often
    as needed, and one that centres can't divide is divided by item, all parts being asked. Each shard's task builds a navigable
    small-world graph in flat arrays and searches it in batches. A shard that more than ``ask_rows`` (default: four times ``shard_rows``)
    other vectors ask stores its graph, and slices of its askers search it in tasks of their own. The shard results are merged by
    similarity, then the smaller item. ``probes`` and ``ef`` (beam width) set the accuracy. The driver holds the centres, one per shard.
    Runs jobs (row count, sample, cell sizes).
    """
    spark = vectors.sparkSession
    rows = settle(vectors.select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<float>").alias("vector")).withColumn("h", F.xxhash64("vector")))
    total = rows.count()
    if total == 0:
        return spark.createDataFrame([], RESULT)
    search = lambda df, n: _search(df, n, k, width, shard_rows, probes, gap, m, build_width, ef, least, sample_rows, 4 * shard_rows if ask_rows is None else ask_rows, seed)
    copies = settle(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    groups = copies.count()
    if not groups:
        return search(rows.drop("h"), total)
    small = lambda df: F.broadcast(df) if groups <= MOST_BROADCAST else df
    same = rows.join(small(copies), "h", "left_semi")
    first = Window.partitionBy("h", "vector").orderBy("item")
    members = same.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k + 1)
    members = settle(members.groupBy("h", "vector").agg(F.min("item").alias("rep"), F.array_sort(F.collect_list("item")).alias("members")))
    others = settle(same.select("item").join(small(members.select(F.col("rep").alias("item"))), "item", "left_anti"))
    many = others.count()
    index = rows.drop("h").join(F.broadcast(others) if many <= MOST_BROADCAST else others, "item", "left_anti")
    found = search(index if many <= MOST_BROADCAST else settle(index), total - many)
    lists = members.select(F.col("rep").alias("neighbour"), "members")
    wide = found.join(small(lists), "neighbour", "left").select("item", F.explode(F.coalesce("members", F.array("neighbour"))).alias("neighbour"), "similarity")
    own = members.select(F.col("rep").alias("item"), F.explode("members").alias("neighbour"), F.lit(1.0).alias("similarity")).filter(F.lit(1.0) >= least)
    best = Window.partitionBy("item").orderBy(F.desc("similarity"), "neighbour")
    ranked = settle(wide.unionByName(own).withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k + 1))  # one more, as a member may be in it
    single = ranked.join(small(members.select(F.col("rep").alias("item"))), "item", "left_anti").filter(F.col("__r") <= k).drop("__r")
    kept = ranked.join(small(members.select(F.col("rep").alias("item"), "h", "vector")), "item").groupBy("h", "vector").agg(F.array_sort(F.collect_list(F.struct("__r", "neighbour", "similarity"))).alias("list"))
    each = same.join(small(kept), ["h", "vector"]).select("item", F.explode(F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("item")), 1, k)).alias("x"))
    return single.unionByName(each.select("item", F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity")))


def _search(rows: DataFrame, total: int, k: int, width: int, shard_rows: int, probes: int, gap: float, m: int, build_width: int, ef: int, least: float, sample_rows: int, ask_rows: int, seed: int) -> DataFrame:
    """:func:`nearest` for settled rows, without regard to equal vectors."""
    spark = rows.sparkSession
    centres, own, asked = _fit_cells(rows, total, shard_rows, probes, gap, sample_rows, width, seed)
    parts = np.maximum(1, np.where(own > 2 * shard_rows, np.ceil(own / shard_rows), 1)).astype(np.int64)
    first = np.cumsum(parts) - parts
    askers = np.repeat(asked + np.where(parts > 1, own, 0), parts)  # of a divided cell, the other parts' vectors ask, too
    slices = np.where(askers > ask_rows, np.ceil(askers / ask_rows), 0).astype(np.int64)
    hot = frozenset(np.flatnonzero(slices).tolist())
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(centres))
    spread_rows = spread(rows, "item")
    routed = lambda asking: spread_rows.mapInArrow(_route(shared, first, parts, slices, asking, probes, gap, width), "shard long, slice long, own boolean, item long, raw binary")
    found = routed(False).repartition(4 * len(slices), "shard").groupBy("shard").applyInPandas(_build(k, m, build_width, ef, least, width, hot), f"{RESULT}, shard long, graph binary")
    if hot:
        built = settle(found)
        number = spark.createDataFrame([(h, int(slices[h])) for h in sorted(hot)], "shard long, n long")  # as the centres, a row per shard at most
        graphs = built.filter(F.col("graph").isNotNull()).join(F.broadcast(number), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice"), "graph")
        pieces = int(slices.sum())
        answers = graphs.repartition(4 * pieces, "shard", "slice").groupBy("shard", "slice").cogroup(routed(True).repartition(4 * pieces, "shard", "slice").groupBy("shard", "slice")).applyInPandas(_ask(k, ef, least, width), RESULT)
        found = built.filter(F.col("graph").isNull()).select("item", "neighbour", "similarity").unionByName(answers)
    found = found.select("item", "neighbour", "similarity")
    best = Window.partitionBy("item").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= k).drop("__r")
