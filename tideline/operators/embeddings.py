"""Item embeddings: responses, directed PPMI, content terms, decomposition, fusion and skip-grams with negative sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.models import numbered, vector_rows
from tideline.operators.sessions import number_rows
from tideline.operators.vectors import unit
from tideline.session import settle


def response_score(ratio: str, seconds: str) -> Column:
    """Response to an item: logarithm of the watch ratio up to 3, times the root of the play time relative to 5 s, within bounds."""
    return F.log1p(F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col(ratio)))) * F.sqrt(F.greatest(F.lit(0.2), F.least(F.lit(5.0), F.col(seconds) / F.lit(5.0))))


def before_last(events: DataFrame, drop: int = 2, user: str = "user_id", time: str = "timestamp", order: str = "event_order") -> DataFrame:
    """Events without each user's last ``drop`` ones."""
    w = Window.partitionBy(user).orderBy(F.desc(time), F.desc(order))
    return events.withColumn("__back", F.row_number().over(w)).filter(F.col("__back") > drop).drop("__back")


def centred_responses(rows: DataFrame, user: str = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """``item, user, value``: mean response of each pair less the user's mean over items; zeros go."""
    pairs = rows.groupBy(F.col(item).alias("item"), F.col(user).alias("user")).agg(F.avg(score).alias("__m"))
    means = pairs.groupBy("user").agg(F.avg("__m").alias("__u"))
    return pairs.join(means, "user").select("item", "user", (F.col("__m") - F.col("__u")).alias("value")).filter(F.abs("value") > 1e-12)


def ppmi(events: DataFrame, window: int = 3, user: str = "user_id", item: str = "item_id", time: str = "timestamp", order: str = "event_order") -> DataFrame:
    """``src, dst, value``: positive pointwise mutual information of directed moves up to ``window`` steps, weighted by 1 / distance.

    Moves come from ``lead``; marginals are aggregates of the summed pairs; the total is one broadcast row.
    """
    w = Window.partitionBy(user).orderBy(time, order)
    nexts = F.array(*(F.struct(F.lead(item, d).over(w).alias("dst"), F.lit(1.0 / d).alias("w")) for d in range(1, window + 1)))
    moves = events.select(F.col(item).alias("src"), nexts.alias("n")).select("src", F.explode("n").alias("n")).filter(F.col("n.dst").isNotNull())
    sums = moves.groupBy("src", F.col("n.dst").alias("dst")).agg(F.sum("n.w").alias("v"))
    rows, cols = sums.groupBy("src").agg(F.sum("v").alias("r")), sums.groupBy("dst").agg(F.sum("v").alias("c"))
    total = rows.agg(F.sum("r").alias("t"))
    scored = sums.join(rows, "src").join(cols, "dst").join(F.broadcast(total))
    return scored.select("src", "dst", F.greatest(F.log(F.col("v") * F.col("t") / (F.col("r") * F.col("c"))), F.lit(0.0)).alias("value")).filter("value > 0")


def _grams(column: str, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(column) - (size - 1))
    return F.when(F.length(column) >= size, F.transform(starts, lambda i: F.substring(F.col(column), i, size))).otherwise(F.array().cast("array<string>"))


def char_tfidf(texts: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (1, 2), min_df: int = 2, max_terms: int | None = None) -> DataFrame:
    """``key, term, weight``: character grams of the lower-case text with runs of white space as one blank, by ``(1 + ln tf) * idf`` with unit rows.

    ``idf = ln((1 + n) / (1 + df)) + 1``. Terms in fewer than ``min_df`` texts go; ``max_terms`` keeps the most frequent, ties in their
    order. Null texts have no terms but count in ``n``.
    """
    clean = F.regexp_replace(F.lower(text), r"\s+", " ")
    grams = F.flatten(F.array(*(_grams("__t", s) for s in sizes)))
    rows = texts.select(key, clean.alias("__t"))
    counts = rows.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).filter(F.col("df") >= min_df)
    if max_terms is not None:
        df = df.orderBy(F.desc("all"), "term").limit(max_terms)
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    weighted = counts.join(df.select("term", "df"), "term").join(F.broadcast(n)).withColumn("w", (F.lit(1.0) + F.log("tf")) * (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + F.lit(1.0)))
    length = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return weighted.join(length, key).select(key, "term", (F.col("w") / F.col("l")).alias("weight"))


def svd(triplets: DataFrame, row: str, column: str, value: str, dimensions: int) -> DataFrame:
    """``item_id, vector``: left singular vectors times singular values of a sparse matrix, as unit vectors, by MLlib.

    The solver iterates on the Gram matrix of the fewer side, ``row`` or ``column``, whose singular vectors the driver holds. Rows and columns
    that are null don't count; repeated cells are summed. Runs jobs.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix

    cells = settle(triplets.select(F.col(row).cast("long").alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v")).dropna(subset=["r", "c"]).groupBy("r", "c").agg(F.sum("v").alias("v")))
    items, others = cells.select("r").distinct(), cells.select("c").distinct()
    turned = items.count() < others.count()
    index = number_rows(items, "__i", "r") if turned else number_rows(others, "__i", "c")
    width = index.count()
    if not width:
        return cells.sparkSession.createDataFrame([], "item_id long, vector array<double>")
    near, far = ("r", "c") if turned else ("c", "r")
    rows = settle(cells.join(index, near).groupBy(far).agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("c"), "v"))).alias("x")))
    k = max(1, min(dimensions, width - 1))
    numbered = rows.select((F.lit(0).cast("long") if turned else F.col("r")).alias("r"), "x")  # the turned matrix's rows need no numbers
    sparse = numbered.rdd.map(lambda r: (r.r, Vectors.sparse(width, [e.c for e in r.x], [e.v for e in r.x]))).toDF(["index", "vector"]).persist(StorageLevel.MEMORY_AND_DISK)  # the solver goes over it again and again
    found = IndexedRowMatrix(sparse, 1 if turned else 0, width).computeSVD(k, computeU=not turned)
    sigma = found.s.toArray()
    if turned:
        sparse.unpersist()
        ids = [r["r"] for r in index.orderBy("__i").collect()]
        own = (found.V.toArray() * sigma).tolist()
        return cells.sparkSession.createDataFrame(list(zip(ids, own, strict=True)), "item_id long, vector array<double>").select("item_id", unit("vector").alias("vector"))
    out = found.U.rows.map(lambda r: (int(r.index), [float(a * b) for a, b in zip(r.vector.toArray(), sigma, strict=True)])).toDF("item_id long, vector array<double>")
    return out.select("item_id", unit("vector").alias("vector"))


def pca_variance(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``dimension, variance, cumulative``: explained variance of principal components, by MLlib, which centres for this."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=dimensions, inputCol="f", outputCol="p").fit(vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f")))
    values = [float(x) for x in model.explainedVariance]
    return vectors.sparkSession.createDataFrame([(i + 1, v, sum(values[: i + 1])) for i, v in enumerate(values)], "dimension long, variance double, cumulative double")


def fuse(branches: dict[str, DataFrame], weights: dict[str, float], widths: dict[str, int]) -> DataFrame:
    """``item_id, vector``: branches of the same items, each centred, scaled to unit rows and weighted by the root of its share, put together as unit rows."""
    if set(branches) != set(weights) or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("branches and weights must agree and weights be positive")
    total, joined, parts = sum(weights.values()), None, []
    for name, df in branches.items():
        mean = df.agg(F.array(*(F.avg(F.col("vector")[i].cast("double")) for i in range(widths[name]))).alias("__mean"))
        own = df.join(F.broadcast(mean)).select("item_id", unit(F.zip_with("vector", "__mean", lambda x, m: x.cast("double") - m)).alias(name))
        joined = own if joined is None else joined.join(own, "item_id")
        parts.append(_scaled(name, float(np.sqrt(weights[name] / total))))
    return joined.select("item_id", unit(F.concat(*parts)).alias("vector"))


def _scaled(column: str, factor: float) -> Column:
    return F.transform(column, lambda x: x * F.lit(factor))


#: Items whose changes go in one message, and pairs a task trains on at least where there are as many.
BLOCK, TASK_PAIRS = 4096, 4 * 512


def _step(table: np.ndarray, seen: np.ndarray, ids: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Move the rows of a batch by their summed gradients, each divided by the root of its squares so far, so that frequent items don't run away."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    rows, total = ids[begins], np.add.reduceat(gradient[order], begins, axis=0)
    seen[rows] += (total**2).mean(axis=1)
    table[rows] += rate * total / np.sqrt(seen[rows] + 1e-8)[:, None]


def _sgns(shared, dims: int, negatives: int, rate: float, seed: int):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start_a, start_b, draw = shared.value
        centre, context = start_a.copy(), start_b.copy()
        seen = np.zeros(len(centre)), np.zeros(len(context))
        rng = np.random.default_rng(seed)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                a, b, w = part["a"].to_numpy(), part["b"].to_numpy(), part["weight"].to_numpy()
                other = np.searchsorted(draw, rng.random((len(a), negatives)))
                target = np.concatenate((b[:, None], other), axis=1)
                x, y = centre[a], context[target]
                hit = np.zeros(target.shape)
                hit[:, 0] = 1
                blocked = (target == b[:, None]) & (hit == 0)
                error = (hit - 1 / (1 + np.exp(-np.clip(np.einsum("bd,bnd->bn", x, y), -30, 30)))) * w[:, None]
                error[blocked] = 0
                _step(centre, seen[0], a, np.einsum("bn,bnd->bd", error, y), rate)
                _step(context, seen[1], target.ravel(), (error[..., None] * x[:, None, :]).reshape(-1, dims), rate)
        task = TaskContext.get().partitionId()
        for kind, now, before in (("a", centre, start_a), ("b", context, start_b)):
            for begin in range(0, len(now), BLOCK):
                moved = np.flatnonzero((now[begin : begin + BLOCK] != before[begin : begin + BLOCK]).any(axis=1)) + begin
                if len(moved):
                    yield pd.DataFrame({"kind": [kind], "block": [begin // BLOCK], "task": [task], "ids": [moved.tobytes()], "delta": [(now[moved] - before[moved]).tobytes()]})

    return kernel


def _mean_change(dims: int):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        """Mean of the tasks' changes of each item of a block, in the order of the tasks."""
        rows = rows.sort_values("task", ignore_index=True)
        parts = [np.frombuffer(x, dtype=np.int64) for x in rows["ids"]]
        ids, count = np.unique(np.concatenate(parts), return_counts=True)
        total = np.zeros((len(ids), dims))
        for own, delta in zip(parts, rows["delta"], strict=True):
            total[np.searchsorted(ids, own)] += np.frombuffer(delta).reshape(-1, dims)
        return pd.DataFrame({"kind": rows["kind"].iloc[:1], "block": rows["block"].iloc[:1], "task": [0], "ids": [ids.tobytes()], "delta": [(total / count[:, None]).tobytes()]})

    return kernel


def item2vec(pairs: DataFrame, dims: int = 32, epochs: int = 3, negatives: int = 5, rate: float = 0.05, seed: int = 7, max_items: int = 2_000_000, schedule: Callable[[int], float] | None = None, checkpoint: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> DataFrame:
    """``item_id, vector``: skip-grams with negative sampling on weighted pairs ``center, context, weight``, the weights divided by their mean.

    Frequent items are thinned before pairs are made (:func:`clean.subsample_frequent`). Both matrices are broadcast, each task trains on
    its pairs, and the means of the tasks' changes per item, formed in tasks by blocks of items, are added after each epoch; ``schedule``
    gives a factor of the rate per epoch, ``checkpoint`` gets each epoch's number, the items and their vectors. More than ``max_items`` items
    raise ValueError, as the matrices must fit on the driver and in each task. Runs a job per epoch.
    """
    spark = pairs.sparkSession
    counts = pairs.filter(F.col("center").isNotNull()).groupBy(F.col("center").cast("long").alias("item_id")).agg(F.count(F.lit(1)).alias("n")).orderBy("item_id").limit(max_items + 1)
    found = [(np.frombuffer(r["i"], dtype=np.int64), np.frombuffer(r["n"], dtype=np.int64)) for r in counts.mapInPandas(_packed, "i binary, n binary").toLocalIterator()]
    ids, often = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
    if len(ids) > max_items:
        raise ValueError("too many items for one matrix")
    if not len(ids):
        return spark.createDataFrame([], "item_id long, vector array<double>")
    mean = pairs.agg(F.avg("weight")).first()[0] or 1.0
    rows = numbered(pairs.select(F.col("center").alias("a"), F.col("context").alias("b"), (F.col("weight").cast("double") / F.lit(mean)).alias("weight")), ids, (), ("a", "b"))
    tasks = max(1, min(int(often.sum()) // TASK_PAIRS, max(pairs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)))
    rows = settle(rows.filter("a > 0 AND b > 0").select((F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b"), "weight").repartition(tasks, "a").sortWithinPartitions("a"))
    rng = np.random.default_rng(seed)
    centre, context = (rng.random((len(ids), dims)) - 0.5) / dims, np.zeros((len(ids), dims))
    draw = np.cumsum(often.astype(np.float64) ** 0.75)
    draw = draw / draw[-1]
    draw[-1] = 1.0
    schema = "kind string, block long, task long, ids binary, delta binary"
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((centre, context, draw))
        step = rate * (schedule(epoch) if schedule else 1.0)
        changes = rows.mapInPandas(_sgns(shared, dims, negatives, step, seed + epoch), schema)
        centre, context = centre.copy(), context.copy()
        for part in changes.groupBy("kind", "block").applyInPandas(_mean_change(dims), schema).toLocalIterator():  # a block at a time
            own = np.frombuffer(part["ids"], dtype=np.int64)
            (centre if part["kind"] == "a" else context)[own] += np.frombuffer(part["delta"]).reshape(len(own), dims)
        shared.destroy()
        if checkpoint:
            checkpoint(epoch, ids, centre)
    return vector_rows(spark, ids, centre)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"i": [frame["item_id"].to_numpy(dtype=np.int64).tobytes()], "n": [frame["n"].to_numpy(dtype=np.int64).tobytes()]})


def text_vectors(texts: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray] | None = None, dimensions: int = 64, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``<key>, vector``: unit vectors of texts by ``embed``, which gets batches of texts in the tasks and gives a row of numbers for each.

    Without it, character grams by :func:`char_tfidf` reduced by :func:`svd` (keys are bigint then). Null and blank texts have no vector.
    """
    if embed is None:
        return svd(char_tfidf(texts, key, text, sizes), key, "term", "weight", dimensions).withColumnRenamed("item_id", key)
    clean = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    rows = texts.select(F.col(key), clean.alias("__t")).filter(F.col("__t").isNotNull() & (F.col("__t") != ""))

    @F.pandas_udf("array<double>")
    def vector(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        x = np.asarray(embed(column.tolist()), dtype=np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series((x / np.where(length > 0, length, 1.0)).tolist())

    return rows.select(key, vector("__t").alias("vector"))


def warm_start(items: DataFrame, vectors: DataFrame, width: int, seed: int = 7) -> DataFrame:
    """``item_id, vector, warm``: the known vector of each item, a small hash-drawn one otherwise."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda d: (F.shiftrightunsigned(F.xxhash64("item_id", d, F.lit(seed)), 11) / F.lit(float(1 << 53)) - F.lit(0.5)) / F.lit(float(width)))
    return items.select("item_id").join(vectors.select("item_id", F.col("vector").cast("array<double>").alias("__v")), "item_id", "left").select("item_id", F.coalesce("__v", drawn).alias("vector"), F.col("__v").isNotNull().alias("warm"))
