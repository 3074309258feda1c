"""Hierarchical item codes: assignment, residual K-means, collisions, diagnostics, prefix tries and beam search.

A code table has ``item_id`` and integer columns ``c1 .. cL``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import settle


def levels(codes: DataFrame) -> list[str]:
    """Code columns in order."""
    found = [c for c in codes.columns if c[0] == "c" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def collision_tail(codes: DataFrame) -> DataFrame:
    """Add ``tail``: 0, 1, ... over the items of one code, by item."""
    w = Window.partitionBy(*levels(codes)).orderBy("item_id")
    return codes.withColumn("tail", (F.row_number().over(w) - 1).cast("long"))


def collision_rate(codes: DataFrame) -> DataFrame:
    """One row: items, different codes and the share of items beyond one per code."""
    cells = codes.groupBy(*levels(codes)).agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("unique_codes"), F.max("n").alias("largest_bucket")).withColumn("collision_rate", F.lit(1.0) - F.col("unique_codes") / F.col("items"))


def codebook_stats(codes: DataFrame, sizes: list[int]) -> DataFrame:
    """Per level: used tokens, utilisation, entropy in bits and relative to the greatest possible, largest bucket."""
    cols = levels(codes)
    size = F.create_map(*(F.lit(x) for i, s in enumerate(sizes) for x in (i, s)))
    tokens = codes.select(F.posexplode(F.array(*cols)).alias("level", "token")).groupBy("level", "token").agg(F.count(F.lit(1)).alias("n"))
    total = tokens.groupBy("level").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"), F.count(F.lit(1)).alias("used_tokens"), F.max("n").alias("largest_bucket"))
    entropy = F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t")
    greatest = F.log2(size[F.col("level")].cast("double"))
    return total.select(F.col("level").cast("long").alias("level"), "used_tokens", (F.col("used_tokens") / size[F.col("level")]).alias("utilization"), entropy.alias("entropy_bits"), F.when(greatest > 0, entropy / greatest).otherwise(1.0).alias("normalized_entropy"), "largest_bucket")


def compare_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two :func:`codebook_stats`, right less left, per level both have."""
    measures = ["used_tokens", "utilization", "entropy_bits", "normalized_entropy", "largest_bucket"]
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, "level").select("level", *((F.col(f"b.{m}") - F.col(f"a.{m}")).alias(m) for m in measures))


def category_pairs(codes: DataFrame, label: str) -> DataFrame:
    """Per level: how often two items of one category, and of different ones, agree in the token and in the prefix, with the lift of prefixes.

    Pairs are counted from group sizes, never formed. Items with a null or blank label don't count.
    """
    cols = levels(codes)
    rows = codes.filter(F.col(label).isNotNull() & (F.trim(F.col(label).cast("string")) != "")).select(label, *cols)
    pairs = lambda: F.sum(F.col("n") * (F.col("n") - 1) / 2)

    def count(*keys) -> DataFrame:
        return (rows.groupBy(*keys) if keys else rows).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(pairs(), F.lit(0.0)).alias("p"))

    within, every = count(label), count()
    out = None
    for i, c in enumerate(cols):
        prefix = cols[: i + 1]
        one = within.withColumnRenamed("p", "w")
        for name, keys in (("a", ()), ("tw", (label, c)), ("tg", (c,)), ("pw", (label, *prefix)), ("pg", tuple(prefix))):
            one = one.join((every if name == "a" else count(*keys)).withColumnRenamed("p", name))
        cross = F.col("a") - F.col("w")
        same, other = F.try_divide("pw", "w"), F.try_divide(F.col("pg") - F.col("pw"), cross)
        one = one.select(F.lit(i + 1).cast("long").alias("level"), F.try_divide("tw", "w").alias("token_same"), F.try_divide(F.col("tg") - F.col("tw"), cross).alias("token_other"), same.alias("prefix_same"), other.alias("prefix_other"), (same / F.greatest(other, F.lit(1e-12))).alias("lift"))
        out = one if out is None else out.unionByName(one)
    return out


def mutual_information(rows: DataFrame, left: str, right: str) -> DataFrame:
    """One row: mutual information of two labels divided by the mean of their entropies."""
    cells = rows.groupBy(left, right).agg(F.count(F.lit(1)).cast("double").alias("n"))
    xlogx = lambda: F.sum(F.col("n") * F.log(F.col("n")))
    joint = cells.agg(F.sum("n").alias("t"), xlogx().alias("j"))
    one = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(xlogx().alias(name))
    r = joint.join(one(left, "x")).join(one(right, "y"))
    h = lambda c: F.log("t") - F.col(c) / F.col("t")
    return r.select(F.coalesce(F.try_divide(h("x") + h("y") - h("j"), (h("x") + h("y")) / F.lit(2.0)), F.lit(1.0)).alias("nmi"))


def assign(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``item_id, c1 .. cL``: the nearest centroid of each level's codebook to what the levels before left over; ties to the lower token.

    The codebooks are broadcast; their size is that of the codebooks, not of the data.
    """
    shared = vectors.sparkSession.sparkContext.broadcast([np.asarray(c, dtype=np.float64) for c in codebooks])
    names = [f"c{i + 1}" for i in range(len(codebooks))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                out = []
                for book in shared.value:
                    distance = (left**2).sum(axis=1)[:, None] - 2 * left @ book.T + (book**2).sum(axis=1)
                    token = np.round(distance, 9).argmin(axis=1)
                    left = left - book[token]
                    out.append(pa.array(token.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["item_id", *names])

    return vectors.select("item_id", "vector").mapInArrow(kernel, "item_id long, " + ", ".join(f"{n} long" for n in names))


def fit_codebooks(vectors: DataFrame, sizes: list[int], seed: int = 7, rounds: int = 20) -> list[np.ndarray]:
    """Codebooks of residual K-means, level by level, by MLlib on all vectors; runs a job per round."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    books: list[np.ndarray] = []
    left = vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    for level, size in enumerate(sizes):
        rows = left.select(array_to_vector("vector").alias("features"))
        model = KMeans(k=size, seed=seed + level, maxIter=rounds).fit(rows)
        book = np.array(model.clusterCenters())
        books.append(book)
        if level + 1 < len(sizes):
            centres = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in book))
            token = assign(left, [book]).select("item_id", "c1")
            left = settle(left.join(token, "item_id").select("item_id", F.zip_with("vector", centres[F.col("c1")], lambda a, b: a - b).alias("vector")))
    return books


def balanced_tokens(distance: np.ndarray, ratio: float) -> tuple[np.ndarray, int]:
    """A token per row with at most ``ceil(rows / tokens * ratio)`` rows each.

    Rows ask for tokens in the order of their distances; a full token keeps those that would lose most by going to their next choice,
    the others ask on. Done for a catalogue on the driver.
    """
    rows, tokens = distance.shape
    capacity = max(1, math.ceil(rows / tokens * ratio))
    preference = np.argsort(distance, axis=1, kind="stable")
    place = np.zeros(rows, dtype=np.int64)
    loss = np.full(rows, np.inf)
    held = np.full(rows, -1, dtype=np.int64)
    asking = np.arange(rows)
    while len(asking):
        held[asking] = preference[asking, place[asking]]
        more = place[asking] + 1 < tokens
        asked = asking[more]
        loss[asked] = distance[asked, preference[asked, place[asked] + 1]] - distance[asked, held[asked]]
        loss[asking[~more]] = np.inf
        order = np.lexsort((np.arange(rows), -loss, held))
        starts = np.searchsorted(held[order], held[order], side="left")
        out = order[(np.arange(rows) - starts) >= capacity]
        place[out] += 1
        asking = out
    return held, capacity


def match(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost, by shortest augmenting paths; rows may not outnumber columns."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, column, base = row, -1, 0.0
        while True:
            through = base + cost[at] - row_price[at] - column_price
            shorter = ~done & (through < reach)
            reach[shorter], via[shorter] = through[shorter], column
            column = int(np.where(done, np.inf, reach).argmin())
            base, done[column] = reach[column], True
            if owner[column] < 0:
                break
            at = owner[column]
        closed = np.flatnonzero(done)
        row_price[row] += base
        for c in closed:
            if c != column:
                row_price[owner[c]] += base - reach[c]
            column_price[c] += reach[c] - base
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def resolve_last_level(prefix: np.ndarray, token: np.ndarray, distance: np.ndarray, capacity: int | None = None) -> np.ndarray:
    """Last tokens such that items of one prefix have different ones where they are few enough, at least added distance.

    Only tokens below ``capacity`` are offered where enough of them are free; else being different counts for more. Larger groups,
    which have less choice, come first.
    """
    token = token.copy()
    _, group = np.unique(prefix, axis=0, return_inverse=True)
    group = group.ravel()
    size = np.bincount(group)
    held = np.bincount(token, minlength=distance.shape[1])
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(size)[:-1])
    for g in np.argsort(-size, kind="stable"):
        own = members[g]
        if not 1 < len(own) <= distance.shape[1] or len(np.unique(token[own])) == len(own):
            continue
        held -= np.bincount(token[own], minlength=len(held))
        free = np.arange(len(held)) if capacity is None else np.flatnonzero(held < capacity)
        if len(free) < len(own):
            free = np.arange(len(held))
        token[own] = free[match(distance[np.ix_(own, free)])]
        held += np.bincount(token[own], minlength=len(held))
    return token


@dataclass
class Quantiser:
    """``codes`` (``item_id, c1 .. cL``), a codebook per level, what :func:`prepare` did, and measures per level."""

    codes: DataFrame
    books: list[np.ndarray]
    preparation: dict
    measures: list[dict]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "total", "square"])


def prepare(vectors: DataFrame, dimensions: int | None = None, whiten: bool = True, unit: bool = True) -> dict:
    """State of the preparation of vectors: principal components (None: none), their variances, whether to whiten and to scale to length 1.

    Each task gives its sums and products once, a matrix of the vectors' width; the components are fitted from their total. The largest
    entry of a component is positive. Nulls among the numbers raise ValueError.
    """
    state: dict = {"dimensions": None, "whiten": bool(whiten), "unit": bool(unit)}
    if dimensions is None:
        return state
    parts = vectors.select(F.col("vector").cast("array<double>")).mapInArrow(_moments, "n long, total array<double>, square array<double>").collect()
    n = sum(p.n for p in parts)
    if not n:
        raise ValueError("no vectors")
    mean = sum(np.array(p.total) for p in parts) / n
    square = sum(np.array(p.square).reshape(len(mean), -1) for p in parts)
    values, axes = np.linalg.eigh((square - n * np.outer(mean, mean)) / max(1, n - 1))
    kept = max(1, min(int(dimensions), len(mean), n))
    order = np.argsort(-values)[:kept]
    axes = axes[:, order].T
    axes = axes * np.sign(axes[np.arange(kept), np.abs(axes).argmax(axis=1)])[:, None]
    return state | {"dimensions": kept, "mean": mean, "axes": axes, "variance": np.maximum(values[order], 0.0)}


def prepared(vectors: DataFrame, state: dict) -> DataFrame:
    """``item_id, vector`` after the steps of :func:`prepare`."""
    shared = vectors.sparkSession.sparkContext.broadcast(state)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if s["dimensions"] is not None:
                    x = (x - s["mean"]) @ s["axes"].T
                    if s["whiten"]:
                        x = x / np.sqrt(np.maximum(s["variance"], 1e-12))
                if s["unit"]:
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    x = x / np.where(length > 0, length, 1.0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["item_id", "vector"])

    return vectors.select(F.col("item_id").cast("long").alias("item_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(kernel, "item_id long, vector array<double>")


def encode(vectors: DataFrame, found: Quantiser) -> DataFrame:
    """``item_id, c1 .. cL`` of new items by a fitted quantiser: prepared as its items were, the nearest centroid per level, balance aside."""
    return assign(prepared(vectors, found.preparation), found.books)


def fit_quantiser(vectors: DataFrame, sizes: list[int], ratio: float | None = 1.25, unique: bool = True, dimensions: int | None = None, whiten: bool = True, unit: bool = True, seed: int = 7, max_items: int = 2_000_000) -> Quantiser:
    """Residual K-means over prepared vectors, with codebooks from :func:`fit_codebooks`.

    With a ``ratio``, no token of a level holds more than its share times that; with ``unique``, items of one prefix get different last
    tokens, at the least added distance, of those with room as far as these suffice. Both look at the whole catalogue in turn and are done
    on the driver; more than ``max_items`` items then raise ValueError. Without them items are assigned in parallel, any number of them.
    """
    if not sizes or min(sizes) < 2:
        raise ValueError("codebooks need two tokens or more")
    state = prepare(vectors, dimensions, whiten, unit)
    ready = settle(prepared(vectors, state))
    books = fit_codebooks(ready, sizes, seed)
    if ratio is None and not unique:
        return Quantiser(assign(ready, books), books, state, [])
    rows = ready.orderBy("item_id").limit(max_items + 1).toPandas()
    if len(rows) > max_items:
        raise ValueError("too many items to be balanced on the driver")
    left = np.array(rows["vector"].tolist())
    tokens, measures = [], []
    for i, book in enumerate(books):
        distance = (left**2).sum(axis=1)[:, None] - 2 * left @ book.T + (book**2).sum(axis=1)
        token, capacity = (distance.argmin(axis=1), len(left)) if ratio is None else balanced_tokens(distance, ratio)
        changed = 0
        if unique and i == len(books) - 1 and tokens:
            different = resolve_last_level(np.stack(tokens, axis=1), token, distance, capacity if ratio is not None else None)
            token, changed = different, int((different != token).sum())
        tokens.append(token)
        left = left - book[token]
        counts = np.bincount(token, minlength=len(book))
        measures.append({"level": i + 1, "capacity": int(capacity), "largest_bucket": int(counts.max()), "smallest_bucket": int(counts.min()), "used_tokens": int((counts > 0).sum()), "mean_square_error": float((left**2).sum(axis=1).mean()), "reassigned": changed})
    schema = "item_id long, " + ", ".join(f"c{i + 1} long" for i in range(len(tokens)))
    codes = vectors.sparkSession.createDataFrame(list(zip(rows["item_id"].tolist(), *(t.tolist() for t in tokens), strict=True)), schema)
    return Quantiser(codes, books, state, measures)


def rq_kmeans(vectors: DataFrame, sizes: list[int], ratio: float | None = 1.25, unique: bool = True, seed: int = 7) -> DataFrame:
    """``item_id, c1 .. cL`` of :func:`fit_quantiser` over unit vectors."""
    return fit_quantiser(vectors, sizes, ratio, unique, seed=seed).codes


def _centres(size: int, seed: int):
    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["vector"].tolist(), dtype=np.float64)
        centres = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:size]], axis=0)
        for _ in range(15):
            own = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            centres = np.stack([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        return pd.DataFrame({"prefix": [group["prefix"].iloc[0]] * len(centres), "token": np.arange(len(centres)), "centre": centres.tolist()})

    return cluster


def tree_codes(vectors: DataFrame, sizes: list[int], seed: int = 7, fit_rows: int = 20_000) -> DataFrame:
    """``item_id, c1 .. cL`` where each level clusters the items of one prefix on their own; the first level by MLlib.

    A prefix' centres are fitted in a task on at most ``fit_rows`` of its items, those least by a hash; all items are then assigned in
    parallel, each by its prefix' centres, of which there are as many as codes.
    """
    codes = assign(vectors, [fit_codebooks(vectors, sizes[:1], seed)[0]])
    rows = settle(vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector")).join(codes, "item_id").select("item_id", "vector", F.array("c1").alias("prefix")))
    for size in sizes[1:]:
        w = Window.partitionBy("prefix").orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id")
        sample = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= fit_rows).drop("__r")
        centres = sample.groupBy("prefix").applyInPandas(_centres(size, seed), "prefix array<long>, token long, centre array<double>")
        each = centres.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("token", "centre"))).alias("__centres"))
        away = lambda c: F.aggregate(F.zip_with("vector", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        best = F.array_min(F.transform("__centres", lambda c: F.struct(F.round(away(c), 9).alias("d"), c["token"].alias("token"))))
        rows = settle(rows.join(each, "prefix").select("item_id", "vector", F.concat("prefix", F.array(best["token"])).alias("prefix")))
    return rows.select("item_id", *(F.col("prefix")[i].alias(f"c{i + 1}") for i in range(len(sizes))))


def random_codes(items: DataFrame, sizes: list[int], seed: int = 7) -> DataFrame:
    """Codes drawn by a hash of the item, as a baseline."""
    return items.select("item_id", *(F.pmod(F.xxhash64("item_id", F.lit(seed), F.lit(i)), F.lit(s)).alias(f"c{i + 1}") for i, s in enumerate(sizes)))


def trie_edges(codes: DataFrame) -> DataFrame:
    """``level, prefix, token``: which token may follow which prefix."""
    cols = levels(codes)
    steps = [F.struct(F.lit(i).cast("long").alias("level"), (F.array(*cols[:i]) if i else F.array().cast("array<bigint>")).alias("prefix"), F.col(c).alias("token")) for i, c in enumerate(cols)]
    return codes.select(F.explode(F.array(*steps)).alias("e")).select("e.*").distinct()


def token_model(codes: DataFrame, transitions: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``state, prefix, token, logp``: smoothed log probability of the next code's tokens given the last item's first token (``state``).

    Counted from item transitions (``src, dst``); a token of the trie that never follows gets the smoothing only.
    """
    cols = levels(codes)
    target = codes.select(F.col("item_id").alias("dst"), F.array(*cols).alias("code"))
    source = codes.select(F.col("item_id").alias("src"), F.col(cols[0]).alias("state"))
    seen = transitions.join(target, "dst").join(source, "src").select("state", "code")
    steps = F.explode(F.array(*(F.struct(F.slice("code", 1, i).alias("prefix"), F.col("code")[i].alias("token")) for i in range(len(cols)))))
    counts = seen.select("state", steps.alias("s")).groupBy("state", "s.prefix", "s.token").agg(F.count(F.lit(1)).alias("n"))
    states = codes.select(F.col(cols[0]).alias("state")).distinct()
    every = trie_edges(codes).select("prefix", "token").join(states)
    rows = every.join(counts, ["state", "prefix", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(float(smoothing)))
    return rows.withColumn("logp", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("state", "prefix")))).drop("n")


def beam_search(users: DataFrame, codes: DataFrame, scorer: DataFrame, beam: int, topk: int, seen: DataFrame | None = None) -> DataFrame:
    """``user_id, item_id, score, rank``: the ``topk`` best items by summed log probabilities over legal prefixes.

    Level by level the beams of each user (``user_id, state``) meet the scorer (``state, prefix, token, logp``), which holds legal tokens
    only, and the ``beam`` best stay; ties to the smaller code. Items of ``seen`` (``user_id, item_id``) go at the end.
    """
    if beam < topk:
        raise ValueError("beam must not be less than topk")
    cols = levels(codes)
    beams = users.select("user_id", "state", F.array().cast("array<bigint>").alias("prefix"), F.lit(0.0).alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "prefix")
    for _ in cols:
        grown = beams.join(scorer, ["state", "prefix"]).select("user_id", "state", F.concat("prefix", F.array("token")).alias("prefix"), (F.col("score") + F.col("logp")).alias("score"))
        beams = grown.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= beam).drop("__r")
    found = beams.join(codes.select("item_id", F.array(*cols).alias("prefix")), "prefix")
    if seen is not None:
        found = found.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    last = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "prefix", "item_id")
    return found.withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= topk).select("user_id", "item_id", "score", "rank")
