"""Rankers and sequence models in NumPy on Spark: shared bottom, multi-gate experts, progressive layers, fusion heads, towers, attention, code decoder.

Training broadcasts the weights, runs mini-batches in the tasks and averages the tasks' weights by rows after each epoch, so a model of any
of these sizes is trained on all rows without gathering them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.gradients import Node, train
from tideline.operators.mapped import Mapped, Room, room_for, rows_of
from tideline.operators.towers import CodeDecoder, FusionHead, SelfAttention, Towers, padded
from tideline.operators.vectors import Nearest, place_of
from tideline.session import release, settle, spread

#: Stands for null where items are looked up.
NO_ITEM = -(1 << 63)
TASKS = ("label_clicks", "label_carts", "label_orders")


class ExpertNet:
    """One hidden layer of experts, mixed per task, and a linear head per task.

    ``shared_bottom`` has one expert and no gate; ``mmoe`` shares all experts, with a softmax gate per task; ``ple`` adds experts of
    their own to each task, which no other task's gate can use.
    """

    def __init__(self, kind: str, inputs: int, hidden: int = 16, experts: int = 3, tasks: int = 3, seed: int = 7):
        if kind not in ("shared_bottom", "mmoe", "ple"):
            raise ValueError(f"unknown kind {kind}")
        rng = np.random.default_rng(seed)
        shared = 1 if kind == "shared_bottom" else experts
        own = 1 if kind == "ple" else 0
        total = shared + own * tasks
        self.kind, self.tasks = kind, tasks
        self.allowed = np.zeros((tasks, total), dtype=bool)
        self.allowed[:, :shared] = True
        for t in range(tasks if own else 0):
            self.allowed[t, shared + t] = True
        self.p = {
            "w": rng.normal(0, np.sqrt(2 / inputs), (total, inputs, hidden)),
            "b": np.zeros((total, hidden)),
            "g": rng.normal(0, 0.01, (tasks, inputs, total)),
            "h": rng.normal(0, np.sqrt(1 / hidden), (tasks, hidden)),
            "c": np.zeros(tasks),
        }

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits ``[rows, tasks]`` and what the backward pass needs."""
        pre = np.einsum("ni,eih->neh", x, self.p["w"]) + self.p["b"]
        act = np.maximum(pre, 0)
        gate = np.einsum("ni,tie->nte", x, self.p["g"])
        gate = np.where(self.allowed, gate, -np.inf)
        gate = np.exp(gate - gate.max(axis=2, keepdims=True))
        gate /= gate.sum(axis=2, keepdims=True)
        mixed = np.einsum("nte,neh->nth", gate, act)
        return np.einsum("nth,th->nt", mixed, self.p["h"]) + self.p["c"], {"pre": pre, "act": act, "gate": gate, "mixed": mixed}

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean weighted cross-entropy over rows and tasks."""
        z, s = self.forward(x)
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        scale = np.where(y > 0, weight, 1.0) / len(x)
        loss = float(-(scale * (y * np.log(prob + 1e-12) + (1 - y) * np.log(1 - prob + 1e-12))).sum())
        dz = (prob - y) * scale
        d_mixed = np.einsum("nt,th->nth", dz, self.p["h"])
        d_gate = np.einsum("nth,neh->nte", d_mixed, s["act"])
        d_logit = s["gate"] * (d_gate - (d_gate * s["gate"]).sum(axis=2, keepdims=True))
        d_pre = np.einsum("nte,nth->neh", s["gate"], d_mixed) * (s["pre"] > 0)
        return {"w": np.einsum("ni,neh->eih", x, d_pre), "b": d_pre.sum(axis=0), "g": np.einsum("ni,nte->tie", x, d_logit), "h": np.einsum("nt,nth->th", dz, s["mixed"]), "c": dz.sum(axis=0)}, loss

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[0], -30, 30)))


def _epoch(shared, columns: list[str], labels: list[str], rate: float, batch: int):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, weight = pickle.loads(shared.value)
        rows, loss, speed = 0, 0.0, {k: np.zeros_like(v) for k, v in net.p.items()}
        for frame in batches:
            x, y = frame[columns].to_numpy(dtype=np.float64), frame[labels].to_numpy(dtype=np.float64)
            for i in range(0, len(x), batch):
                step, value = net.gradients(x[i : i + batch], y[i : i + batch], weight)
                for k, g in step.items():
                    speed[k] = 0.9 * speed[k] + g
                    net.p[k] -= rate * speed[k]
                rows += len(x[i : i + batch])
                loss += value * len(x[i : i + batch])
        if rows:
            yield pd.DataFrame({"rows": [rows], "loss": [loss], "net": [pickle.dumps(net.p)]})

    return kernel


def train_ranker(rows: DataFrame, columns: list[str], kind: str = "shared_bottom", labels: tuple[str, ...] = TASKS, epochs: int = 5, rate: float = 0.05, batch: int = 256, hidden: int = 16, valid: DataFrame | None = None, seed: int = 7) -> tuple[ExpertNet, list[float]]:
    """A net trained on standardised ``columns`` and the mean loss of each epoch; stops when the loss on ``valid`` rises.

    Positives weigh ``min(50, sqrt(negatives / positives))`` per task. Each task of an epoch gives its weights, one row; they are averaged
    by its number of rows. Runs a job per epoch.
    """
    spark = rows.sparkSession
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(t) for t in labels)).first()
    weight = np.array([min(50.0, np.sqrt((counts["n"] - (counts[t] or 0)) / max(1, counts[t] or 0))) for t in labels])
    net, losses, best, kept = ExpertNet(kind, len(columns), hidden, tasks=len(labels), seed=seed), [], np.inf, None
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(pickle.dumps((net, weight)))
        parts = rows.select(*columns, *labels).mapInPandas(_epoch(shared, columns, list(labels), rate, batch), "rows long, loss double, net binary").collect()
        total = sum(p.rows for p in parts)
        if not total:
            break
        nets = [(p.rows / total, pickle.loads(p.net)) for p in parts]
        net.p = {k: sum(w * p[k] for w, p in nets) for k in net.p}
        losses.append(sum(p.loss for p in parts) / total)
        shared.unpersist()
        if valid is not None:
            now = score_ranker(valid, net, columns).agg(*(F.avg(-F.col(t) * F.log(F.col(f"p_{t}") + F.lit(1e-12)) - (F.lit(1) - F.col(t)) * F.log(F.lit(1 + 1e-12) - F.col(f"p_{t}"))).alias(t) for t in labels)).first()
            if sum(now) >= best:
                net.p = kept
                break
            best, kept = sum(now), {k: v.copy() for k, v in net.p.items()}
    return net, losses


def score_ranker(rows: DataFrame, net: ExpertNet, columns: list[str], labels: tuple[str, ...] = TASKS) -> DataFrame:
    """Add ``p_<label>`` for each task."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    names = [f"p_{t}" for t in labels]

    @F.pandas_udf("array<double>")
    def predict(x: pd.Series) -> pd.Series:
        return pd.Series(list(pickle.loads(shared.value).predict(np.array(x.tolist(), dtype=np.float64)))) if len(x) else pd.Series([], dtype=object)

    scored = rows.withColumn("__p", predict(F.array(*(F.col(c).cast("double") for c in columns))))
    return scored.withColumns({n: F.col("__p")[i] for i, n in enumerate(names)}).drop("__p")


def logistic_heads(rows: DataFrame, columns: list[str], labels: tuple[str, ...] = TASKS) -> DataFrame:
    """``task, intercept, coefficients`` of a weighted logistic regression per task, by MLlib."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.select(*columns, *labels))
    out = []
    for task in labels:
        positives, n = data.agg(F.sum(task), F.count(F.lit(1))).first()
        weight = float(min(50.0, np.sqrt((n - (positives or 0)) / max(1, positives or 0))))
        model = LogisticRegression(labelCol=task, weightCol="__w", maxIter=30).fit(data.withColumn("__w", F.when(F.col(task) == 1, weight).otherwise(1.0)))
        out.append((task, float(model.intercept), [float(x) for x in model.coefficients]))
    return rows.sparkSession.createDataFrame(out, "task string, intercept double, coefficients array<double>")


def logit(column: str) -> Column:
    """Log odds of a probability, kept within 1e-6 of 0 and 1."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(column)))
    return F.log(p / (F.lit(1.0) - p))


def sigmoid(z: Column) -> Column:
    """Probability of log odds."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def static_fusion(probabilities: list[str], raw: list[float]) -> Column:
    """Mean of logits with softplus weights, as a probability."""
    weights = [float(np.log1p(np.exp(x))) for x in raw]
    total = F.lit(0.0)
    for c, w in zip(probabilities, weights, strict=True):
        total = total + F.lit(w / sum(weights)) * logit(c)
    return sigmoid(total)


def gated_fusion(probabilities: list[str], context: list[str], weights: list[list[float]], bias: list[float]) -> Column:
    """Mean of logits with softmax weights that depend linearly on the context columns (one row of ``weights`` per probability)."""
    scores = []
    for row, b in zip(weights, bias, strict=True):
        z = F.lit(float(b))
        for c, w in zip(context, row, strict=True):
            z = z + F.lit(float(w)) * F.col(c)
        scores.append(F.exp(z))
    top, below = F.lit(0.0), F.lit(0.0)
    for c, e in zip(probabilities, scores, strict=True):
        top, below = top + e * logit(c), below + e
    return sigmoid(top / below)


def causal_mask(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """``batch, row, column, allowed`` for rows (``batch, row, aid, ts``) of the same batch: another row's target may serve as a negative
    if it is known by then and isn't the own item. Batches are as large as a training step."""
    a, b = rows.select(batch, "row", "aid", "ts"), rows.select(batch, F.col("row").alias("column"), F.col("aid").alias("__aid"), F.col("ts").alias("__ts"))
    allowed = (F.col("row") == F.col("column")) | ((F.col("__ts") <= F.col("ts")) & (F.col("__aid") != F.col("aid")))
    return a.join(b, batch).select(batch, "row", "column", allowed.alias("allowed"))


@dataclass
class Fitted:
    """A trained model of :mod:`towers`, its weights, the item of each number (from 1) and the mean loss of each epoch."""

    model: object
    weights: dict[str, np.ndarray]
    ids: np.ndarray
    losses: list[float]
    room: Room | None = None

    def discard(self) -> None:
        """Remove the files of mapped tables, after which the model isn't of use any more."""
        if self.room is not None:
            self.room.remove()


def catalogue(items: DataFrame, max_items: int = 2_000_000) -> np.ndarray:
    """The different items (``item_id``) in their order, for models whose weights hold a row per item; more than ``max_items`` raise ValueError."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()])], names=["ids"])

    found = items.select(F.col("item_id").cast("long").alias("item_id")).dropna().distinct().limit(max_items + 1).mapInArrow(pack, "ids binary").collect()
    known = np.sort(np.concatenate([np.frombuffer(r["ids"], dtype=np.int64) for r in found] or [np.zeros(0, dtype=np.int64)]))
    if len(known) > max_items:
        raise ValueError("too many items for one matrix")
    return known


def numbered(rows: DataFrame, ids: np.ndarray, lists: tuple[str, ...] = (), singles: tuple[str, ...] = ()) -> DataFrame:
    """Items of the named columns replaced by their numbers from 1; 0 for others and null. A null list stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(ids)

    def place(column: pa.Array) -> np.ndarray:
        known, values = shared.value, column.fill_null(NO_ITEM).to_numpy(zero_copy_only=False)
        if not len(known):
            return np.zeros(len(values), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, at + 1, 0)

    @F.arrow_udf("array<long>")
    def many(column: pa.Array) -> pa.Array:  # all lists of a batch at once
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(place(column.flatten())), mask=column.is_null())

    @F.arrow_udf("long")
    def one(column: pa.Array) -> pa.Array:
        return pa.array(place(column))

    return rows.withColumns({c: many(F.col(c).cast("array<long>")) for c in lists} | {c: one(F.col(c).cast("long")) for c in singles})


def _placed(shared, kinds: list[tuple[str, type]]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of the known items: for each width of a feature their numbers and its values as bytes."""
        for batch in batches:
            items, known = batch.column(0).to_numpy(), shared.value
            if not len(items) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, items), len(known) - 1)
            for begin in range(0, len(items), 4096):
                rows = np.arange(begin, min(begin + 4096, len(items)))
                rows = rows[known[at[rows]] == items[rows]]
                for column, (name, kind) in enumerate(kinds, 1):
                    lists = batch.column(column).take(pa.array(rows))
                    width = lists.value_lengths().fill_null(-1).to_numpy()
                    for w in np.unique(width[width >= 0]):
                        some = np.flatnonzero(width == w)
                        values = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(w)]), pa.array([(at[rows[some]] + 1).tobytes()]), pa.array([np.nan_to_num(values).astype(kind).tobytes()])], names=["name", "width", "at", "value"])

    return kernel


def _item_arrays(features: DataFrame, ids: np.ndarray, place: Callable[[dict[str, int]], Room | None] = lambda widths: None) -> dict[str, np.ndarray]:
    """Rows of ``item_id`` and of any of ``categories``, ``numbers`` and ``known`` (arrays) by number; zeros where an item has none.

    Tasks look the items up and pack what is known into blocks, which the driver takes one at a time into tables of the catalogue's size, in the
    room that ``place`` gives for the arrays' widths.
    """
    single = dict(features.dtypes).get("known") == "array<float>"
    kinds = [(name, kind) for name, kind in (("categories", np.int64), ("numbers", np.float64), ("known", np.float32 if single else np.float64)) if name in features.columns]
    rows = features.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), *(F.col(n).cast("array<float>" if kind is np.float32 else "array<double>").alias(n) for n, kind in kinds))
    shared = features.sparkSession.sparkContext.broadcast(ids)
    found = settle(rows.mapInArrow(_placed(shared, kinds), "name string, width long, at binary, value binary"))
    widths = dict(found.groupBy("name").agg(F.max("width")).collect())
    room = place(widths)
    out = {name: rows_of(room, (len(ids) + 1, widths.get(name, 0)), kind) for name, kind in kinds}
    for part in found.toLocalIterator():
        at = np.frombuffer(part["at"], dtype=np.int64)
        out[part["name"]][at] = np.frombuffer(part["value"], dtype=dict(kinds)[part["name"]]).reshape(len(at), part["width"])
    shared.destroy()
    return out


def train_towers(samples: DataFrame, items: DataFrame, width: int = 16, epochs: int = 3, rate: float = 0.01, batch: int = 64, features: DataFrame | None = None, negatives: DataFrame | None = None, hard: tuple[float, ...] = (0.0,), length: int = 30, seed: int = 7, max_items: int = 2_000_000, **control) -> Fitted:
    """A :class:`towers.Towers` model trained on ``samples`` (``sample_id, history, types, buckets, target, target_type, ts``).

    ``items`` (``item_id``) are the catalogue; samples with another target don't count. ``features`` has a row per item (see
    :class:`towers.Towers`), ``negatives`` (``sample_id, aid``, or lists ``sample_id, negatives``) are hard negatives, whose share of the loss is ``hard`` by epoch. The weights,
    a row per item, and the features are held by the driver and by each task, or mapped from files of the shared folder where they are large (see
    :mod:`mapped`), which stay there until :meth:`Fitted.discard` or the driver's end. ``control`` goes to :func:`gradients.train`.
    """
    ids, most = catalogue(items, max_items), 0
    rows = samples.select("sample_id", "history", "types", "buckets", "target", "target_type", "ts")
    if negatives is not None:
        lists = settle(negatives if "negatives" in negatives.columns else negatives.groupBy("sample_id").agg(F.collect_list("aid").alias("negatives")))
        most = lists.agg(F.max(F.size("negatives"))).first()[0] or 0
        rows = rows.join(lists, "sample_id", "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<long>")))
        rows = rows.withColumn("negatives", F.concat("negatives", F.array_repeat(F.lit(None).cast("long"), F.lit(most) - F.size("negatives"))))
    rows = numbered(rows, ids, ("history", "negatives") if negatives is not None else ("history",), ("target",)).filter("target > 0").drop("sample_id")
    release(samples.sparkSession)
    rows = rows.withColumns({c: F.col(c).cast("array<int>") for c in ("history", "negatives") if c in rows.columns})  # settled, so kept small
    room = room_for(samples.sparkSession, 8 * (len(ids) + 1) * width)

    def place(widths: dict[str, int]) -> Room | None:
        nonlocal room
        room = room or room_for(samples.sparkSession, 8 * (len(ids) + 1) * (width + widths.get("known", 0)))
        return room

    arrays = _item_arrays(features, ids, place) if features is not None else {}
    model = Towers(len(ids), width, length, hard=hard if negatives is not None else (0.0,), seed=seed, **arrays)
    weights, losses = train(model, rows, epochs, rate, batch, seed, room=room, uses=most + 8, **control)
    return Fitted(model, weights, ids, losses, room)


def vector_rows(spark: SparkSession, ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``item_id, vector`` of a matrix on the driver; tasks make the rows from one broadcast."""
    if not len(ids):
        return spark.createDataFrame([], "item_id long, vector array<double>")
    shared, block = spark.sparkContext.broadcast((ids, vectors)), 8192

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, x = shared.value
        for batch in batches:
            for i in (batch.column(0).to_numpy() * block).tolist():
                part = x[i : i + block]
                yield pa.RecordBatch.from_arrays([pa.array(known[i : i + block]), pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1], np.asarray(part).ravel())], names=["item_id", "vector"])

    blocks = -(-len(ids) // block)
    return spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism)).mapInArrow(kernel, "item_id long, vector array<double>")


def tower_items(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """``item_id, vector`` of the item tower."""
    return vector_rows(spark, fitted.ids, _all_vectors(spark, fitted) if len(fitted.ids) else np.zeros((0, 1)))


def _users(model, nodes: dict[str, Node], frame: pd.DataFrame, step: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Parts of a frame, which of their histories have a known item, and their users' vectors."""
    for i in range(0, len(frame), step):
        part = frame.iloc[i : i + step]
        yield part, np.array([any(h) for h in part["history"]], dtype=bool), model.users(nodes, part).value


def _user_weights(fitted: Fitted) -> dict[str, np.ndarray]:
    """The weights that the user's tower reads."""
    return {k: v for k, v in fitted.weights.items() if k in ("item", "type", "time", "out", "out_b") or k.startswith("gru_")}


def tower_users(samples: DataFrame, fitted: Fitted) -> DataFrame:
    """``sample_id, vector`` of the user tower; null for a history without a known item."""
    rows = numbered(samples.select("sample_id", "history", "types", "buckets"), fitted.ids, ("history",))
    shared = samples.sparkSession.sparkContext.broadcast((fitted.model, _user_weights(fitted)))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights = shared.value
        nodes = {k: Node(v) for k, v in weights.items()}
        for frame in batches:
            for part, known, vectors in _users(model, nodes, frame, 1024):
                yield pd.DataFrame({"sample_id": part["sample_id"], "vector": [v if k else None for v, k in zip(vectors.tolist(), known, strict=True)]})

    return rows.mapInPandas(kernel, f"sample_id {rows.schema['sample_id'].dataType.simpleString()}, vector array<double>")


def recall_towers(samples: DataFrame, fitted: Fitted, n: int = 300) -> DataFrame:
    """``sample_id, aid, source, source_rank, source_score``: the ``n`` nearest items of each sample's user vector, exactly.

    A task holds a row per item anyway, so it meets its users with all items itself and only the ``n`` go on. Similarities are rounded to
    nine decimals, ties go to the smaller item.
    """
    schema = f"sample_id {samples.schema['sample_id'].dataType.simpleString()}, aid long, source string, source_rank long, source_score double"
    if not len(fitted.ids):
        return samples.sparkSession.createDataFrame([], schema)
    rows = spread(numbered(samples.select("sample_id", "history", "types", "buckets"), fitted.ids, ("history",)))
    shared = samples.sparkSession.sparkContext.broadcast((fitted.model, _user_weights(fitted), fitted.ids, _all_vectors(samples.sparkSession, fitted)))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights, ids, x = shared.value
        nodes, search = {k: Node(v) for k, v in weights.items()}, Nearest(x, n)
        for frame in batches:
            for part, known, vectors in _users(model, nodes, frame, 256):
                found = search(vectors[known])
                if found:
                    r, c, rank, score = found
                    yield pd.DataFrame({"sample_id": part["sample_id"].to_numpy()[known][r], "aid": ids[c], "source": "two_tower", "source_rank": rank, "source_score": score})

    return rows.mapInPandas(kernel, schema)


def _all_vectors(spark: SparkSession, fitted: Fitted) -> np.ndarray:
    """``[items, width]``: the item tower's vectors; of mapped tables mapped too, and made in tasks."""
    if not isinstance(fitted.weights["item"], Mapped):
        return fitted.model.all_vectors(fitted.weights)
    out, step = fitted.room.array((len(fitted.ids), fitted.model.width), np.float64), 8192
    out.flush()
    shared = spark.sparkContext.broadcast((fitted.model, fitted.weights, str(out.filename), out.shape))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights, path, shape = shared.value
        nodes, x = {k: Node(v) for k, v in weights.items()}, Mapped(path, dtype=np.float64, mode="r+", shape=shape)
        for frame in batches:
            for i in (frame["id"].to_numpy() * step).tolist():
                x[i : i + step] = model.vectors(nodes, np.arange(i + 1, min(i + step, len(x)) + 1)).value
        x.flush()
        yield pd.DataFrame({"n": [1]})

    blocks = -(-len(out) // step)
    spark.range(0, blocks, 1, min(blocks, 2 * spark.sparkContext.defaultParallelism)).mapInPandas(kernel, "n long").collect()
    shared.destroy()
    return out


def target_ranks(samples: DataFrame, fitted: Fitted, n: int) -> DataFrame:
    """``rank`` of each sample: the place of ``target`` among the items as :func:`recall_towers` orders them; null beyond ``n``, for an unknown
    target and for a history without a known item.

    Items are met in blocks. A sample leaves once ``n`` items are surely nearer than its target, which single precision says but for a margin;
    items within the margin are compared exactly.
    """
    spark = samples.sparkSession
    if not len(fitted.ids):
        return samples.select(F.lit(None).cast("long").alias("rank"))
    rows = numbered(samples.select("history", "types", "buckets", "target"), fitted.ids, ("history",), ("target",))
    rows = rows.repartition(max(rows.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast((fitted.model, _user_weights(fitted), _all_vectors(spark, fitted)))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights, x = shared.value
        nodes = {k: Node(v) for k, v in weights.items()}
        for frame in batches:
            for part, known, users in _users(model, nodes, frame, 1024):
                target, rank = part["target"].to_numpy(dtype=np.int64), np.zeros(len(part), dtype=np.int64)
                asked = np.flatnonzero(known & (target > 0))
                if len(asked):
                    rank[asked] = place_of(x, users[asked], target[asked] - 1, n)
                yield pd.DataFrame({"rank": pd.array([int(r) if r else None for r in rank], dtype="Int64")})

    return rows.mapInPandas(kernel, "rank long")


def train_fusion(rows: DataFrame, kind: str, probabilities: list[str], context: list[str], label: str = "label", epochs: int = 5, rate: float = 0.02, batch: int = 1024, seed: int = 7, **control) -> tuple[FusionHead, dict[str, np.ndarray], list[float]]:
    """A fusion head (:class:`towers.FusionHead`) trained on the logits of the probabilities and the context columns (nulls as 0)."""
    head = FusionHead(kind, len(context), seed=seed)
    data = rows.select(F.array(*(logit(c) for c in probabilities)).alias("z"), (F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in context)) if context else F.array().cast("array<double>")).alias("x"), F.col(label).cast("double").alias("label"))
    weights, losses = train(head, data, epochs, rate, batch, seed, **control)
    return head, weights, losses


def score_fusion(rows: DataFrame, head: FusionHead, weights: dict[str, np.ndarray], probabilities: list[str], context: list[str], name: str = "fused") -> DataFrame:
    """Add the probability of a trained fusion head."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((head, weights)))

    @F.pandas_udf("double")
    def predict(z: pd.Series, x: pd.Series) -> pd.Series:
        model, w = pickle.loads(shared.value)
        out = model.logit({k: Node(v) for k, v in w.items()}, np.array(z.tolist(), dtype=np.float64), np.array(x.tolist(), dtype=np.float64).reshape(len(z), -1)).value
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in context)) if context else F.array().cast("array<double>")
    return rows.withColumn(name, predict(F.array(*(logit(c) for c in probabilities)), x))


def train_attention(windows: DataFrame, items: DataFrame, length: int, width: int = 16, heads: int = 2, layers: int = 1, epochs: int = 3, rate: float = 0.01, batch: int = 128, seed: int = 7, max_items: int = 2_000_000, **control) -> Fitted:
    """A :class:`towers.SelfAttention` model trained on windows as :func:`sequences.masked_windows` gives them (``items`` are item + 1)."""
    ids = catalogue(items, max_items)
    plain = windows.select(F.transform("items", lambda x: F.when(x > 0, x - 1)).alias("items"), "feedback", F.transform("labels", lambda x: F.when(x != -100, x)).alias("labels"))
    rows = numbered(plain, ids, ("items", "labels")).withColumn("labels", F.transform("labels", lambda x: F.when(x > 0, x - 1).otherwise(F.lit(-100).cast("long"))))
    model = SelfAttention(len(ids), length, width, heads, layers, seed)
    weights, losses = train(model, rows, epochs, rate, batch, seed, **control)
    return Fitted(model, weights, ids, losses)


def attention_ranks(samples: DataFrame, fitted: Fitted) -> DataFrame:
    """``user_id, rank``: place of ``target`` among all items after ``history`` and ``feedback`` (padded with 0), the history's other items left
    out; null for an unknown target. Ties go to the smaller item."""
    rows = numbered(samples.select("user_id", F.transform("history", lambda x: F.nullif(x, F.lit(0).cast("long"))).alias("history"), "feedback", "target"), fitted.ids, ("history",), ("target",))
    shared = samples.sparkSession.sparkContext.broadcast((fitted.model, fitted.weights))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights = shared.value
        for frame in batches:
            for i in range(0, len(frame), 256):
                part = frame.iloc[i : i + 256]
                history = padded(part["history"], model.length)
                score = np.round(model.score_all(weights, history, padded(part["feedback"], model.length)), 9)
                target = part["target"].to_numpy(dtype=np.int64)
                own = np.take_along_axis(score, np.maximum(target - 1, 0)[:, None], axis=1)
                others = history != target[:, None]
                r, c = np.nonzero(others & (history > 0))
                score[r, history[r, c] - 1] = -np.inf
                ahead = (score > own).sum(axis=1) + ((score == own) & (np.arange(score.shape[1]) < target[:, None] - 1)).sum(axis=1)
                yield pd.DataFrame({"user_id": part["user_id"], "rank": pd.array([int(a) + 1 if t else None for a, t in zip(ahead, target, strict=True)], dtype="Int64")})

    return rows.mapInPandas(kernel, f"user_id {rows.schema['user_id'].dataType.simpleString()}, rank long")


def train_decoder(samples: DataFrame, codes: DataFrame, length: int, width: int = 16, heads: int = 2, layers: int = 1, epochs: int = 3, rate: float = 0.01, batch: int = 128, seed: int = 7, max_items: int = 2_000_000, **control) -> Fitted:
    """A :class:`towers.CodeDecoder` trained on ``history, feedback`` (padded with 0) and ``target``; ``codes`` (``item_id, c1 .. cL``) are unique."""
    levels = sorted((c for c in codes.columns if c[0] == "c" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    known = np.array(codes.select("item_id", *levels).dropna(subset=["item_id"]).limit(max_items + 1).collect(), dtype=np.int64).reshape(-1, len(levels) + 1)  # in one run: codes may be dear to make
    if len(known) > max_items:
        raise ValueError("too many items for one matrix")
    ids, first = np.unique(known[:, 0], return_index=True)
    table = np.concatenate((np.zeros((1, len(levels)), dtype=np.int64), known[first, 1:]))
    rows = samples.select(F.transform("history", lambda x: F.nullif(x, F.lit(0).cast("long"))).alias("history"), F.col("feedback").cast("array<tinyint>").alias("feedback"), "target")
    rows = numbered(rows, ids, ("history",), ("target",)).filter("target > 0").withColumn("history", F.col("history").cast("array<int>"))  # settled, so kept small
    model = CodeDecoder(table, tuple(int(x) + 1 for x in table.max(axis=0)), length, width, heads, layers, seed)
    weights, losses = train(model, rows, epochs, rate, batch, seed, **control)
    return Fitted(model, weights, ids, losses)


def decode_topk(samples: DataFrame, fitted: Fitted, beam: int, topk: int) -> DataFrame:
    """``user_id, item_id, score, rank``: the items of the ``topk`` best codes after each history, by a beam over legal prefixes."""
    if beam < topk:
        raise ValueError("beam must not be less than topk")
    rows = numbered(samples.select("user_id", F.transform("history", lambda x: F.nullif(x, F.lit(0).cast("long"))).alias("history"), "feedback"), fitted.ids, ("history",))
    shared = samples.sparkSession.sparkContext.broadcast((fitted.model, fitted.weights, fitted.ids))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights, ids = shared.value
        for frame in batches:
            for i in range(0, len(frame), 64):
                part = frame.iloc[i : i + 64]
                items, score = model.beam(weights, padded(part["history"], model.length), padded(part["feedback"], model.length), beam, topk)
                r, c = np.nonzero(items)
                yield pd.DataFrame({"user_id": part["user_id"].to_numpy()[r], "item_id": ids[items[r, c] - 1], "score": score[r, c], "rank": c + 1})

    return rows.mapInPandas(kernel, f"user_id {rows.schema['user_id'].dataType.simpleString()}, item_id long, score double, rank long")
