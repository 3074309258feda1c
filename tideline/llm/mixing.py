"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.bpe import TOKENIZERS, token_counts
from tideline.session import settle

#: Buckets by which a source's last, partial pass is found, twice one within the other; the driver sees as many sums per source.
BUCKETS = 1024
#: Nodes of the splitting tree that the driver expands; what is below them is expanded in tasks.
TOP_NODES = 1024
#: Blocks that the smallest source has per shard on the average, and most blocks of a source.
PER_SHARD, MOST_BLOCKS = 128, 1 << 30


@dataclass
class Mix:
    """``rows``: the drawn documents; ``shares``: one row per target source, with what it wanted and reached."""

    rows: DataFrame
    shares: DataFrame


def split_node(low: int, high: int, counts: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """Middle of the shards ``low .. high - 1`` and the blocks of each source that go to its lower half.

    The sources' numbers are drawn from the multivariate hypergeometric distribution, so that column sums stay exact and row sums even.
    The draw depends on the node and the seed only. Of more than half a billion blocks, as many are drawn in units of several and
    the remainders are divided in proportion.
    """
    rng = np.random.default_rng((seed, low, high))
    middle = (low + high) // 2
    part = (middle - low) / (high - low)
    unit = max(1, math.ceil(int(counts.sum()) / 500_000_000))
    base = counts // unit
    total = int(base.sum())
    left = rng.multivariate_hypergeometric(base, round(total * part), method="marginals") if total else np.zeros_like(base)
    return middle, unit * left + ((counts % unit) * part).astype(np.int64)


def split_quotas(counts: np.ndarray, low: int, high: int, seed: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``[nodes, 2]`` ranges of shards and ``[nodes, sources]`` blocks of each: the tree below a node, halved again and again until single
    shards, or until there are ``most`` nodes."""
    nodes = [(low, high, counts.astype(np.int64))]
    while most is None or 2 * len(nodes) <= most:
        if all(h - l == 1 for l, h, _ in nodes):
            break
        below = []
        for l, h, here in nodes:
            if h - l == 1:
                below.append((l, h, here))
                continue
            middle, left = split_node(l, h, here, seed)
            below += [(l, middle, left), (middle, h, here - left)]
        nodes = below
    return np.array([n[:2] for n in nodes], dtype=np.int64), np.stack([n[2] for n in nodes])


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each number below ``n`` in a keyed permutation of them: a Feistel network, walked until it falls below ``n``."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, 6, dtype=np.uint64) | np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _top(shared, seed: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Node of the top tree of each drawn document, by the place of its block in the permutation of its source's blocks."""
        blocks, drawn, ends = shared.value
        for batch in batches:
            source, at, times = (batch.column(c).to_numpy() for c in ("__source", "__at", "pass"))
            node, place = np.zeros(len(source), dtype=np.int64), np.zeros(len(source), dtype=np.int64)
            for s in np.unique(source):
                own = source == s
                i = times[own] * blocks[s] + ((at[own] * blocks[s]) >> 32)
                p = permuted(i, int(drawn[s]), seed + int(s))
                node[own] = np.searchsorted(ends[:, s], p, side="right")
                place[own] = p - np.where(node[own] > 0, ends[np.maximum(node[own] - 1, 0), s], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(place)], names=[*batch.schema.names, "__node", "__place"])

    return kernel


def _leaves(shared, seed: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard of each document below its node; a task expands each of its nodes once."""
        ranges, quotas = shared.value
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            source, node, place = (batch.column(c).to_numpy() for c in ("__source", "__node", "__place"))
            shard = ranges[node, 0].copy()
            for n in np.unique(node):
                low, high = (int(x) for x in ranges[n])
                if high - low == 1:
                    continue
                if n not in known:
                    known[n] = np.cumsum(split_quotas(quotas[n], low, high, seed)[1], axis=0)
                for s in np.unique(source[node == n]):
                    own = (node == n) & (source == s)
                    shard[own] = low + np.searchsorted(known[n][:, s], place[own], side="right")
            kept = [c for c in batch.schema.names if c not in ("__node", "__place")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shard)], names=[*kept, "shard"])

    return kernel


def _normal(column: str):
    return F.lower(F.btrim(F.col(column), F.lit(" \t\r\n")))


def mix_sources(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, shard_tokens: int = 4_000_000, seed: int = 17, tokenizers: str = TOKENIZERS) -> Mix:
    """Draw a mix in which each source of ``targets`` (``source, target_share, max_repeats``) has its share of the tokens.

    Names of sources are compared trimmed and in lower case. Documents with a null text, a null source or a source without
    target take no part (an empty text does, with 0 tokens). The mix holds ``total_tokens`` (default: the tokens of all that
    take part): a source gives ``min(target_share * total_tokens, max_repeats * its tokens)``, in whole passes over its
    documents and a last part of one, which ends within one document of the quota. No document comes more than ``max_repeats`` times.
    What sources can't give is not filled up from others; ``shares`` reports it. An empty table gives an empty mix. Targets
    with a null or a name that stands twice raise ValueError.

    ``rows``: ``shard, position, <key>, source`` (as in targets), ``pass, tokens``. ``shares``: ``source, target_share,
    max_repeats, documents, source_tokens, capacity_tokens, wanted_tokens, used_tokens, reached_share``.

    A hash puts the documents of a source in a random order that is cut into blocks, about as many tokens in each whatever the source, and
    in the smallest source at least :data:`PER_SHARD` per output shard of about ``shard_tokens``. A multivariate hypergeometric splitting tree
    divides the exact block quotas of all sources among the shards, whose number nothing limits; each shard then gets disjoint
    blocks of a keyed permutation and is shuffled on its own. The driver expands the tree's top, tasks what is below, and the driver
    handles a fixed number of sums per source, never documents or blocks. Runs jobs (token counts, bucket sums).
    """
    spark = documents.sparkSession
    wanted = targets.select("source", _normal("source").alias("s"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats")).collect()
    if len({r.s for r in wanted}) < len(wanted) or any(x is None for r in wanted for x in r):
        raise ValueError("targets need distinct sources, shares and repeats without nulls")
    number = F.create_map(*(F.lit(x) for i, r in enumerate(wanted) for x in (r.s, i))) if wanted else F.create_map(F.lit(""), F.lit(-1))
    taking = documents.withColumn("__source", number[_normal(source)]).filter(F.col("__source").isNotNull() & F.col(text).isNotNull())
    counted = settle(token_counts(taking.select(F.col(key), "__source", F.col(text)), [key, "__source"], text, tokenizers))
    width = BUCKETS.bit_length() - 1
    placed = counted.withColumn("__at", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 32))
    placed = placed.withColumns({"__bucket": F.shiftright("__at", 32 - width).cast("int"), "__inner": F.shiftright("__at", 32 - 2 * width).cast("int")})

    size = np.zeros((len(wanted), BUCKETS), dtype=np.int64)
    documents_of = np.zeros(len(wanted), dtype=np.int64)
    for row in placed.groupBy("__source", "__bucket").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).collect():
        size[row["__source"], row["__bucket"]] = row["tokens"]
        documents_of[row["__source"]] += row["documents"]
    tokens = size.sum(axis=1)
    budget = int(tokens.sum()) if total_tokens is None else int(total_tokens)
    passes = np.zeros(len(wanted), dtype=np.int64)
    cut = np.zeros(len(wanted), dtype=np.int64)  # the last pass holds what lies below, in inner buckets, and so many tokens of the next one
    over = np.zeros(len(wanted), dtype=np.int64)
    for s, target in enumerate(wanted):
        own = int(tokens[s])
        quota = min(target.share * budget, target.repeats * own)
        passes[s] = (target.repeats if quota >= target.repeats * own else int(quota // own)) if own else 0
        if own and passes[s] < target.repeats:
            over[s] = int(quota - passes[s] * own)
            ends = np.cumsum(size[s])
            cut[s] = int(np.searchsorted(ends, over[s], side="right")) * BUCKETS
            over[s] -= ends[cut[s] // BUCKETS - 1] if cut[s] else 0
    partial = [s for s in range(len(wanted)) if tokens[s] and passes[s] < wanted[s].repeats]
    if partial:
        at = F.create_map(*(F.lit(x) for s in partial for x in (s, int(cut[s]) // BUCKETS)))
        inner = np.zeros((len(wanted), BUCKETS), dtype=np.int64)
        for row in placed.filter(at[F.col("__source")] == F.col("__bucket")).groupBy("__source", "__inner").agg(F.sum("tokens").alias("tokens")).collect():
            inner[row["__source"], row["__inner"] % BUCKETS] = row["tokens"]
        for s in partial:
            ends = np.cumsum(inner[s])
            more = min(BUCKETS - 1, int(np.searchsorted(ends, over[s], side="right")))
            cut[s] += more
            over[s] -= ends[more - 1] if more else 0

    quotas = np.array([min(r.share * budget, r.repeats * int(tokens[s])) for s, r in enumerate(wanted)])
    shards = max(1, math.ceil(quotas.sum() / shard_tokens))
    least = quotas[quotas > 0].min(initial=quotas.sum())
    block = max(1.0, least / (PER_SHARD * shards), tokens.max(initial=0) / MOST_BLOCKS)
    blocks = np.maximum(1, np.ceil(tokens / block)).astype(np.int64)
    drawn = passes * blocks
    for s in partial:
        drawn[s] += (((cut[s] + 1) * (1 << (32 - 2 * width)) - 1) * blocks[s] >> 32) + 1
    ranges, leaves = split_quotas(drawn, 0, shards, seed, TOP_NODES)

    of = lambda values, default=0: F.coalesce(F.create_map(*(F.lit(x) for s in range(len(wanted)) for x in (s, int(values[s]))))[F.col("__source")], F.lit(default)) if wanted else F.lit(default)
    times = of(passes) + F.when(F.col("__inner") < of([cut[s] if s in partial else 0 for s in range(len(wanted))]), 1).otherwise(0)
    columns = [key, "__source", "__at", "tokens"]
    whole = placed.withColumn("__n", times.cast("int")).filter("__n > 0").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 1)).alias("pass"))
    edge = placed.filter(F.col("__inner") == of([cut[s] if s in partial else -1 for s in range(len(wanted))], -1))
    edge = edge.withColumn("__sum", F.sum("tokens").over(Window.partitionBy("__source").orderBy("__at", F.xxhash64(F.lit(seed + 1), key), key, "tokens").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.filter(F.col("__sum") <= of(over)).select(*columns, of(passes).cast("long").alias("pass"))
    mixed = whole.unionByName(edge)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mixed.schema)
    noded = mixed.mapInArrow(_top(spark.sparkContext.broadcast((blocks, drawn, np.cumsum(leaves, axis=0))), seed), f"{kinds}, __node long, __place long")
    if len(ranges) < shards:  # only a node's own tasks expand it
        noded = noded.repartition(len(ranges), "__node")
    sharded = noded.mapInArrow(_leaves(spark.sparkContext.broadcast((ranges, leaves)), seed), f"{kinds}, shard long")
    names = F.create_map(*(F.lit(x) for i, r in enumerate(wanted) for x in (i, r.source))) if wanted else F.create_map(F.lit(-1), F.lit(""))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "pass", key), key, "pass")
    rows = sharded.withColumn("position", F.row_number().over(local).cast("long")).select("shard", "position", key, names[F.col("__source")].alias("source"), "pass", "tokens")

    report = spark.createDataFrame([[r.source, r.share, r.repeats, int(documents_of[s]), int(tokens[s]), r.repeats * int(tokens[s]), r.share * budget] for s, r in enumerate(wanted)], "source string, target_share double, max_repeats int, documents long, source_tokens long, capacity_tokens long, wanted_tokens double")
    reached = mixed.groupBy("__source").agg(F.sum("tokens").alias("used_tokens")).select(names[F.col("__source")].alias("source"), "used_tokens")
    shares = report.join(F.broadcast(reached), "source", "left").fillna(0, ["used_tokens"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.withColumn("reached_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(F.lit(0.0)))
    return Mix(rows, shares)
