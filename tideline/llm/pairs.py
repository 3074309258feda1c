"""Items that appear together: pair counts and how far they exceed chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.skew import skewed_join
from tideline.session import settle

#: Pair codes in one sorted run of a task (8 bytes each).
RUN_CODES = 1 << 21
#: Items up to which their names and counts (24 bytes each) are broadcast to the counted pairs; more of them meet in a join that splits hot items.
MOST_BROADCAST = 500_000


def item_codes(items: DataFrame, item: str) -> DataFrame:
    """Add ``code``, the dense rank of ``item`` from 0 in its order, without sorting in one task; rows are unique by ``item``.

    Items are range-sorted; the driver only gets the number of rows of each range. Runs two jobs.
    """
    ordered = settle(items.repartitionByRange(item).sortWithinPartitions(item).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = ordered.groupBy(part.alias("p")).count().orderBy("p").collect()
    if sum(r["count"] for r in sizes) >= 1 << 32:
        raise ValueError("more than 2^32 items")
    starts, so_far = {}, 0
    for row in sizes:
        starts[row["p"]] = so_far
        so_far += row["count"]
    offsets = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)) if starts else F.create_map(F.lit(0), F.lit(0))
    return ordered.withColumn("code", offsets[part] + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


def _pack(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit code per pair; shifted by 2^63 so that signed order is code order."""
    return ((low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)).view(np.int64) ^ np.int64(-(1 << 63))


def unpack(column: str) -> tuple:
    """Columns of the smaller and the larger item code of a packed pair."""
    code = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(code, 32), code.bitwiseAND(F.lit((1 << 32) - 1))


def _run(parts: list[np.ndarray]) -> pa.RecordBatch:
    codes = np.sort(np.concatenate(parts))
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(codes[starts]), pa.array(np.diff(np.append(starts, len(codes))))], names=["code", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs ``code, n`` of the pairs of each row's items: ``items`` sorted, pairs within; with ``others``, pairs across."""
    held: list[np.ndarray] = []
    size = 0

    def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        items, others = batch.column("items"), batch.column("others")
        flat, ends = items.flatten().to_numpy(zero_copy_only=False), items.offsets.to_numpy()
        across = others.is_valid().to_numpy(zero_copy_only=False)
        length = np.diff(ends)
        for n in np.unique(length[~across]):
            if n < 2:
                continue
            starts = ends[:-1][(length == n) & ~across]
            low, high = np.triu_indices(int(n), 1)
            step = max(1, RUN_CODES // len(low))
            for i in range(0, len(starts), step):
                rows = np.sort(flat[starts[i : i + step, None] + np.arange(n)], axis=1)
                yield _pack(rows[:, low].ravel(), rows[:, high].ravel())
        for i in np.flatnonzero(across):
            a = flat[ends[i] : ends[i + 1]]
            b = np.asarray(others[int(i)].as_py(), dtype=np.int64)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
            yield _pack(np.minimum(left, right), np.maximum(left, right))

    for batch in batches:
        for codes in blocks(batch):
            held.append(codes)
            size += len(codes)
            if size >= RUN_CODES:
                yield _run(held)
                held, size = [], 0
    if held:
        yield _run(held)


def _merge(least: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Run-length counts over the merged runs; a code that goes on in the next batch waits for it."""
        code, count = None, 0
        for batch in batches:
            codes, counts = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            if not len(codes):
                continue
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            sums, unique = np.add.reduceat(counts, starts), codes[starts]
            if code is not None:
                if unique[0] == code:
                    sums[0] += count
                else:
                    unique, sums = np.concatenate(([code], unique)), np.concatenate(([count], sums))
            code, count = unique[-1], sums[-1]
            kept = sums[:-1] >= least
            yield pa.RecordBatch.from_arrays([pa.array(unique[:-1][kept]), pa.array(sums[:-1][kept])], names=["code", "n"])
        if code is not None and count >= least:
            yield pa.RecordBatch.from_arrays([pa.array([int(code)], pa.int64()), pa.array([int(count)], pa.int64())], names=["code", "n"])

    return kernel


def pair_counts(records: DataFrame, record: str, item: str, min_count: int = 1, min_lift: float = 0.0, block: int = 256) -> DataFrame:
    """Pairs of different items of the same record, with how much oftener than by chance they meet.

    Result: ``item_a < item_b``, ``n_ab`` (records with both), ``n_a``, ``n_b``, ``records`` (all records with an item),
    ``lift = n_ab * records / (n_a * n_b)`` and ``log_odds``, the logarithm of the odds ratio of their 2 x 2 table with 0.5
    added to each cell. Each record counts once, however often it holds the item. Only pairs with ``n_ab >= min_count`` and
    ``lift >= min_lift`` come out. Rows with a null record or item don't count; an empty input gives no rows; items are
    bigint; extra columns are ignored. Pairs of one item with itself don't exist.

    Items get dense 32-bit codes; a pair is one 64-bit code. Each task writes sorted runs with run-length counts (its
    map-side combine), Spark's shuffle divides the runs by code, its external sort spills and merges them, and a last
    pass sums the run lengths. The items' names and counts are broadcast to the pairs if they are few, else joined with hot items split. Records of more than ``block`` items are cut into blocks, and each pair of blocks is a work
    item of its own, so a long record doesn't stay in one task. Two exact bounds save work where limits are given: an item
    in fewer than ``min_count`` records has no such pair, nor has one in more than ``records / min_lift`` of them, since
    ``lift <= records / max(n_a, n_b)``. Runs several jobs.
    """
    spark = records.sparkSession
    held = records.select(F.col(record).alias("__r"), F.col(item).cast("long").alias("__i")).dropna().distinct()
    held = settle(held)
    total = held.select("__r").distinct().count()
    items = held.groupBy("__i").agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") >= min_count) & (F.col("__n") * F.lit(float(min_lift)) <= total))
    items = settle(item_codes(items, "__i"))
    coded = skewed_join(held, items.select("__i", "code"), ["__i"]).select("__r", "code")

    sizes = coded.groupBy("__r").agg(F.count(F.lit(1)).alias("__size"))
    long = settle(sizes.filter(F.col("__size") > block))
    many = long.count()
    marked = F.broadcast(long) if many <= 100_000 else long
    short = coded.join(marked, "__r", "left_anti") if many else coded
    works = short.groupBy("__r").agg(F.collect_list("code").alias("items")).filter(F.size("items") > 1).select("items", F.lit(None).cast("array<bigint>").alias("others"))
    if many:
        parts = F.ceil(F.col("__size") / F.lit(block)).cast("int")
        cut = coded.join(marked, "__r").withColumns({"__parts": parts, "__b": F.pmod(F.xxhash64("code"), parts.cast("long")).cast("int")})
        cut = settle(cut.groupBy("__r", "__parts", "__b").agg(F.collect_list("code").alias("items")))
        left = cut.select("__r", F.col("__b").alias("__x"), "items", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__y"))
        right = cut.select("__r", F.col("__b").alias("__y"), F.col("items").alias("others"))
        across = left.filter(F.col("__x") < F.col("__y")).join(right, ["__r", "__y"]).select("items", "others")
        within = cut.filter(F.size("items") > 1).select("items", F.lit(None).cast("array<bigint>").alias("others"))
        works = works.unionByName(within.unionByName(across).repartition(spark.sparkContext.defaultParallelism * 4, F.xxhash64("items", "others")))
    runs = works.mapInArrow(_runs, "code long, n long")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge(min_count), "code long, n long")

    low, high = unpack("code")
    merged = merged.select(low.alias("__a"), high.alias("__b"), F.col("n").alias("n_ab"))
    few = items.count() <= MOST_BROADCAST
    for side in "ab":
        named = items.select(F.col("code").alias(f"__{side}"), F.col("__i").alias(f"item_{side}"), F.col("__n").alias(f"n_{side}"))
        merged = merged.join(F.broadcast(named), f"__{side}") if few else skewed_join(settle(merged), named, [f"__{side}"])
    cells = [F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab"), F.lit(total) - F.col("n_a") - F.col("n_b") + F.col("n_ab")]
    a, b, c, d = (x.cast("double") + 0.5 for x in cells)
    lift = F.col("n_ab").cast("double") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    return merged.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total).cast("long").alias("records"), lift.alias("lift"), F.log((a * d) / (b * c)).alias("log_odds")).filter(F.col("lift") >= min_lift)
