"""Item state as of a time, category paths and catalogue snapshots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import settle

DAY_MS = 86_400_000


def backward_asof(queries: DataFrame, states: DataFrame, key: str, time: str, state_key: str, state_time: str, values: list[str], prefix: str = "", bucket_ms: int = 7 * DAY_MS, cell_rows: int = 1_000_000) -> DataFrame:
    """Add to each query the values and ``<prefix>state_ts`` of the last state of its key with a time not later than its own.

    States of one key and time: the one with the greatest values. Nulls in key or time match nothing; other columns of the states don't
    matter. See :func:`backward_asof_all` for how it is done.
    """
    return backward_asof_all(queries, key, time, [(states, state_key, state_time, values, prefix)], bucket_ms, cell_rows)


def backward_asof_all(queries: DataFrame, key: str, time: str, tables: list[tuple[DataFrame, str, str, list[str], str]], bucket_ms: int = 7 * DAY_MS, cell_rows: int = 1_000_000) -> DataFrame:
    """:func:`backward_asof` for several state tables ``(states, key, time, values, prefix)`` in one pass over the queries.

    Queries and states are united and the last state of each table is carried forward. A key is cut into cells by time; cells of more than
    ``cell_rows`` rows are range-sorted by key and time and cut by the number of rows, so that a key that holds most rows, of all times or
    of one, is spread over many tasks (rows of one key and instant stay together). What comes before a cell is carried in one row per cell.
    Rows are counted first, in a job, and those of large cells are settled; all others are shuffled once.
    """
    tagged = queries.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.struct(*(queries[c] for c in queries.columns)).alias("__q"))
    kinds, parts = [], []
    for states, state_key, state_time, values, _ in tables:
        kept = states.select(F.col(state_key).alias("__k"), F.col(state_time).alias("__t"), *(F.col(v).alias(f"__v_{v}") for v in values)).dropna(subset=["__k", "__t"])
        parts.append(kept.select("__k", "__t", F.struct(F.col("__t").alias("t"), *(F.col(f"__v_{v}").alias(v) for v in values)).alias("__s")))
        kinds.append(parts[-1].schema["__s"].dataType)
    empty = [F.lit(None).cast(kind).alias(f"__s{i}") for i, kind in enumerate(kinds)]
    both = tagged.select("__k", "__t", "__q", *empty, F.lit(1).alias("__tag"))
    for i, part in enumerate(parts):
        own = [F.col("__s").alias(f"__s{i}") if i == j else e for j, e in enumerate(empty)]
        both = both.unionByName(part.select("__k", "__t", F.lit(None).cast(tagged.schema["__q"].dataType).alias("__q"), *own, F.lit(0).alias("__tag")))
    both = both.withColumns({"__b": F.expr(f"__t div {bucket_ms}"), "__c": F.lit(0)})
    cells = both.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    large = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")).first()
    if large["cells"]:
        names = cells.select(F.col("__k").alias("__k2"), F.col("__b").alias("__b2"))
        names = F.broadcast(names) if large["cells"] <= 200_000 else names
        same = F.col("__k").eqNullSafe(F.col("__k2")) & F.col("__b").eqNullSafe(F.col("__b2"))
        cut = both.join(names, same, "left_semi").repartitionByRange(2 * math.ceil(large["rows"] / cell_rows), "__k", "__t")
        both = both.join(names, same, "left_anti").unionByName(settle(cut.withColumn("__c", F.spark_partition_id())))
    inside = Window.partitionBy("__k", "__b", "__c").orderBy("__t", "__tag", *(f"__s{i}" for i in range(len(tables)))).rowsBetween(Window.unboundedPreceding, 0)
    last_of = both.groupBy("__k", "__b", "__c").agg(*(F.max(f"__s{i}").alias(f"__last{i}") for i in range(len(tables))))
    before = Window.partitionBy("__k").orderBy("__b", "__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of.select("__k", "__b", "__c", *(F.last(f"__last{i}", ignorenulls=True).over(before).alias(f"__before{i}") for i in range(len(tables))))
    rows = both.select("__k", "__t", "__b", "__c", "__q", "__tag", *(F.last(f"__s{i}", ignorenulls=True).over(inside).alias(f"__own{i}") for i in range(len(tables)))).filter("__tag = 1")
    joined = rows.join(carried, rows["__k"].eqNullSafe(carried["__k"]) & rows["__b"].eqNullSafe(carried["__b"]) & (rows["__c"] == carried["__c"]), "left")
    found = {f"__f{i}": F.when(rows["__k"].isNotNull() & rows["__t"].isNotNull(), F.coalesce(f"__own{i}", f"__before{i}")) for i in range(len(tables))}
    out = [c for i, (*_, values, prefix) in enumerate(tables) for c in (F.col(f"__f{i}.t").alias(f"{prefix}state_ts"), *(F.col(f"__f{i}.{v}").alias(v) for v in values))]
    return joined.withColumns(found).select("__q.*", *out)


def asof_enrich(events: DataFrame, categories: DataFrame, availability: DataFrame, paths: DataFrame) -> DataFrame:
    """Category, availability and category path of each event's item as of its time; -1, false and ``[-1]`` where unknown."""
    rows = backward_asof_all(events, "aid", "ts", [(categories, "itemid", "timestamp", ["categoryid"], "category_"), (availability, "itemid", "timestamp", ["available"], "availability_")])
    rows = rows.join(paths, "categoryid", "left")
    fill = {c: F.coalesce(c, F.lit(-1)) for c in ("categoryid", "category_state_ts", "available", "availability_state_ts", "root_categoryid", "category_depth")}
    return rows.withColumns(fill | {"category_path": F.coalesce("category_path", F.array(F.lit(-1).cast("long"))), "in_tree": F.coalesce("in_tree", F.lit(False))})


def latest_state(changes: DataFrame, cutoff: int, value: str, item: str = "itemid", time: str = "timestamp") -> DataFrame:
    """``item, value, state_ts`` of each item's last change strictly before ``cutoff``; ties to the greater value."""
    last = changes.filter((F.col(time) < cutoff) & F.col(item).isNotNull()).groupBy(item).agg(F.max(F.struct(time, value)).alias("m"))
    return last.select(item, F.col(f"m.{value}").alias(value), F.col(f"m.{time}").alias("state_ts"))


def item_snapshot(cutoff: int, categories: DataFrame, availability: DataFrame, paths: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Item table as of ``cutoff``: category with path, availability, first sight, and their ages in days; items known to any of them."""
    cat = latest_state(categories, cutoff, "categoryid").withColumnsRenamed({"itemid": "aid", "state_ts": "category_state_ts"})
    cat = cat.join(paths.drop("category_path"), "categoryid", "left")
    avail = latest_state(availability, cutoff, "available").withColumnsRenamed({"itemid": "aid", "state_ts": "availability_state_ts"})
    rows = cat.join(avail, "aid", "full_outer").join(first_seen, "aid", "full_outer")
    age = lambda c: (F.lit(cutoff) - F.col(c)) / F.lit(float(DAY_MS))
    return rows.withColumns({"candidate_age_days": age("first_seen_ts"), "category_state_age_days": age("category_state_ts"), "availability_state_age_days": age("availability_state_ts")})


def first_seen(events: DataFrame, item: str = "aid", time: str = "ts") -> DataFrame:
    """``aid, first_seen_ts``."""
    return events.groupBy(F.col(item).alias("aid")).agg(F.min(time).alias("first_seen_ts"))


def catalogue_snapshots(events: DataFrame, interval_ms: int = DAY_MS) -> DataFrame:
    """``snapshot_ts, catalog_items, new_items``: items first seen strictly before each interval start in which events happen.

    Items are counted per interval before anything is ordered; the running sum is over intervals, whose number doesn't
    depend on the rows.
    """
    floor = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(interval_ms))
    born = first_seen(events).withColumn("snapshot_ts", floor("first_seen_ts") + interval_ms).withColumn("snapshot_ts", F.when(F.pmod("first_seen_ts", F.lit(interval_ms)) == 0, F.col("first_seen_ts") + interval_ms).otherwise(F.col("snapshot_ts")))
    births = born.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("born"))
    asked = events.select(floor("ts").alias("snapshot_ts")).distinct().withColumn("asked", F.lit(True))
    line = asked.join(births, "snapshot_ts", "full_outer")
    w = Window.partitionBy(F.lit(0)).orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("catalog_items", F.coalesce(F.sum("born").over(w), F.lit(0))).filter("asked")
    steps = Window.partitionBy(F.lit(0)).orderBy("snapshot_ts")
    return rows.select("snapshot_ts", "catalog_items", (F.col("catalog_items") - F.lag("catalog_items", 1, 0).over(steps)).alias("new_items"))


def category_paths(spark: SparkSession, tree: DataFrame, observed: DataFrame, max_depth: int = 64) -> DataFrame:
    """``categoryid, root_categoryid, category_depth, category_path, in_tree`` of all categories of the tree and the observed ones.

    A category outside the tree is its own path. A path longer than ``max_depth`` (a cycle) raises ValueError. Runs a job per
    level of the tree.
    """
    parents = tree.select(F.col("categoryid").alias("__c"), "parentid")
    known = parents.select("__c")
    paths = tree.select("categoryid", F.array("categoryid").alias("category_path"), F.col("parentid").alias("__next"))
    for depth in range(max_depth + 1):
        open_ = paths.filter(F.col("__next").isNotNull())
        if not open_.limit(1).count():
            break
        if depth == max_depth:
            raise ValueError("the category tree has a cycle")
        up = paths.join(parents.withColumnRenamed("parentid", "__up"), F.col("__next") == F.col("__c"), "left")
        paths = up.select("categoryid", F.when(F.col("__next").isNotNull(), F.concat(F.array("__next"), "category_path")).otherwise(F.col("category_path")).alias("category_path"), F.col("__up").alias("__next"))
    inside = paths.withColumn("in_tree", F.lit(True)).drop("__next")
    outside = observed.select("categoryid").dropna().distinct().join(known.withColumnRenamed("__c", "categoryid"), "categoryid", "left_anti")
    outside = outside.select("categoryid", F.array("categoryid").alias("category_path"), F.lit(False).alias("in_tree"))
    rows = inside.unionByName(outside)
    return rows.select("categoryid", F.col("category_path")[0].alias("root_categoryid"), (F.size("category_path") - 1).cast("long").alias("category_depth"), "category_path", "in_tree")


def availability_audit(enriched: DataFrame, action: str = "type") -> DataFrame:
    """Per action: events with known, available and unavailable items and the age of the known state in hours."""
    age = F.when(F.col("availability_state_ts") >= 0, (F.col("ts") - F.col("availability_state_ts")) / F.lit(3_600_000.0))
    return enriched.groupBy(action).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("available") == 1).alias("available_events"),
        F.count_if(F.col("available") == 0).alias("unavailable_events"),
        F.count_if(F.col("available") == -1).alias("unknown_events"),
        F.percentile(age, 0.5).alias("age_hours_median"),
        F.percentile(age, 0.9).alias("age_hours_p90"),
        F.percentile(age, 0.99).alias("age_hours_p99"),
    )
