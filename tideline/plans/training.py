"""Queries for the two general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.bitemporal import as_known, clean_states, newest_states
from tideline.operators.events import IDENTITY, typed_events
from tideline.operators.skew import skewed_aggregate, skewed_join
from tideline.session import read_table, settle


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counted events of every item and mapped type."""
    return skewed_aggregate(typed_events(read_table(spark, folder, "events_all")), ["aid", "type"], {"events": ("count", None)}, distinct_on=IDENTITY)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items and types with at least 0.5 % of all counted events."""
    counts = settle(p1_counts(spark, folder))
    total = counts.agg(F.sum("events")).first()[0] or 0
    return counts.filter(F.col("events") >= 0.005 * total).select("aid", "type")


def _sample_states(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    samples = read_table(spark, folder, "validation_samples").select("sample_id", "session", "target_aid", "target_ts").distinct()
    samples = samples.select("sample_id", "session", F.col("target_aid").alias("itemid"), "target_ts", F.explode(F.array(F.lit("categoryid"), F.lit("available"))).alias("attribute"))
    changes = None
    for table, attribute in (("item_category_changes", "categoryid"), ("item_availability_changes", "available")):
        one = read_table(spark, folder, table).select(F.lit(attribute).alias("attribute"), "itemid", "timestamp", F.col(attribute).alias("value"), "recorded_ts")
        changes = one if changes is None else changes.unionByName(one)
    return settle(samples), settle(clean_states(changes, ["attribute", "itemid"], "value"))


def p4_states(spark: SparkSession, folder: str) -> DataFrame:
    """Category and availability of each sample's item as known at its time."""
    known = as_known(*_sample_states(spark, folder), ["attribute", "itemid"], ["value"])
    return known.select("sample_id", "attribute", F.coalesce("state_ts", F.lit(-1)).alias("state_ts"), F.coalesce("state_value", F.lit(-1)).alias("state_value"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Samples whose known state differs from the newest one; the newest is attached first, so that the trees are built once."""
    samples, states = _sample_states(spark, folder)
    newest = newest_states(states, ["attribute", "itemid"], "value").select("attribute", "itemid", F.col("value").alias("newest"))
    known = as_known(settle(skewed_join(samples, newest, ["attribute", "itemid"])), states, ["attribute", "itemid"], ["value"])
    return known.filter(~F.col("state_value").eqNullSafe(F.col("newest"))).select("session", "attribute", F.coalesce("state_ts", F.lit(-1)).alias("state_ts")).distinct()


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p4_found": p4_found, "p4_states": p4_states}

_TYPE = "CASE WHEN trim(lower(type)) IN ('clicks', 'view') THEN 'clicks' WHEN trim(lower(type)) IN ('carts', 'addtocart') THEN 'carts' WHEN trim(lower(type)) IN ('orders', 'transaction') THEN 'orders' END"
COUNTED_SQL = f"counted AS (SELECT DISTINCT session, visitorid, aid, ts, {_TYPE} AS type, transactionid FROM events_all WHERE aid IS NOT NULL AND {_TYPE} IS NOT NULL)"
_CHANGES = """changes AS (
  SELECT 'categoryid' AS attribute, itemid, timestamp AS ts, categoryid AS value, recorded_ts FROM item_category_changes
  UNION ALL SELECT 'available', itemid, timestamp, available, recorded_ts FROM item_availability_changes),
states AS (SELECT attribute, itemid, ts, min(value) AS value, min(recorded_ts) AS recorded_ts FROM changes
  WHERE itemid IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL HAVING min(value) = max(value)),
samples AS (SELECT DISTINCT sample_id, session, target_aid, target_ts, unnest(['categoryid', 'available']) AS attribute FROM validation_samples),
known AS (SELECT s.sample_id, s.session, s.target_aid, s.attribute, max(c.ts) AS state_ts, arg_max(c.value, c.ts) AS state_value
  FROM samples s LEFT JOIN states c ON c.itemid = s.target_aid AND c.attribute = s.attribute AND c.recorded_ts <= s.target_ts AND c.ts <= s.target_ts GROUP BY ALL)"""
ORACLES = {
    "p1_found": f"WITH {COUNTED_SQL} SELECT aid, type FROM counted GROUP BY ALL HAVING count(*) >= 0.005 * (SELECT count(*) FROM counted)",
    "p1_counts": f"WITH {COUNTED_SQL} SELECT aid, type, count(*) AS events FROM counted GROUP BY ALL",
    "p4_found": f"WITH {_CHANGES}, newest AS (SELECT attribute, itemid, arg_max(value, ts) AS newest FROM states GROUP BY ALL) SELECT DISTINCT k.session, k.attribute, coalesce(k.state_ts, -1) AS state_ts FROM known k JOIN newest n ON n.attribute = k.attribute AND n.itemid = k.target_aid WHERE k.state_value IS DISTINCT FROM n.newest",
    "p4_states": f"WITH {_CHANGES} SELECT sample_id, attribute, coalesce(state_ts, -1) AS state_ts, coalesce(state_value, -1) AS state_value FROM known",
}
