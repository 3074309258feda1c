"""Views of the test tables as the logs that the operators take.

Each adapter has an equivalent SQL text in :data:`SQL`, so that both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import read_table

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
#: Gap that ends a session of the behaviour log.
SESSION_GAP_MS = 12 * HOUR_MS
#: Cut-off of the frozen indexes, 2024-01-22 00:00 UTC.
CUTOFF_MS = 1_705_881_600_000


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp column."""
    return F.expr(f"unix_micros(cast({column} as timestamp)) div 1000")


def raw_behaviour(spark: SparkSession, folder: str) -> DataFrame:
    """``timestamp, visitorid, event, itemid, transactionid, event_order, value``: raw log with raw event names."""
    events = read_table(spark, folder, "events")
    name = F.when(F.col("event_type").isin("view", "click"), "view").when(F.col("event_type") == "signup", "addtocart").when(F.col("event_type") == "purchase", "transaction").otherwise(F.col("event_type"))
    return events.select(
        millis("ts").alias("timestamp"),
        F.col("user_id").alias("visitorid"),
        name.alias("event"),
        F.get_json_object("props", "$.k").cast("long").alias("itemid"),
        F.lit(None).cast("double").alias("transactionid"),
        F.col("event_id").alias("event_order"),
        "value",
    )


def behaviour(spark: SparkSession, folder: str) -> DataFrame:
    """``session, visitorid, aid, ts, type, event_order, value``: sessionised events of known types."""
    raw = raw_behaviour(spark, folder)
    kind = F.when(F.col("event") == "view", "clicks").when(F.col("event") == "addtocart", "carts").when(F.col("event") == "transaction", "orders")
    rows = raw.select("visitorid", F.col("itemid").alias("aid"), F.col("timestamp").alias("ts"), kind.alias("type"), "event_order", "value").filter(F.col("type").isNotNull())
    order = Window.partitionBy("visitorid").orderBy("ts", "event_order")
    starts = F.coalesce((F.col("ts") - F.lag("ts").over(order) > SESSION_GAP_MS).cast("int"), F.lit(1))
    numbered = rows.withColumn("__new", starts).withColumn("__seq", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.select((F.col("visitorid") * 100_000 + F.col("__seq")).alias("session"), "visitorid", "aid", "ts", "type", "event_order", "value")


def basket(spark: SparkSession, folder: str) -> DataFrame:
    """``session, visitorid, aid, ts, type, event_order``: order lines as sessions of days; many times are tied."""
    lines, orders = read_table(spark, folder, "lineitem"), read_table(spark, folder, "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    kind = F.when(F.col("l_returnflag") == "N", "clicks").when(F.col("l_returnflag") == "A", "carts").otherwise("orders")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("session"),
        F.col("o_custkey").alias("visitorid"),
        F.col("l_partkey").alias("aid"),
        millis("l_shipdate").alias("ts"),
        kind.alias("type"),
        F.row_number().over(order).cast("long").alias("event_order"),
    )


def state(spark: SparkSession, folder: str) -> DataFrame:
    """``itemid, timestamp, categoryid, available``: item state changes."""
    events = read_table(spark, folder, "events").filter(F.col("event_type") == "error")
    return events.select(F.get_json_object("props", "$.k").cast("long").alias("itemid"), millis("ts").alias("timestamp"), (F.col("event_id") % 25 + 100).alias("categoryid"), (F.col("event_id") % 2).alias("available"))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """``categoryid, parentid``: nations below regions."""
    nation = read_table(spark, folder, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("categoryid"), F.col("n_regionkey").cast("long").alias("parentid"))
    region = read_table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("categoryid"), F.lit(None).cast("long").alias("parentid"))
    return nation.unionByName(region)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, item_id, timestamp, rating``."""
    lines, orders = read_table(spark, folder, "lineitem"), read_table(spark, folder, "orders")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), millis("l_shipdate").alias("timestamp"), (F.col("l_quantity") / F.lit(10.0)).alias("rating"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, item_id, timestamp, event_order, is_positive``."""
    events = read_table(spark, folder, "events")
    positive = ((F.col("value") >= 35.0) & (F.col("event_type") != "error")).cast("int")
    return events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), millis("ts").alias("timestamp"), F.col("event_id").alias("event_order"), positive.alias("is_positive"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``item_id, vector, label``."""
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def item_vectors(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """``item_id, vector``: the vector of each ``aid`` from its highest epoch, if it has ``width`` finite numbers that aren't all zero."""
    exports = read_table(spark, folder, "item2vec_embeddings").filter(F.col("item_ids").isNotNull())
    newest = exports.groupBy(F.col("item_ids").alias("item_id")).agg(F.max(F.struct("epoch", "vectors"))["vectors"].alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return newest.filter(F.col("vector").isNotNull() & (F.size("vector") == width)).filter(finite)


_K = "cast(json_extract_string(props, '$.k') as bigint)"
SQL = {
    "raw": f"raw AS (SELECT epoch_us(ts)//1000 AS timestamp, user_id AS visitorid, CASE WHEN event_type IN ('view', 'click') THEN 'view' WHEN event_type = 'signup' THEN 'addtocart' WHEN event_type = 'purchase' THEN 'transaction' ELSE event_type END AS event, {_K} AS itemid, event_id AS event_order, value FROM events)",
    "beh": f"""beh0 AS (SELECT user_id AS visitorid, {_K} AS aid, epoch_us(ts)//1000 AS ts,
  CASE WHEN event_type IN ('view', 'click') THEN 'clicks' WHEN event_type = 'signup' THEN 'carts' WHEN event_type = 'purchase' THEN 'orders' END AS type, event_id AS event_order, value FROM events WHERE event_type <> 'error'),
beh1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY visitorid ORDER BY ts, event_order) <= {SESSION_GAP_MS} THEN 0 ELSE 1 END AS fresh FROM beh0),
beh AS (SELECT CAST(visitorid * 100000 + sum(fresh) OVER (PARTITION BY visitorid ORDER BY ts, event_order) AS BIGINT) AS session, visitorid, aid, ts, type, event_order, value FROM beh1)""",
    "basket": """basket AS (SELECT l_orderkey AS session, o_custkey AS visitorid, l_partkey AS aid, epoch_us(l_shipdate)//1000 AS ts,
  CASE l_returnflag WHEN 'N' THEN 'clicks' WHEN 'A' THEN 'carts' ELSE 'orders' END AS type,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS event_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "state": f"state AS (SELECT {_K} AS itemid, epoch_us(ts)//1000 AS timestamp, 100 + event_id % 25 AS categoryid, event_id % 2 AS available FROM events WHERE event_type = 'error')",
    "tree": "tree AS (SELECT CAST(100 + n_nationkey AS BIGINT) AS categoryid, CAST(n_regionkey AS BIGINT) AS parentid FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), NULL FROM region)",
    "ratings": "ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_us(l_shipdate)//1000 AS timestamp, l_quantity / 10.0 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "feedback": f"feedback AS (SELECT user_id, {_K} AS item_id, epoch_us(ts)//1000 AS timestamp, event_id AS event_order, CASE WHEN value >= 35.0 AND event_type <> 'error' THEN 1 ELSE 0 END AS is_positive FROM events)",
    "vectors": "vectors AS (SELECT vec_id AS item_id, embedding AS vector, label FROM embeddings)",
}


def with_sql(*names: str) -> str:
    """``WITH`` clause of the named adapters."""
    return "WITH " + ",\n".join(SQL[name] for name in names)
