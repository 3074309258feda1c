"""Queries over sources and sinks: tables are written as files into the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.adapters import ratings, vectors, with_sql
from tideline.functions import text
from tideline.operators import codes
from tideline.plans.registry import Registry
from tideline.session import ensure_shared_dir, read_table
from tideline.sources import files

query = Registry()


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_shared_dir(spark).rstrip('/')}/queries/{name}"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events_all").select("session", "aid", "ts", "type")


_KNOWN = "SELECT session, aid, ts, type FROM events_all WHERE type IN ('clicks', 'carts', 'orders')"


@query(_KNOWN)
def parquet_events(spark: SparkSession, folder: str) -> DataFrame:
    return files.load_events(spark, f"{folder}/events_all.parquet")


@query(_KNOWN)
def csv_events(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "events.csv")
    _raw(spark, folder).write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return files.load_events(spark, path)


@query(_KNOWN)
def json_events(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "events.jsonl")
    _raw(spark, folder).write.mode("overwrite").json(path)
    return files.load_events(spark, path)


def _properties(spark: SparkSession, folder: str) -> str:
    """CSV of item properties: categories and availability, and texts under a third name."""
    path, rows = _place(spark, "properties.csv"), None
    for table, column in (("item_category_changes", "categoryid"), ("item_availability_changes", "available"), ("item_category_changes", "recorded_ts")):
        value = F.concat(F.lit("n"), F.col(column)) if column == "recorded_ts" else F.col(column).cast("string")
        one = read_table(spark, folder, table).select("timestamp", "itemid", F.lit("790" if column == "recorded_ts" else column).alias("property"), value.alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


_PROPERTIES = "SELECT timestamp, itemid, 'categoryid' AS property, categoryid AS value FROM item_category_changes UNION ALL SELECT timestamp, itemid, 'available', available FROM item_availability_changes"


@query(f"SELECT * FROM ({_PROPERTIES}) WHERE timestamp IS NOT NULL AND itemid IS NOT NULL AND value IS NOT NULL")
def extracted_states(spark: SparkSession, folder: str) -> DataFrame:
    return files.extract_states(spark, [_properties(spark, folder)])


@query(f"SELECT property, count(*) AS rows FROM ({_PROPERTIES} UNION ALL SELECT timestamp, itemid, '790', 0 FROM item_category_changes) GROUP BY property")
def property_counts(spark: SparkSession, folder: str) -> DataFrame:
    return files.property_counts(spark, [_properties(spark, folder)])


@query("SELECT sample_id, aid, source FROM candidate_features WHERE label = 1")
def pruned_scan(spark: SparkSession, folder: str) -> DataFrame:
    return files.scan(spark, f"{folder}/candidate_features.parquet", ["sample_id", "aid", "source"], F.col("label") == 1)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def metadata_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "metadata.csv")
    read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', emptyValue='""').csv(path)
    return files.read_metadata(spark, path, "doc_id long, lang string, source string, n_chars long").filter("_corrupt IS NULL").drop("_corrupt")


@query("SELECT parentid, categoryid FROM category_tree")
def written_table(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "tree.parquet")
    files.write_table(read_table(spark, folder, "category_tree"), path, ["parentid"])
    return spark.read.parquet(path).select(F.col("parentid").cast("long").alias("parentid"), "categoryid")


@query("SELECT vec_id AS item_id, len(embedding) AS width FROM embeddings")
def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "vectors")
    files.save_vectors(vectors(spark, folder).select("item_id", "vector"), path)
    return files.load_vectors(spark, path).select("item_id", F.size("vector").alias("width"))


@query("SELECT count(*) AS items, true AS same FROM embeddings")
def stored_quantiser(spark: SparkSession, folder: str) -> DataFrame:
    """That a quantiser that was written and read encodes as the fitted one."""
    path, rows = _place(spark, "quantiser"), vectors(spark, folder)
    found = codes.fit_quantiser(rows, [8, 16], ratio=1.5, dimensions=16)
    files.save_quantiser(spark, found, path)
    own, again = codes.encode(rows, found), codes.encode(rows, files.load_quantiser(spark, path))
    differ = own.exceptAll(again).count() + again.exceptAll(own).count()
    return own.agg(F.count(F.lit(1)).alias("items"), F.lit(differ == 0).alias("same"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 7 AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) END AS tags FROM events")
def parsed_tags(spark: SparkSession, folder: str) -> DataFrame:
    literal = F.when(F.col("event_id") % 6 == 0, "oops").when(F.col("event_id") % 3 != 0, F.concat(F.lit("["), (F.col("event_id") % 7).cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit("]")))
    rows = read_table(spark, folder, "events").withColumn("literal", literal)
    return rows.select("event_id", F.array_join(text.parse_tags("literal"), ",").alias("tags"))


@query(f"""{with_sql('ratings')}, liked AS (SELECT * FROM ratings WHERE rating >= 2.5), top AS (SELECT item_id FROM liked GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 150), kept AS (SELECT l.* FROM liked l JOIN top USING (item_id)),
 users AS (SELECT user_id FROM kept GROUP BY user_id HAVING count(*) >= 3), ev AS (SELECT k.* FROM kept k JOIN users USING (user_id))
 SELECT item_id, count(*) AS events, round(CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE 1.0 END, 6) AS even_or_odd, round(CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.0 END, 6) AS even FROM ev GROUP BY item_id""")
def rated_items(spark: SparkSession, folder: str) -> DataFrame:
    """Liked items of the most rated by users with enough of them, and shares of two made-up genres."""
    rows = ratings(spark, folder)
    items = rows.select("item_id").distinct().withColumn("genres", F.when(F.col("item_id") % 2 == 0, "any|even").otherwise("any"))
    events, features = files.load_ratings(rows, items, 2.5, 150, 3, ["any", "even"])
    names = [c for c in features.columns if c != "item_id"]
    counts = events.groupBy("item_id").agg(F.count(F.lit(1)).alias("events"))
    return counts.join(features, "item_id").select("item_id", "events", F.round(names[0], 6).alias("even_or_odd"), F.round(names[1], 6).alias("even"))


QUERIES, ORACLES = query.queries, query.oracles
