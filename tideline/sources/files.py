"""Reading and writing files: event logs in several formats, tables, vectors, indexes and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.checks import require_columns
from tideline.operators.clean import earliest_sessions, hash_sample
from tideline.operators.codes import Quantiser

EVENT_SCHEMA = T.StructType([T.StructField("session", T.LongType()), T.StructField("aid", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("type", T.StringType())])
#: Type codes of logs that store numbers.
TYPE_CODES = {"0": "clicks", "1": "carts", "2": "orders"}
#: Version of stored quantisers.
QUANTISER_VERSION = 1
INDEX_VERSION = 5


def load_events(spark: SparkSession, path: str, max_sessions: int | None = None) -> DataFrame:
    """``session, aid, ts, type`` from parquet, CSV or line-delimited JSON, by the file's ending; others raise ValueError.

    Type codes become names, rows of other types go; ``max_sessions`` keeps the sessions that start first. No inference, no sort.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        rows = spark.read.parquet(path)
    elif kind == "csv":
        rows = spark.read.schema(EVENT_SCHEMA).option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        rows = spark.read.schema(EVENT_SCHEMA).json(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    require_columns(rows, *EVENT_SCHEMA.names)
    names = TYPE_CODES | {v: v for v in TYPE_CODES.values()}
    code = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("type").cast("string")]
    rows = rows.select("session", "aid", "ts", code.alias("type")).filter(F.col("type").isNotNull())
    return rows if max_sessions is None else earliest_sessions(rows, max_sessions)


def extract_states(spark: SparkSession, paths: list[str], names: tuple[str, ...] = ("categoryid", "available")) -> DataFrame:
    """``timestamp, itemid, property, value`` of the named properties from CSV files; values that aren't whole numbers go. The filter reaches the scan."""
    schema = "timestamp long, itemid long, property string, value string"
    rows = spark.read.schema(schema).option("header", True).csv(paths).filter(F.col("property").isin(*names))
    return rows.withColumn("value", F.expr("try_cast(value AS bigint)")).dropna()


def property_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows per property."""
    rows = spark.read.schema("timestamp long, itemid long, property string, value string").option("header", True).csv(paths)
    return rows.groupBy("property").agg(F.count(F.lit(1)).alias("rows"))


def open_dataset(source: str, filename: str, workdir: str) -> str:
    """Path of the one file of that name in a folder or a zip archive, from which it is unpacked; none or several raise ValueError."""
    if Path(source).is_dir():
        found = list(Path(source).rglob(filename))
        if len(found) != 1:
            raise ValueError(f"{len(found)} files named {filename}")
        return str(found[0])
    with zipfile.ZipFile(source) as archive:
        inside = [n for n in archive.namelist() if Path(n).name == filename]
        if len(inside) != 1:
            raise ValueError(f"{len(inside)} files named {filename}")
        return archive.extract(inside[0], workdir)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quotes and line breaks; lines that don't fit stand in ``_corrupt`` instead of ending the read."""
    return spark.read.schema(f"{schema}, _corrupt string").options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=True, escape='"').csv(path)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet with the columns and the filter pushed to the scan."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.filter(where)
    return rows if columns is None else rows.select(*columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, append: bool = False) -> None:
    """Parquet with zstd; the commit protocol shows all of a job's files or none."""
    writer = df.write.mode("append" if append else "overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sample: int | None = None, keys: tuple[str, ...] = (), seed: int = 7) -> None:
    """CSV with a header; with ``sample``, that many rows drawn by the hash of ``keys``."""
    (df if sample is None else hash_sample(df, sample, seed, *keys)).write.mode("overwrite").option("header", True).csv(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A JSON file on any file system Spark knows, replaced in one step."""
    fs, at, jvm = _hadoop(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{os.getpid()}.tmp")
    stream = fs.create(temporary, True)
    stream.write(bytearray(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode("utf-8")))
    stream.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(temporary, at)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A JSON file of :func:`write_json`; None if there is none."""
    fs, at, _ = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def sha256(path: str) -> str:
    """Fingerprint of a file."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def content_fingerprint(df: DataFrame) -> str:
    """Fingerprint of a table that doesn't depend on the order of its rows; runs a job."""
    row = df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.columns)}|{row.n}|{row.x}|{row.s}".encode()).hexdigest()


def save_vectors(vectors: DataFrame, path: str, version: int = 1) -> dict:
    """Write vectors with a manifest that holds the version and a fingerprint of the content."""
    write_table(vectors, f"{path}/data.parquet")
    manifest = {"version": version, "fingerprint": content_fingerprint(vectors.sparkSession.read.parquet(f"{path}/data.parquet"))}
    write_json(vectors.sparkSession, manifest, f"{path}/manifest.json")
    return manifest


def load_vectors(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Vectors of :func:`save_vectors`; another version or changed content raises ValueError."""
    manifest = read_json(spark, f"{path}/manifest.json") or {"version": None}
    rows = spark.read.parquet(f"{path}/data.parquet")
    if manifest["version"] != version:
        raise ValueError(f"version {manifest['version']}, not {version}")
    if manifest["fingerprint"] != content_fingerprint(rows):
        raise ValueError("the content has changed")
    return rows


def save_quantiser(spark: SparkSession, found: Quantiser, path: str) -> dict:
    """Write codes, codebooks and the preparation, with a manifest that holds sizes, measures and a fingerprint of all of it."""
    arrays = [(f"book_{i}", list(book.shape), book.ravel().tolist()) for i, book in enumerate(found.books)]
    arrays += [(name, list(x.shape), x.ravel().tolist()) for name, x in found.preparation.items() if isinstance(x, np.ndarray)]
    write_table(spark.createDataFrame(arrays, "name string, shape array<long>, numbers array<double>").coalesce(1), f"{path}/arrays.parquet")
    write_table(found.codes, f"{path}/codes.parquet")
    manifest = {"version": QUANTISER_VERSION, "levels": len(found.books), "preparation": {k: v for k, v in found.preparation.items() if not isinstance(v, np.ndarray)}, "measures": found.measures, "fingerprint": _quantiser_fingerprint(spark, path)}
    write_json(spark, manifest, f"{path}/manifest.json")
    return manifest


def _quantiser_fingerprint(spark: SparkSession, path: str) -> str:
    return "-".join(content_fingerprint(spark.read.parquet(f"{path}/{name}.parquet")) for name in ("arrays", "codes"))


def load_quantiser(spark: SparkSession, path: str) -> Quantiser:
    """The quantiser of :func:`save_quantiser`, ready to encode new items; another version or changed content raises ValueError."""
    manifest = read_json(spark, f"{path}/manifest.json") or {"version": None}
    if manifest["version"] != QUANTISER_VERSION:
        raise ValueError(f"version {manifest['version']}, not {QUANTISER_VERSION}")
    if manifest["fingerprint"] != _quantiser_fingerprint(spark, path):
        raise ValueError("the content has changed")
    arrays = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/arrays.parquet").collect()}
    books = [arrays.pop(f"book_{i}") for i in range(manifest["levels"])]
    return Quantiser(spark.read.parquet(f"{path}/codes.parquet"), books, manifest["preparation"] | arrays, manifest["measures"])


def cached_indexes(spark: SparkSession, path: str, cutoff: int, build) -> dict[str, DataFrame]:
    """Frozen indexes of a cut-off from the cache; built by ``build()`` and written where they lack or are of another version."""
    folder = f"{path}/cutoff={cutoff}"
    known = read_json(spark, f"{folder}/manifest.json") or {}
    if known.get("version") != INDEX_VERSION:
        tables = build()
        for name, df in tables.items():
            write_table(df, f"{folder}/{name}.parquet")
        known = {"version": INDEX_VERSION, "cutoff": cutoff, "tables": sorted(tables)}
        write_json(spark, known, f"{folder}/manifest.json")
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in known["tables"]}


def validate_profile(metadata: dict, expected: dict, events: DataFrame | None = None) -> None:
    """ValueError where a value differs from what is expected, or the number of sessions from the metadata's."""
    wrong = {k: (metadata.get(k), v) for k, v in expected.items() if metadata.get(k) != v}
    if wrong:
        raise ValueError(f"unexpected profile: {wrong}")
    if events is not None and "sessions" in metadata:
        n = events.select("session").distinct().count()
        if n != metadata["sessions"]:
            raise ValueError(f"{n} sessions, not {metadata['sessions']}")


def synthetic_log(spark: SparkSession, users: int = 200, items: int = 100, topics: int = 10, length: int = 12, seed: int = 7) -> DataFrame:
    """``user_id, item_id, timestamp, event_order``: users that stay with a topic most of the time; drawn by hashes, the same each time."""
    draw = lambda salt, *keys: F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), 11) / F.lit(float(1 << 53))
    rows = spark.range(users).select(F.col("id").alias("user_id")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    home = F.floor(draw(1, "user_id") * topics)
    topic = F.when(draw(2, "user_id", "p") < 0.8, home).otherwise(F.floor(draw(3, "user_id", "p") * topics))
    item = topic + topics * F.floor(draw(4, "user_id", "p") * (items // topics))
    return rows.select("user_id", item.cast("long").alias("item_id"), (F.col("p") * 60_000 + F.col("user_id")).cast("long").alias("timestamp"), F.col("p").cast("long").alias("event_order"))


def load_ratings(ratings: DataFrame, items: DataFrame, min_rating: float, catalogue: int, min_length: int, genres: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(events, features)``: liked items of the most rated ``catalogue`` by users with ``min_length`` or more, and genre shares of these items."""
    from tideline.functions.text import multi_hot
    from tideline.operators.clean import min_session_length, restrict_catalogue

    liked = restrict_catalogue(ratings.filter(F.col("rating") >= min_rating), catalogue, "item_id")
    events = min_session_length(liked, min_length, "user_id")
    kept = items.join(events.select("item_id").distinct(), "item_id", "left_semi")
    return events, kept.select("item_id", *multi_hot("genres", genres))
