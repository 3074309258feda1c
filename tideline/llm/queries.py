"""Queries of the problems in this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bpe import token_ids
from tideline.llm.mixing import Mix, mix_sources
from tideline.llm.neighbours import nearest, valid_vectors
from tideline.llm.pairs import pair_counts
from tideline.llm.subjects import assign_subjects, fit_subjects
from tideline.llm.topn import top_n
from tideline.operators.events import typed_events
from tideline.operators.vectors import cosine_topk
from tideline.plans.training import COUNTED_SQL
from tideline.session import read_table, settle


def _pairs(spark: SparkSession, folder: str, **limits: float) -> DataFrame:
    return pair_counts(typed_events(read_table(spark, folder, "events_all")), "session", "aid", **limits)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items in at least 10 sessions together and 15 times as often as by chance."""
    return _pairs(spark, folder, min_count=10, min_lift=15.0).select(F.col("item_a").alias("aid_a"), F.col("item_b").alias("aid_b"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of items of a session with their counts and measures."""
    pairs = _pairs(spark, folder)
    return pairs.select(F.col("item_a").alias("aid_a"), F.col("item_b").alias("aid_b"), "n_ab", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return valid_vectors(read_table(spark, folder, "item2vec_embeddings"), "item_ids", "vectors", "epoch", 64)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items with a cosine of 0.94 or more."""
    near = nearest(_vectors(spark, folder), 10, probes=3, gap=0.2, m=10, build_width=24, ef=14, least=0.94)
    return near.select(F.least("item", "neighbour").alias("item_id_a"), F.greatest("item", "neighbour").alias("item_id_b")).distinct()


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar items of every item."""
    near = nearest(_vectors(spark, folder), 10, probes=4, m=16, build_width=48, ef=96)
    return near.select(F.col("item").alias("item_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Items divisible by 20, all their true ten most similar items, and whether p3_neighbours holds 0.95 or more of these."""
    return _recall(spark, folder).select("asked", "pairs", (F.col("held") >= 0.95 * F.col("pairs")).alias("reached"))


def _recall(spark: SparkSession, folder: str) -> DataFrame:
    valid = settle(_vectors(spark, folder))
    near = p3_neighbours(spark, folder).filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), F.col("neighbour_id").alias("item_id"), F.lit(1).alias("held"))
    catalogue = valid.withColumnRenamed("item", "item_id")
    exact = cosine_topk(catalogue.filter(F.col("item_id") % 20 == 0).withColumnRenamed("item_id", "query_id"), catalogue, 10, same=True)
    return exact.join(near, ["query_id", "item_id"], "left").agg(F.count_distinct("query_id").alias("asked"), F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best items of every sample with score and rank."""
    return top_n(read_table(spark, folder, "candidate_features"), "sample_id", "aid", "final_score", 10)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best items of every sample."""
    return p5_top(spark, folder).select("sample_id", "aid")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document under byte_bpe_50k."""
    return token_ids(read_table(spark, folder, "documents"), "doc_id")


def _mix(spark: SparkSession, folder: str) -> Mix:
    return mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mixture_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't fill their share: the mix holds them as often as allowed, and that is too little."""
    shares = _mix(spark, folder).shares
    return shares.filter((F.col("capacity_tokens") < F.col("wanted_tokens")) & (F.col("used_tokens") >= F.col("capacity_tokens"))).select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed documents by output shard."""
    return _mix(spark, folder).rows


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of the sources."""
    return _mix(spark, folder).shares


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of every document with the sentences about them."""
    documents = read_table(spark, folder, "documents")
    return assign_subjects(documents, *fit_subjects(documents, read_table(spark, folder, "subject_examples")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the subjects that a quarter or more of their sentences are about."""
    return p8_subjects(spark, folder).select("doc_id", "subject")


def p8_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Make-up of the corpus: documents and sentences by subject."""
    return p8_subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("about").alias("sentences"))


def p8_accuracies(spark: SparkSession, folder: str) -> DataFrame:
    """Votes of each labelling function and the learned share of right ones among those for sentences with a subject."""
    known, _ = fit_subjects(read_table(spark, folder, "documents"), read_table(spark, folder, "subject_examples"))
    return spark.createDataFrame(known.accuracies, "function string, votes long, accuracy double")


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_recall": p3_recall,
    "p5_found": p5_found,
    "p5_top": p5_top,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_subjects": p8_subjects,
    "p8_corpus": p8_corpus,
    "p8_accuracies": p8_accuracies,
}

_PAIRS = f"""WITH {COUNTED_SQL}, held AS (SELECT DISTINCT session, aid FROM counted WHERE session IS NOT NULL),
total AS (SELECT count(DISTINCT session)::DOUBLE AS s FROM held), single AS (SELECT aid, count(*)::DOUBLE AS n FROM held GROUP BY aid),
together AS (SELECT a.aid AS aid_a, b.aid AS aid_b, count(*) AS n_ab FROM held a JOIN held b ON a.session = b.session AND a.aid < b.aid GROUP BY ALL),
measured AS (SELECT t.*, x.n AS n_a, y.n AS n_b, s FROM together t JOIN single x ON x.aid = aid_a JOIN single y ON y.aid = aid_b, total)"""
_TOP = """WITH valid AS (SELECT sample_id, aid, max(final_score) AS final_score FROM candidate_features
  WHERE sample_id IS NOT NULL AND aid IS NOT NULL AND isfinite(final_score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY final_score DESC, aid) AS rank FROM valid)"""
_VECTORS = """WITH newest AS (SELECT item_ids AS i, max(struct_pack(e := epoch, v := vectors)).v AS v FROM item2vec_embeddings WHERE item_ids IS NOT NULL GROUP BY item_ids),
valid AS (SELECT i, v::DOUBLE[] AS v FROM newest WHERE len(v) = 64 AND len([x for x in v if isfinite(x)]) = 64 AND len([x for x in v if x <> 0]) > 0)"""
ORACLES = {
    "p3_recall": f"{_VECTORS} SELECT count(*) AS asked, CAST(sum(least(10, (SELECT count(*) FROM valid) - 1)) AS BIGINT) AS pairs, true AS reached FROM valid WHERE i % 20 = 0",
    "p3_found": f"{_VECTORS} SELECT a.i AS item_id_a, b.i AS item_id_b FROM valid a JOIN valid b ON a.i < b.i WHERE list_cosine_similarity(a.v, b.v) >= 0.94",
    "p2_found": f"{_PAIRS} SELECT aid_a, aid_b FROM measured WHERE n_ab >= 10 AND n_ab * s / (n_a * n_b) >= 15",
    "p2_pairs": f"{_PAIRS} SELECT aid_a, aid_b, n_ab, round(n_ab * s / (n_a * n_b), 6) AS lift, round(ln((n_ab + 0.5) * (s - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds FROM measured",
    "p5_found": f"{_TOP} SELECT sample_id, aid FROM ranked WHERE rank <= 10",
    "p5_top": f"{_TOP} SELECT sample_id, aid, final_score, rank FROM ranked WHERE rank <= 10",
}
