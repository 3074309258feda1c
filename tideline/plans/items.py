"""Queries over codes, vectors, embeddings, texts and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.adapters import behaviour, feedback, item_vectors, vectors, with_sql
from tideline.functions import text as texts_of
from tideline.operators import codes, embeddings, features, fusion, indexes, metrics, models, sequences
from tideline.operators import vectors as vec
from tideline.operators.sessions import number_rows
from tideline.plans.events import rounded, texts
from tideline.plans.recall import ROUTE_NAMES, candidates, labels
from tideline.plans.registry import Registry
from tideline.session import read_table, settle
from tideline.sources import files

query = Registry()
_CODES = "codes AS (SELECT item_id, CAST(label AS BIGINT) AS c1, item_id % 5 AS c2, item_id // 7 % 4 AS c3, label FROM vectors)"
_WITH = f"{with_sql('vectors')}, {_CODES}"


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select("item_id", F.col("label").cast("long").alias("c1"), (F.col("item_id") % 5).alias("c2"), F.expr("item_id div 7 % 4").alias("c3"), "label")


@query(f"{_WITH} SELECT item_id, c1, c2, c3, row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY item_id) - 1 AS tail FROM codes")
def collision_tail(spark: SparkSession, folder: str) -> DataFrame:
    return codes.collision_tail(_codes(spark, folder)).drop("label")


@query(f"{_WITH}, g AS (SELECT count(*) AS n FROM codes GROUP BY c1, c2, c3) SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS unique_codes, max(n) AS largest_bucket, round(1 - count(*) / sum(n), 6) AS collision_rate FROM g")
def collision_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(codes.collision_rate(_codes(spark, folder)))


_LEVELS = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS level, {c} AS token, CAST({s} AS DOUBLE) AS size FROM codes" for i, (c, s) in enumerate((("c1", 10), ("c2", 5), ("c3", 4))))


@query(f"{_WITH}, t AS (SELECT level, size, token, count(*)::DOUBLE AS n FROM ({_LEVELS}) GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY level) AS p FROM t) SELECT level, count(*) AS used_tokens, round(count(*) / any_value(size), 6) AS utilization, round(-sum(p * log2(p)), 6) AS entropy_bits, round(-sum(p * log2(p)) / log2(any_value(size)), 6) AS normalized_entropy, CAST(max(n) AS BIGINT) AS largest_bucket FROM p GROUP BY level")
def codebook_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(codes.codebook_stats(_codes(spark, folder).drop("label"), [10, 5, 4]))


@query()
def compared_codebooks(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic against random codes of the same sizes."""
    rows = vectors(spark, folder)
    semantic = codes.codebook_stats(codes.assign(rows, codes.fit_codebooks(rows, [8, 8])), [8, 8])
    return codes.compare_stats(codes.codebook_stats(codes.random_codes(rows, [8, 8]), [8, 8]), semantic)


def _pair_sql() -> str:
    pairs = "(SELECT coalesce(sum(n * (n - 1) / 2), 0)::DOUBLE FROM (SELECT count(*) AS n FROM codes GROUP BY {}))"
    rows = []
    for i, c in enumerate(("c1", "c2", "c3")):
        prefix = ", ".join(("c1", "c2", "c3")[: i + 1])
        w, a = pairs.format("lab"), "(SELECT count(*) * (count(*) - 1) / 2.0 FROM codes)"
        same, other = f"{pairs.format('lab, ' + prefix)} / {w}", f"({pairs.format(prefix)} - {pairs.format('lab, ' + prefix)}) / ({a} - {w})"
        rows.append(f"SELECT CAST({i + 1} AS BIGINT) AS level, round({pairs.format('lab, ' + c)} / {w}, 6) AS token_same, round(({pairs.format(c)} - {pairs.format('lab, ' + c)}) / ({a} - {w}), 6) AS token_other, round({same}, 6) AS prefix_same, round({other}, 6) AS prefix_other, round(({same}) / greatest({other}, 1e-12), 6) AS lift")
    return " UNION ALL ".join(rows)


_LABELLED = "codes AS (SELECT item_id, item_id % 5 AS c1, item_id // 7 % 4 AS c2, item_id // 3 % 6 AS c3, label % 3 AS lab FROM vectors)"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select("item_id", (F.col("item_id") % 5).alias("c1"), F.expr("item_id div 7 % 4").alias("c2"), F.expr("item_id div 3 % 6").alias("c3"), (F.col("label") % 3).alias("lab"))


@query(f"{with_sql('vectors')}, {_LABELLED} {_pair_sql()}")
def sid_category_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(codes.category_pairs(_labelled(spark, folder), "lab"))


@query(f"{with_sql('vectors')}, {_LABELLED}, c AS (SELECT lab, c1, count(*)::DOUBLE AS n FROM codes GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), x AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / any_value(t) AS p FROM c, t GROUP BY lab)), y AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(n) / any_value(t) AS p FROM c, t GROUP BY c1)), j AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t) SELECT round((x.h + y.h - j.h) / ((x.h + y.h) / 2), 6) AS nmi FROM x, y, j")
def sid_category_nmi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(codes.mutual_information(_labelled(spark, folder), "lab", "c1"))


@query(f"{_WITH} SELECT DISTINCT CAST(0 AS BIGINT) AS level, '' AS prefix, c1 AS token FROM codes UNION ALL SELECT DISTINCT 1, c1::VARCHAR, c2 FROM codes UNION ALL SELECT DISTINCT 2, c1 || ',' || c2, c3 FROM codes")
def trie_edges(spark: SparkSession, folder: str) -> DataFrame:
    return texts(codes.trie_edges(_codes(spark, folder).drop("label")), "prefix")


# A catalogue of one item per code; moves from item i to the catalogue's item (7 i + 3) mod n, and so on.
_UNIQUE = f"{_CODES}, one AS (SELECT min(item_id) AS item_id, c1, c2, c3 FROM codes GROUP BY c1, c2, c3), num AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM one), moves AS (SELECT a.item_id AS src, b.item_id AS dst FROM num a JOIN num b ON b.i IN ((7 * a.i + 3) % a.n, (3 * a.i + 1) % a.n, a.i // 2))"


def _catalogue(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    one = _codes(spark, folder).groupBy("c1", "c2", "c3").agg(F.min("item_id").alias("item_id")).select("item_id", "c1", "c2", "c3")
    num = number_rows(one, "i", "item_id").withColumn("n", F.lit(one.count()))
    to = num.select(F.col("item_id").alias("src"), F.explode(F.array_distinct(F.array((F.col("i") * 7 + 3) % F.col("n"), (F.col("i") * 3 + 1) % F.col("n"), F.expr("cast(i div 2 as bigint)")))).alias("j"))
    moves = to.join(num.select(F.col("item_id").alias("dst"), F.col("i").alias("j")), "j").select("src", "dst")
    return one, moves


_SCORER = """trie AS (SELECT DISTINCT '' AS prefix, c1 AS token FROM one UNION SELECT DISTINCT c1::VARCHAR, c2 FROM one UNION SELECT DISTINCT c1 || ',' || c2, c3 FROM one), st AS (SELECT DISTINCT c1 AS state FROM one),
 follow AS (SELECT s.c1 AS state, d.c1, d.c2, d.c3 FROM moves JOIN one s ON s.item_id = src JOIN one d ON d.item_id = dst), cnt AS (SELECT state, '' AS prefix, c1 AS token, count(*) AS n FROM follow GROUP BY ALL UNION ALL SELECT state, c1::VARCHAR, c2, count(*) FROM follow GROUP BY ALL UNION ALL SELECT state, c1 || ',' || c2, c3, count(*) FROM follow GROUP BY ALL),
 sc AS (SELECT state, prefix, token, ln((coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY state, prefix)) AS logp FROM trie CROSS JOIN st LEFT JOIN cnt USING (state, prefix, token))"""


@query(f"{with_sql('vectors')}, {_UNIQUE}, {_SCORER} SELECT state, prefix, token, round(logp, 6) AS logp FROM sc")
def token_model(spark: SparkSession, folder: str) -> DataFrame:
    one, moves = _catalogue(spark, folder)
    return rounded(texts(codes.token_model(one, moves), "prefix"))


_FULL = "full_scores AS (SELECT st.state AS user_id, item_id, [c1, c2, c3] AS code, a.logp + b.logp + c.logp AS score FROM one CROSS JOIN st JOIN sc a ON a.state = st.state AND a.prefix = '' AND a.token = c1 JOIN sc b ON b.state = st.state AND b.prefix = c1::VARCHAR AND b.token = c2 JOIN sc c ON c.state = st.state AND c.prefix = c1 || ',' || c2 AND c.token = c3)"


@query(f"{with_sql('vectors')}, {_UNIQUE}, {_SCORER}, {_FULL} SELECT user_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, code) AS rank FROM full_scores) WHERE rank <= 5")
def beam_topk(spark: SparkSession, folder: str) -> DataFrame:
    """A beam as wide as the catalogue is exact, which is what the SQL computes."""
    one, moves = _catalogue(spark, folder)
    users = one.select(F.col("c1").alias("user_id"), F.col("c1").alias("state")).distinct()
    return rounded(codes.beam_search(users, one, codes.token_model(one, moves), beam=400, topk=5))


@query()
def beam_narrow(spark: SparkSession, folder: str) -> DataFrame:
    """All items, with unique codes, for each user of the feedback log; the moves are those of the users' sequences."""
    items = codes.collision_tail(_codes(spark, folder).drop("label")).withColumnRenamed("tail", "c4")
    logs = sequences.feedback_sequences(feedback(spark, folder).join(items.select("item_id"), "item_id", "left_semi"))
    steps = F.arrays_zip(F.slice("items", F.lit(1), F.size("items") - 1).alias("src"), F.slice("items", F.lit(2), F.size("items") - 1).alias("dst"))
    moves = logs.select(F.explode(steps).alias("m")).select("m.src", "m.dst")
    users = logs.select("user_id", F.element_at("items", -1).alias("item_id")).join(items.select("item_id", F.col("c1").alias("state")), "item_id").select("user_id", "state")
    return codes.beam_search(users, items, codes.token_model(items, moves), beam=20, topk=10)


_BOOK1, _BOOK2 = "(SELECT vec_id AS token, embedding AS c FROM embeddings WHERE vec_id < 8)", "(SELECT vec_id - 8 AS token, [x * 0.25 for x in embedding] AS c FROM embeddings WHERE vec_id BETWEEN 8 AND 11)"
_DIST = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v::DOUBLE[], c::DOUBLE[])])"


@query(f"{with_sql('vectors')}, l1 AS (SELECT item_id, token, v, c, row_number() OVER (PARTITION BY item_id ORDER BY round(d, 9), token) AS r FROM (SELECT item_id, token, v, c, {_DIST} AS d FROM (SELECT item_id, vector::DOUBLE[] AS v, token, c::DOUBLE[] AS c FROM vectors, {_BOOK1}))), f1 AS (SELECT item_id, token AS c1, [z[1] - z[2] for z in list_zip(v, c)] AS v FROM l1 WHERE r = 1), l2 AS (SELECT item_id, c1, token, row_number() OVER (PARTITION BY item_id ORDER BY round({_DIST}, 9), token) AS r FROM f1, {_BOOK2}) SELECT item_id, c1, token AS c2 FROM l2 WHERE r = 1")
def assign_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    first = {r.item_id: np.array(r.vector, dtype=np.float64) for r in rows.filter("item_id < 12").collect()}
    return codes.assign(rows, [np.stack([first[i] for i in range(8)]), np.stack([first[i] * 0.25 for i in range(8, 12)])])


@query()
def rq_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return codes.rq_kmeans(vectors(spark, folder), [8, 8, 16], ratio=1.5)


@query("SELECT i AS level, (SELECT count(*) FROM embeddings) AS items, CAST(ceil((SELECT count(*) FROM embeddings) / size * 1.5) AS BIGINT) AS capacity, true AS within_capacity, true AS told_apart FROM (VALUES (1, 8.0), (2, 8.0), (3, 16.0)) t(i, size)")
def rq_kmeans_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per level, that no token exceeds its capacity, and that items of one prefix differ in the last token where there are enough of them."""
    found, rows = codes.fit_quantiser(vectors(spark, folder), [8, 8, 16], ratio=1.5, dimensions=16), None
    groups = found.codes.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c3").alias("d"))
    apart = groups.agg(F.coalesce(F.bool_and((F.col("n") > 16) | (F.col("n") == F.col("d"))), F.lit(True)).alias("told_apart"))
    for m in found.measures:
        one = found.codes.groupBy(f"c{m['level']}").agg(F.count(F.lit(1)).alias("n")).agg(F.lit(m["level"]).alias("level"), F.sum("n").alias("items"), F.lit(m["capacity"]).cast("long").alias("capacity"), (F.max("n") <= m["capacity"]).alias("within_capacity"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(apart)


@query()
def tree_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.tree_codes(vectors(spark, folder), [4, 4])


@query()
def random_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.collision_tail(codes.random_codes(vectors(spark, folder), [8, 8]))


@query(f"{with_sql('vectors')}, p AS (SELECT a.item_id AS query_id, b.item_id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS s FROM vectors a, vectors b WHERE a.item_id % 20 = 0 AND a.item_id <> b.item_id) SELECT query_id, item_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM p) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).select("item_id", "vector")
    return rounded(vec.cosine_topk(rows.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), rows, 10, same=True))


_SAMPLES = "smp AS (SELECT DISTINCT sample_id AS session, [x % 400 for x in history_aids] AS h FROM validation_samples)"


def _vector_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/validation_samples.parquet").distinct()
    return rows.select(F.col("sample_id").alias("session"), F.transform("history_aids", lambda x: x % 400).alias("history_aids"), (F.col("target_aid") % 400).alias("target_aid"))


_SESSION = f"{_SAMPLES}, rec AS (SELECT session, unnest(list_reverse(h)[1:5]) AS item_id, unnest(range(0, len(list_reverse(h)[1:5]))) AS k FROM smp), dim AS (SELECT session, d, sum(vector[d]::DOUBLE / sqrt(k + 1.0)) AS x FROM rec JOIN vectors USING (item_id), range(1, 65) t(d) GROUP BY ALL), uv AS (SELECT session, list(x ORDER BY d) AS u FROM dim GROUP BY session)"


@query(f"{with_sql('vectors')}, {_SESSION}, p AS (SELECT session AS query_id, item_id, round(list_cosine_similarity(u, vector::DOUBLE[]), 9) AS s FROM uv, vectors) SELECT query_id, item_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM p) WHERE rank <= 5")
def session_vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder).select("item_id", "vector")
    users = vec.session_vectors(_vector_samples(spark, folder), rows)
    return rounded(vec.cosine_topk(users.withColumnRenamed("session", "query_id"), rows.withColumn("vector", F.col("vector").cast("array<double>")), 5))


@query()
def ann_cells(spark: SparkSession, folder: str) -> DataFrame:
    return vec.cell_topk(item_vectors(spark, folder), 10)


@query("""WITH newest AS (SELECT item_ids AS i, max(struct_pack(e := epoch, v := vectors)).v AS v FROM item2vec_embeddings WHERE item_ids IS NOT NULL GROUP BY item_ids)
 SELECT count(*) AS asked, true AS reached, true AS selective FROM newest WHERE len(v) = 64 AND len([x for x in v if isfinite(x)]) = 64 AND len([x for x in v if x <> 0]) > 0 AND i % 20 = 0""")
def ann_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the search by cells finds nine tenths of the true ten nearest of the items divisible by 20, looking at less than half of all pairs."""
    rows = settle(item_vectors(spark, folder))
    exact = vec.cosine_topk(rows.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), rows, 10, same=True)
    found = vec.cell_topk(rows, 10).select("query_id", "item_id", F.lit(1).alias("held"))
    one = exact.join(found, ["query_id", "item_id"], "left").agg(F.count_distinct("query_id").alias("asked"), (F.sum("held") >= 0.9 * F.count(F.lit(1))).alias("reached"))
    asked = vec.asked_cells(rows)
    own = asked.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("o"))
    asks = asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("a"))
    pairs = own.join(asks, "cell").agg(F.sum(F.col("o") * F.col("a"))).first()[0] or 0
    return one.withColumn("selective", F.lit(pairs < 0.5 * rows.count() ** 2))


@query()
def sampled_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with the vectors of their own aids."""
    samples = read_table(spark, folder, "validation_samples").distinct().select(F.col("sample_id").alias("session"), "history_aids", "target_aid")
    return vec.sampled_auc(samples, settle(item_vectors(spark, folder)), 20)


@query(f"{with_sql('feedback')}, r AS (SELECT user_id, item_id, ln(1 + greatest(0, least(3.0, value / 20.0))) * sqrt(greatest(0.2, least(5.0, value / 5.0))) AS score FROM feedback JOIN (SELECT event_id, value FROM events) ON event_id = event_order), m AS (SELECT item_id AS item, user_id AS user_, avg(score) AS m FROM r GROUP BY ALL) SELECT item, user_ AS user, round(m - u, 6) AS value FROM (SELECT *, avg(m) OVER (PARTITION BY user_) AS u FROM m) WHERE abs(m - u) > 1e-12")
def centred_responses(spark: SparkSession, folder: str) -> DataFrame:
    values = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_id").alias("event_order"), (F.col("value") / 20.0).alias("ratio"), F.col("value").alias("seconds"))
    rows = feedback(spark, folder).join(values, "event_order").withColumn("score", embeddings.response_score("ratio", "seconds"))
    return rounded(embeddings.centred_responses(rows))


@query(f"{with_sql('feedback')}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_order DESC) AS back FROM feedback) SELECT user_id, item_id, timestamp FROM b WHERE back > 2")
def drop_last_two(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.before_last(feedback(spark, folder)).select("user_id", "item_id", "timestamp")


@query(f"{with_sql('feedback')}, o AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_order) AS p FROM feedback), s AS (SELECT a.item_id AS src, b.item_id AS dst, sum(1.0::DOUBLE / (b.p - a.p)) AS v FROM o a JOIN o b ON a.user_id = b.user_id AND b.p BETWEEN a.p + 1 AND a.p + 3 GROUP BY ALL), t AS (SELECT *, sum(v) OVER (PARTITION BY src) AS r, sum(v) OVER (PARTITION BY dst) AS c, sum(v) OVER () AS t FROM s) SELECT src, dst, round(ln(v * t / (r * c)), 6) AS value FROM t WHERE ln(v * t / (r * c)) > 0")
def ppmi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(embeddings.ppmi(feedback(spark, folder)))


@query("""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM documents), g AS (SELECT doc_id, unnest(list_concat([substring(t, i, 1) for i in range(1, length(t) + 1)], [substring(t, i, 2) for i in range(1, length(t))])) AS term FROM d),
 c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM d), w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM c JOIN f USING (term), n)
 SELECT doc_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS greatest, round(sum(w) / sqrt(sum(w * w)), 6) AS total FROM w GROUP BY doc_id""")
def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    weights = embeddings.char_tfidf(rows, "doc_id", "text")
    return rounded(weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.max("weight").alias("greatest"), F.sum("weight").alias("total")))


@query()
def svd_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Items by the sessions that hold them: every session is a column."""
    return embeddings.svd(indexes.session_matrix(behaviour(spark, folder)), "aid", "session", "value", 8)


@query()
def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.pca_variance(vectors(spark, folder), 16)


_FUSE_A = "a AS (SELECT item_id, d, vector[d]::DOUBLE AS x FROM vectors, range(1, 9) t(d)), b AS (SELECT item_id, d, vector[d]::DOUBLE AS x FROM vectors, range(9, 13) t(d))"


@query(f"{with_sql('vectors')}, {_FUSE_A}, ca AS (SELECT item_id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM a), cb AS (SELECT item_id, d, x - avg(x) OVER (PARTITION BY d) AS x FROM b), u AS (SELECT item_id, d, sqrt(0.75) * x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM ca UNION ALL SELECT item_id, d, sqrt(0.25) * x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) FROM cb) SELECT item_id, round(sum(x * d), 6) AS check_sum, round(sum(x * x), 6) AS length FROM u GROUP BY item_id")
def fused_embedding(spark: SparkSession, folder: str) -> DataFrame:
    rows = vectors(spark, folder)
    parts = {"a": rows.select("item_id", F.slice("vector", 1, 8).alias("vector")), "b": rows.select("item_id", F.slice("vector", 9, 4).alias("vector"))}
    fused = embeddings.fuse(parts, {"a": 3.0, "b": 1.0}, {"a": 8, "b": 4})
    total = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rounded(fused.select("item_id", total.alias("check_sum"), vec.dot("vector", "vector").alias("length")))


@query()
def item2vec_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    items = embeddings.item2vec(indexes.skipgram_pairs(behaviour(spark, folder)), dims=16, epochs=2)
    return vec.cosine_topk(items.withColumnRenamed("item_id", "query_id"), items, 10, same=True)


@query("""WITH newest AS (SELECT item_ids AS i, max(struct_pack(e := epoch, v := vectors)).v AS v FROM item2vec_embeddings WHERE item_ids IS NOT NULL GROUP BY item_ids),
 valid AS (SELECT i FROM newest WHERE len(v) = 64 AND len([x for x in v if isfinite(x)]) = 64 AND len([x for x in v if x <> 0]) > 0), known AS (SELECT aid FROM events_all WHERE aid IS NOT NULL UNION SELECT i FROM valid)
 SELECT aid AS item_id, i IS NOT NULL AS warm, 64 AS width FROM known LEFT JOIN valid ON i = aid""")
def warm_start(spark: SparkSession, folder: str) -> DataFrame:
    """All items of the session log and all that have a vector."""
    known = item_vectors(spark, folder)
    seen = read_table(spark, folder, "events_all").select(F.col("aid").alias("item_id")).filter("item_id IS NOT NULL")
    return embeddings.warm_start(seen.unionByName(known.select("item_id")).distinct(), known, 64).select("item_id", "warm", F.size("vector").alias("width"))


@query("SELECT doc_id, CASE WHEN s = '' AND l = '' THEN 'unknown item' WHEN l = '' THEN 'source: ' || s WHEN s = '' THEN 'lang: ' || l ELSE 'source: ' || s || ' ; lang: ' || l END AS text, l AS lang FROM (SELECT doc_id, trim(coalesce(source, '')) AS s, trim(coalesce(lang, '')) AS l FROM documents)")
def item_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", texts_of.item_text(["source", "lang"]).alias("text"))
    return rows.withColumn("lang", texts_of.text_field("text", "lang"))


@query("SELECT event_id, CASE WHEN value <= 10 THEN 'low' WHEN value <= 30 THEN 'middle' ELSE 'high' END AS class, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    return texts_of.to_number(rows, "k").select("event_id", texts_of.bucket(F.col("value"), [10, 30], ["low", "middle", "high"]).alias("class"), "k")


@query("WITH s AS (SELECT DISTINCT sample_id // 32 AS batch, sample_id AS row, target_aid AS aid, target_ts AS ts FROM validation_samples) SELECT a.batch, a.row, b.row AS column, (a.row = b.row OR (b.ts <= a.ts AND b.aid <> a.aid)) AS allowed FROM s a JOIN s b ON a.batch = b.batch")
def causal_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/validation_samples.parquet").select(F.expr("sample_id div 32").alias("batch"), F.col("sample_id").alias("row"), F.col("target_aid").alias("aid"), F.col("target_ts").alias("ts")).distinct()
    return models.causal_mask(rows)


_FEATURES = ["rrf_score", "source_count", "best_source_rank"]


def _training(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.compact(candidates(spark, folder), labels(spark, folder), ROUTE_NAMES, 0, 100)
    return features.task_targets(features.standardise(rows.withColumn("rrf_score", F.col("rrf_score").cast("double")).select("session", "aid", "label", "target_type", *(F.col(c).cast("double").alias(c) for c in _FEATURES)), _FEATURES))


@query()
def lr_heads(spark: SparkSession, folder: str) -> DataFrame:
    return models.logistic_heads(_training(spark, folder), _FEATURES).select("task", "intercept", F.size("coefficients").alias("width"))


def _trained(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    rows = _training(spark, folder)
    net, _ = models.train_ranker(rows, _FEATURES, kind, epochs=2)
    return models.score_ranker(rows, net, _FEATURES).select("session", "aid", *(f"p_{t}" for t in models.TASKS))


@query()
def shared_bottom(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder, "shared_bottom")


@query()
def mmoe(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder, "mmoe")


@query()
def ple(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder, "ple")


@query()
def synthetic_log(spark: SparkSession, folder: str) -> DataFrame:
    return files.synthetic_log(spark)


@query()
def generative_eval(spark: SparkSession, folder: str) -> DataFrame:
    """The count-based token model end to end: sequences, targets, beam, list metrics."""
    events = feedback(spark, folder).filter("is_positive = 1")
    split = sequences.leave_two_out(sequences.feedback_sequences(events), 3)
    cat = codes.collision_tail(codes.random_codes(events.select("item_id").distinct(), [6, 6])).withColumnRenamed("tail", "c3")
    moves = split.select(F.explode(F.arrays_zip(F.slice("train", F.lit(1), F.size("train") - 1).alias("src"), F.slice("train", F.lit(2), F.size("train") - 1).alias("dst"))).alias("m")).select("m.src", "m.dst")
    last = split.select("user_id", F.element_at("train", -1).alias("item_id"), F.element_at("valid", -1).alias("target")).join(cat.select("item_id", F.col("c1").alias("state")), "item_id")
    found = codes.beam_search(last.select("user_id", "state"), cat, codes.token_model(cat, moves), beam=40, topk=20)
    ranks = last.join(found.select("user_id", F.col("item_id").alias("target"), "rank"), ["user_id", "target"], "left").select("rank")
    return metrics.list_metrics(ranks, [5, 20])


@query()
def capacity_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """List metrics of a shared-bottom ranker of two sizes and with one feature masked to its mean."""
    rows, out = _training(spark, folder), None
    for hidden in (4, 16):
        net, _ = models.train_ranker(rows, _FEATURES, epochs=1, hidden=hidden)
        for name, data in (("full", rows), ("masked_rrf", rows.withColumn("rrf_score", F.lit(0.0)))):
            p = models.score_ranker(data, net, _FEATURES).select(F.col("session").alias("sample_id"), "aid", "target_type", "label", fusion.probability_fusion("p_label_clicks", "p_label_carts", "p_label_orders").alias("final_score"))
            one = metrics.toplist(p, 20).select(F.lit(hidden).alias("hidden"), F.lit(name).alias("features"), "hit_rate", "mrr", "ndcg")
            out = one if out is None else out.unionByName(one)
    return out


QUERIES, ORACLES = query.queries, query.oracles
