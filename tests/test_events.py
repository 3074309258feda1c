import pytest
from pyspark.sql import functions as F

from tideline.checks import assert_subset, assert_unique, require_columns
from tideline.operators import asof, clean, sequences, sessions


@pytest.fixture(scope="module")
def boundary(spark):
    kinds = ["clicks", "clicks", "carts", "orders"]
    return spark.createDataFrame([(s, s * 10 + p, s * 100 + p, kinds[p], p, s) for s in range(10) for p in range(4)], "session long, aid long, ts long, type string, event_order long, visitorid long")


def test_checks(boundary):
    assert require_columns(boundary, "aid") is boundary
    with pytest.raises(ValueError):
        require_columns(boundary, "nothing")
    assert_unique(boundary, ["session", "ts"])
    with pytest.raises(ValueError):
        assert_unique(boundary, ["session"])
    with pytest.raises(ValueError):
        assert_subset(boundary, boundary.filter("aid > 5"), ["aid"])


def test_labels_and_splits(boundary):
    history, labels = sessions.leave_last_out(boundary)
    assert labels.count() == 10 and history.count() == 30
    split = sessions.time_splits(labels, 0.7, 0.1)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 7, "validation": 1, "test": 2}
    ends = {r["split"]: (r.a, r.b) for r in split.groupBy("split").agg(F.min("target_ts").alias("a"), F.max("target_ts").alias("b")).collect()}
    assert ends["train"][1] < ends["validation"][0] <= ends["validation"][1] < ends["test"][0]
    with pytest.raises(ValueError):
        sessions.time_splits(labels.limit(2))


def test_ambiguous_sessions_go(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 2), (1, 1, 3), (1, 2, 4)], "session long, aid long, ts long")
    assert {r.session for r in clean.drop_ambiguous(df).collect()} == {1}


def test_sessions_before_the_catalogue_is_cut(spark):
    minute = 60_000
    raw = spark.createDataFrame([(0, t * minute, a, t) for t, a in ((0, 1), (20, 999), (40, 2))] + [(1, 0, 1, 5), (1, minute, 2, 6)], "visitorid long, ts long, aid long, event_order long")
    rows = sessions.sessionise(raw, 30 * minute)
    kept = clean.restrict_catalogue(rows, 2)
    assert rows.select("session").distinct().count() == 2 and kept.select("aid").distinct().count() == 2
    assert sessions.sessionise(raw.withColumn("ts", F.col("ts") * 2), 30 * minute).select("session").distinct().count() == 4
    assert clean.restrict_catalogue(rows, None).count() == 5


def test_reasons(spark):
    rows = [(1, 1, t, "clicks", t) for t in (1, 2, 3)] + [(2, 1, 1, "clicks", 1)] + [(3, 1, t, "clicks", i) for i, t in enumerate((1, 2, 2))] + [(4, 1, 5, "clicks", 1), (4, 2, 5, "clicks", 2)]
    df = spark.createDataFrame(rows, "session long, aid long, ts long, type string, event_order long").withColumn("visitorid", F.lit(1))
    assert {r.session: r.ineligible_reason for r in sessions.session_dimension(df).collect()} == {1: "", 2: "too_short", 3: "ambiguous_last_timestamp", 4: "too_short+ambiguous_last_timestamp"}


def test_changes(spark):
    df = spark.createDataFrame([(1, 10, 2), (1, 10, 2), (2, 10, 2), (3, 10, 3), (3, 10, 4), (None, 10, 1)], "timestamp long, itemid long, categoryid long")
    assert [(r.timestamp, r.categoryid) for r in clean.clean_changes(df).collect()] == [(1, 2)]


def test_copies_keep_the_first(spark):
    df = spark.createDataFrame([(1, None, 5, "b"), (1, None, 3, "a"), (2, 1.0, 1, "c")], "k long, x double, o long, v string")
    assert {(r.k, r.o, r.v) for r in clean.drop_copies(df, ["k", "x"], "o").collect()} == {(1, 3, "a"), (2, 1, "c")}


def test_category_paths(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "categoryid long, parentid long")
    seen = spark.createDataFrame([(3,), (99,), (None,)], "categoryid long")
    got = {r.categoryid: r for r in asof.category_paths(spark, tree, seen).collect()}
    assert got[3].category_path == [1, 2, 3] and got[3].category_depth == 2 and got[3].root_categoryid == 1
    assert got[99].category_path == [99] and not got[99].in_tree
    with pytest.raises(ValueError):
        asof.category_paths(spark, spark.createDataFrame([(1, 2), (2, 1)], "categoryid long, parentid long"), seen)


def test_asof(spark):
    q = spark.createDataFrame([(1, 1, 5), (1, 1, 15), (2, 2, 5), (3, None, 5)], "session long, aid long, ts long").selectExpr("*", "7 AS timestamp")
    cat = spark.createDataFrame([(10, 1, 1), (10**12, 1, 2)], "timestamp long, itemid long, categoryid long")
    avail = spark.createDataFrame([(12, 1, 1)], "timestamp long, itemid long, available long")
    paths = spark.createDataFrame([(1, 1, 0, [1], True)], "categoryid long, root_categoryid long, category_depth long, category_path array<long>, in_tree boolean")
    got = {(r.session, r.ts): (r.categoryid, r.available, r.category_state_ts, r.category_path) for r in asof.asof_enrich(q, cat, avail, paths).collect()}
    assert got == {(1, 5): (-1, -1, -1, [-1]), (1, 15): (1, 1, 10, [1]), (2, 5): (-1, -1, -1, [-1]), (3, 5): (-1, -1, -1, [-1])}
    exact = asof.backward_asof(q.filter("ts = 15").withColumn("ts", F.lit(10).cast("long")), cat, "aid", "ts", "itemid", "timestamp", ["categoryid"], bucket_ms=3)
    assert exact.first().categoryid == 1


def test_prefix_samples(spark):
    df = spark.createDataFrame([(1, 10 + i, i, "clicks", i) for i in range(1, 6)], "session long, aid long, ts long, type string, event_order long")
    got = sequences.training_samples(df, 2, 2, 2).orderBy("target_ts").collect()
    assert [r.target_aid for r in got] == [13, 15] and got[-1].history_aids == [13, 14] and got[-1].history_length_full == 4
    tied = spark.createDataFrame([(1, a, t, "clicks", i) for i, (a, t) in enumerate(((10, 1), (11, 2), (12, 3), (13, 3), (14, 4)))], "session long, aid long, ts long, type string, event_order long")
    assert [r.target_aid for r in sequences.training_samples(tied, 2, 5, 9).collect()] == [14]


def test_feedback_protocol(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5], [1, 0, 0, 1, 0, 1])], "user_id long, items array<long>, positive array<int>")
    r = sequences.positive_leave_two_out(df, 1).first()
    assert [[x.item for x in part] for part in (r.train, r.valid, r.test)] == [[0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3, 4, 5]]
    last = sequences.positive_samples(spark.createDataFrame([(1, [0, 1, 2, 3], [1, 0, 0, 1])], df.schema), 4).collect()[-1]
    assert last.feedback == [0, 2, 1, 1] and last.target == 3
    w = sequences.masked_windows(spark.createDataFrame([(1, [0, 1, 2, 3], [1, 0, 1, 0])], df.schema), 4).first()
    assert w.feedback == [0, 2, 1, 2] and w.labels == [-100, -100, 2, -100]
    two = sequences.leave_two_out(spark.createDataFrame([(1, [0, 1, 2, 3, 4], [1] * 5)], df.schema)).first()
    assert (two.train, two.valid, two.test) == ([0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3, 4])


def test_k_core(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (2, 1)], "user_id long, item_id long")
    core = clean.k_core(df, "user_id", "item_id", 2, 2).collect()
    assert {r.user_id for r in core} == {0, 1} and {r.item_id for r in core} == {0, 1}
    assert clean.k_core(df.limit(0), "user_id", "item_id", 2, 2).count() == 0


def test_warmup(spark):
    df = spark.createDataFrame([(s, s, s * 100 + p, "clicks") for s in range(40) for p in (0, 50)], "session long, aid long, ts long, type string")
    for days, n in ((0, 0), (3, 3), (7, 7)):
        parts = clean.warmup_split(df, 2000, days, 100)
        assert parts.filter("part = 'warmup'").select("session").distinct().count() == n
        assert parts.filter("part = 'formal'").select("session").distinct().count() == 20


def test_empty_inputs(spark, boundary):
    none = boundary.limit(0)
    for df in (clean.drop_ambiguous(none), clean.min_session_length(none, 2), sessions.sessionise(none.drop("session"), 5), sessions.session_dimension(none), sequences.training_samples(none), asof.catalogue_snapshots(none)):
        assert df.count() == 0
