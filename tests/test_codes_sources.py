import itertools
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import codes, embeddings
from tideline.sources import files


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(60, 10)))], "item_id long, vector array<double>")


def test_tail(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0)], "item_id long, c1 long, c2 long")
    got = {r.item_id: r.tail for r in codes.collision_tail(df).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 2} and codes.collision_rate(df).first().collision_rate == 0.5


def test_categories(spark):
    df = spark.createDataFrame([(i, int(i > 2), i % 3, 0, "AAABBB"[i]) for i in range(6)] + [(9, 0, 0, 0, " "), (10, 0, 0, 0, None)], "item_id long, c1 long, c2 long, c3 long, label string")
    first = codes.category_pairs(df, "label").orderBy("level").first()
    assert (first.prefix_same, first.prefix_other) == (1.0, 0.0)


def test_rq_kmeans(points):
    a = {r.item_id: (r.c1, r.c2) for r in codes.rq_kmeans(points, [4, 30], ratio=1.2).collect()}
    b = {r.item_id: (r.c1, r.c2) for r in codes.rq_kmeans(points, [4, 30], ratio=1.2).collect()}
    assert a == b and len(set(a.values())) == 60
    first = np.bincount([c for c, _ in a.values()])
    assert first.max() <= math.ceil(60 / 4 * 1.2)


def test_repair_keeps_the_capacity():
    rng = np.random.default_rng(4)
    prefix, distance = np.repeat(np.arange(6), 5)[:, None], rng.random((30, 8))
    distance[:, 0] -= 2  # all want the first token
    token, capacity = codes.balanced_tokens(distance, 1.25)
    got = codes.resolve_last_level(prefix, token, distance, capacity)
    assert capacity == 5 and np.bincount(got, minlength=8).max() <= capacity
    assert all(len(set(got[prefix[:, 0] == p])) == 5 for p in range(6))
    free = codes.resolve_last_level(prefix, token, distance)  # without a capacity only prefixes count
    assert all(len(set(free[prefix[:, 0] == p])) == 5 for p in range(6))


def test_preparation_whitens(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>").selectExpr("*", "1 AS c1")
    state = codes.prepare(df, 3, unit=False)
    got = np.array([r.vector for r in codes.prepared(df, state).orderBy("item_id").collect()])
    assert got.shape == (200, 3) and np.allclose(np.cov(got.T), np.eye(3), atol=1e-6) and np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(state["variance"], np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3])
    units = np.array([r.vector for r in codes.prepared(df, codes.prepare(df, 3)).collect()])
    assert np.allclose((units**2).sum(axis=1), 1)
    with pytest.raises(ValueError):
        codes.fit_quantiser(df, [1, 4])
    with pytest.raises(ValueError):
        codes.fit_quantiser(df, [4, 4], max_items=100)


def test_stored_quantiser_encodes_alike(spark, points, tmp_path):
    found = codes.fit_quantiser(points, [4, 30], dimensions=6)
    files.save_quantiser(spark, found, str(tmp_path / "q"))
    again = files.load_quantiser(spark, str(tmp_path / "q"))
    assert sorted(map(tuple, again.codes.collect())) == sorted(map(tuple, found.codes.collect()))
    assert sorted(map(tuple, codes.encode(points, again).collect())) == sorted(map(tuple, codes.encode(points, found).collect()))
    assert [m["level"] for m in again.measures] == [1, 2] and all(m["largest_bucket"] <= m["capacity"] for m in again.measures)
    codes.encode(points, found).write.mode("overwrite").parquet(str(tmp_path / "q/codes.parquet"))
    with pytest.raises(ValueError):
        files.load_quantiser(spark, str(tmp_path / "q"))


def test_residuals_fall(points):
    books = codes.fit_codebooks(points, [4, 4, 4])
    left = np.array([r.vector for r in points.orderBy("item_id").collect()])
    got = [(r.c1, r.c2, r.c3) for r in codes.assign(points, books).orderBy("item_id").collect()]
    errors = [(left**2).sum()]
    for level, book in enumerate(books):
        left = left - book[[c[level] for c in got]]
        errors.append((left**2).sum())
    assert all(a > b for a, b in itertools.pairwise(errors))


def test_matching_is_least():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.random((n, m)).round(2)
        got = codes.match(cost)
        assert len(set(got)) == n
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert cost[np.arange(n), got].sum() == pytest.approx(best)
    with pytest.raises(ValueError):
        codes.match(np.zeros((2, 1)))


def test_balance():
    rng = np.random.default_rng(3)
    token, capacity = codes.balanced_tokens(rng.random((100, 7)) + np.arange(7) * 0.2, 1.0)
    assert capacity == 15 and np.bincount(token).max() <= capacity and (token >= 0).all()


def test_full_beam_is_exact(spark):
    df = spark.createDataFrame([(i, i // 2, i % 2) for i in range(4)], "item_id long, c1 long, c2 long")
    moves = spark.createDataFrame([(0, 1), (0, 3), (1, 2)], "src long, dst long")
    scorer = codes.token_model(df, moves)
    users = spark.createDataFrame([(7, 0)], "user_id long, state long")
    got = codes.beam_search(users, df, scorer, 4, 4).orderBy("rank").collect()
    logp = {(tuple(r.prefix), r.token): r.logp for r in scorer.filter("state = 0").collect()}
    want = sorted(((logp[(), i // 2] + logp[(i // 2,), i % 2], -i) for i in range(4)), reverse=True)
    assert [r.item_id for r in got] == [-i for _, i in want]
    seen = spark.createDataFrame([(7, got[0].item_id)], "user_id long, item_id long")
    assert codes.beam_search(users, df, scorer, 4, 3, seen).orderBy("rank").first().item_id == got[1].item_id


def test_tree_and_random_codes(spark, points):
    assert codes.tree_codes(points, [3, 4]).select("item_id").distinct().count() == 60
    assert codes.random_codes(points, [3, 4]).filter("c1 < 0 OR c1 > 2 OR c2 < 0 OR c2 > 3").count() == 0


def test_ppmi_counts_moves(spark):
    df = spark.createDataFrame([(u, i, t, t) for u, s in enumerate(([0, 1, 2, 3], [0, 1, 3, 2])) for t, i in enumerate(s)], "user_id long, item_id long, timestamp long, event_order long")
    got = embeddings.ppmi(df, 2).collect()
    assert all(r.value > 0 for r in got) and {(0, 1)} <= {(r.src, r.dst) for r in got}


def test_fusion_is_unit(spark):
    rng = np.random.default_rng(4)
    a, b = (spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(8, w)))], "item_id long, vector array<double>") for w in (3, 2))
    got = np.array([r.vector for r in embeddings.fuse({"a": a, "b": b}, {"a": 3, "b": 1}, {"a": 3, "b": 2}).collect()])
    assert np.allclose((got**2).sum(axis=1), 1) and np.allclose((got[:, :3] ** 2).sum(axis=1), 0.75)
    with pytest.raises(ValueError):
        embeddings.fuse({"a": a}, {"b": 1.0}, {"a": 3})


def test_item2vec_and_svd(spark):
    pairs = spark.createDataFrame([(a, b, 1.0) for a in range(6) for b in range(6) if a != b and a % 2 == b % 2], "center long, context long, weight double")
    got = embeddings.item2vec(pairs, dims=4, epochs=2)
    assert got.count() == 6 and embeddings.item2vec(pairs.limit(0)).count() == 0
    t = spark.createDataFrame([(r, c, 1.0) for r in range(6) for c in range(4) if (r + c) % 2], "r long, c long, v double")
    x = {r.item_id: np.array(r.vector) for r in embeddings.svd(t, "r", "c", "v", 2).collect()}
    assert abs(x[0] @ x[2]) == pytest.approx(1, abs=1e-6)


def test_text(spark):
    df = spark.createDataFrame([("[27, 9]", "x", "UNKNOWN"), (None, None, " "), ("oops", "a; b", "y")], "tags string, name string, kind string")
    rows = df.select(text.parse_tags("tags").alias("t"), text.item_text(["name", "kind"]).alias("x")).collect()
    assert [r.t for r in rows] == [[27, 9], [], []] and [r.x for r in rows] == ["name: x", "unknown item", "name: a; b ; kind: y"]
    got = spark.createDataFrame([("name: x ; kind: y z",), (None,)], "x string").select(text.text_field("x", "kind").alias("k")).collect()
    assert [r.k for r in got] == ["y z", ""]
    assert [r.c for r in spark.createDataFrame([(1.0,), (3.0,), (9.0,), (None,)], "v double").select(text.bucket(F.col("v"), [1, 3], ["a", "b", "c"]).alias("c")).collect()] == ["a", "b", "c", None]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 10, "clicks"), (2, 6, 5, "1"), (2, 7, 6, "x")], "session long, aid long, ts long, type string")
    for kind in ("parquet", "csv", "json"):
        path = str(tmp_path / f"e.{kind}")
        writer = rows.write.option("header", True)
        getattr(writer, kind)(path)
        assert {tuple(r) for r in files.load_events(spark, path).collect()} == {(1, 5, 10, "clicks"), (2, 6, 5, "carts")}
        assert {r.session for r in files.load_events(spark, path, 1).collect()} == {2}
    with pytest.raises(ValueError):
        files.load_events(spark, "x.xml")
    (tmp_path / "p.csv").write_text("timestamp,itemid,property,value\n1,2,categoryid,33\n2,2,available,n1\n3,2,790,x\n")
    assert files.extract_states(spark, [str(tmp_path / "p.csv")]).count() == 1
    assert {r.property: r.rows for r in files.property_counts(spark, [str(tmp_path / "p.csv")]).collect()} == {"categoryid": 1, "available": 1, "790": 1}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/p.csv", "a\n1\n")
    assert files.open_dataset(str(tmp_path / "z.zip"), "p.csv", str(tmp_path / "out")).endswith("p.csv")
    with pytest.raises(ValueError):
        files.open_dataset(str(tmp_path), "none.csv", str(tmp_path))


def test_artefacts(spark, points, tmp_path):
    path = str(tmp_path / "v")
    files.save_vectors(points, path)
    assert files.load_vectors(spark, path).count() == 60
    files.write_json(spark, files.read_json(spark, f"{path}/manifest.json") | {"fingerprint": "x"}, f"{path}/manifest.json")
    with pytest.raises(ValueError):
        files.load_vectors(spark, path)
    calls = []
    build = lambda: calls.append(1) or {"items": points.select("item_id")}
    for _ in range(2):
        assert files.cached_indexes(spark, str(tmp_path / "c"), 5, build)["items"].count() == 60
    assert len(calls) == 1
    with pytest.raises(ValueError):
        files.validate_profile({"sessions": 3}, {"sessions": 4})
    with pytest.raises(ValueError):
        files.validate_profile({"sessions": 3}, {}, points.withColumn("session", F.lit(1)))
    assert len(files.sha256(f"{path}/manifest.json")) == 64


def test_synthetic_log_is_the_same_each_time(spark):
    assert files.content_fingerprint(files.synthetic_log(spark, 20)) == files.content_fingerprint(files.synthetic_log(spark, 20).repartition(3))
