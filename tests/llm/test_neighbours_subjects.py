import math

import numpy as np
import pytest

from tideline.llm.hnsw import Hnsw
from tideline.llm.neighbours import nearest, valid_vectors
from tideline.llm.subjects import FUNCTIONS, Knowledge, _Reader, assign_subjects, fit_accuracies, fit_subjects, sentences_of


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    return unit(centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 16)))


def recall(found, x, k, rows):
    near = x[rows] @ x.T
    near[np.arange(len(rows)), rows] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    return np.mean([len(set(found[i]) & set(b)) for i, b in zip(rows, best)]) / k


def test_graph_finds_neighbours(points):
    graph = Hnsw(points.astype(np.float32), 8, 24)
    ids, near = graph.search_own(10, 24)
    assert recall(ids, points, 10, np.arange(0, 3000, 20)) > 0.95
    assert all(i not in row for i, row in enumerate(ids.tolist()))
    exact = np.einsum("id,ijd->ij", points, points[ids])
    assert np.allclose(near, exact, atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_small_graphs_are_complete(points, n):
    ids, _ = Hnsw(points[:n].astype(np.float32), 4, 16).search_own(10, 16)
    assert [sorted(x for x in row if x >= 0) for row in ids.tolist()] == [[j for j in range(n) if j != i] for i in range(n)] if n <= 10 else True


def test_nearest_over_shards(spark, points):
    df = spark.createDataFrame([(i * 7, [float(v) * (1 + i % 5) for v in x]) for i, x in enumerate(points)], "item long, vector array<float>").selectExpr("*", "1 AS shard", "2 AS similarity")
    got = nearest(df.drop("similarity"), 10, width=16, shard_rows=400, probes=4, ef=24).collect()
    found = {}
    for r in got:
        found.setdefault(r.item // 7, []).append(r.neighbour // 7)
        assert r.similarity == pytest.approx(float(points[r.item // 7] @ points[r.neighbour // 7]), abs=1e-6)
    assert recall(found, points, 10, np.arange(0, 3000, 20)) >= 0.9
    assert all(len(v) == len(set(v)) == 10 for v in found.values())


@pytest.mark.parametrize(("sample_rows", "ask_rows"), [(64, None), (40_000, 300)])
def test_small_sample_and_slices_of_askers(spark, points, sample_rows, ask_rows):
    # a first fit with two centres only, divided in tasks; shards that many vectors ask search in slices
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(points)], "item long, vector array<float>")
    found = {}
    for r in nearest(df, 10, width=16, shard_rows=400, probes=4, ef=24, sample_rows=sample_rows, ask_rows=ask_rows).collect():
        found.setdefault(r.item, []).append(r.neighbour)
    assert recall(found, points, 10, np.arange(0, 3000, 20)) >= 0.9
    assert all(len(v) == len(set(v)) == 10 for v in found.values())


def test_groups_of_equal_vectors(spark, points):
    # a third of all items share one vector, some more come in pairs
    x = np.concatenate([np.repeat(points[:1], 300, axis=0), points[1:500], points[1:40]])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "item long, vector array<float>")
    found = {}
    for r in nearest(df, 5, width=16, shard_rows=100, probes=8, ef=24).collect():
        found.setdefault(r.item, {})[r.neighbour] = r.similarity
    assert set(found) == set(range(len(x))) and all(len(v) == 5 and i not in v for i, v in found.items())
    for i in range(300):
        assert set(found[i]) == set([j for j in range(6) if j != i][:5]) and set(found[i].values()) == {1.0}
    assert all(found[799 + j][300 + j] == found[300 + j][799 + j] == 1.0 for j in range(39))
    exact = np.round(x[300:] @ x.T, 6)
    exact[np.arange(len(exact)), np.arange(300, len(x))] = -2
    tenth = np.sort(exact, axis=1)[:, -5]
    assert np.mean([s >= tenth[i - 300] - 1e-5 for i in range(300, len(x)) for s in found[i].values()]) > 0.95


@pytest.mark.parametrize("nearly", [0.0, 1e-7])
def test_large_cell_of_equal_vectors(spark, nearly):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0 + nearly * (i % 50), *[1.0] * 7]) for i in range(300)] + [(1000 + i, [float(v) for v in rng.normal(size=8)]) for i in range(100)]
    got = nearest(spark.createDataFrame(rows, "item long, vector array<float>"), 3, width=8, shard_rows=40, probes=3, least=0.999).collect()
    close = {r.item for r in got}
    assert close >= set(range(300)) and all(r.item != r.neighbour for r in got)


def test_valid_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 2.0], 3), (1, [0.0, 2.0], 3), (2, [1.0, 1.0], 1), (2, None, 2), (3, [math.nan, 1.0], 1), (4, [0.0, 0.0], 1), (5, [1.0], 1), (6, [], 1), (7, [math.inf, 1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 2.0], None), (9, [None, 1.0], 1)]
    df = spark.createDataFrame(rows, "item_ids long, vectors array<float>, epoch int").selectExpr("*", "1 AS item", "2 AS v")
    assert {(r.item, tuple(r.vector)) for r in valid_vectors(df, "item_ids", "vectors", "epoch", 2).collect()} == {(1, (0.0, 2.0)), (8, (1.0, 2.0))}
    empty = valid_vectors(df.limit(0), "item_ids", "vectors", "epoch", 2)
    assert nearest(empty, 3, width=2).count() == 0
    assert nearest(valid_vectors(df.filter("item_ids = 1"), "item_ids", "vectors", "epoch", 2), 3, width=2).count() == 0


def test_sentences():
    text = "<p>It's a bug &amp; a patch.</p>\n<p>Port 12 was in use, so nothing started!</p> {\"sku\": \"1\"} 😀 https://shop.example/i/9?ref=root"
    found, address = sentences_of(text)
    assert found == ["it's a bug and a patch.", "port # was in use, so nothing started!"] and "root" in address
    assert sentences_of("这个脚本和数据库很合适。下次还会再来！")[0] == ["这个脚本和数据库很合适。", "下次还会再来!"]
    assert sentences_of(None) == ([], []) and sentences_of("  \n ") == ([], [])


def test_sentences_of_a_transcript_with_one_mark():
    openings = {"my partner", "the dough", "we kept", "nobody answered"}
    text = "my partner wanted a whisk is the oven any good? the dough was cold and grey we kept the brine for a week nobody answered for days"
    assert sentences_of(text, openings)[0] == ["my partner wanted a whisk is the oven any good?", "the dough was cold and grey", "we kept the brine for a week", "nobody answered for days"]
    before = "the dough was cold and grey we kept the brine for a week nobody answered for days my partner wanted a whisk so is the oven good?"
    assert len(sentences_of(before, openings)[0]) == 4
    assert sentences_of("The oven is hot. It works! שלום ١٢٣ ไทย नमस्ते")[0] == sentences_of("The oven is hot. It works! 哈哈哈哈哈哈")[0] == ["the oven is hot.", "it works!"]
    assert sentences_of("The oven is hot. It works. without any effort")[0][2:] == ["without any effort"]
    assert sentences_of("They said the dough was cold. It works.", openings)[0] == ["they said the dough was cold.", "it works."]


def test_latent_model_trusts_the_better_function():
    rng = np.random.default_rng(9)
    truth = rng.integers(-1, 4, 4000)
    good = np.where(rng.random(4000) < 0.9, truth, rng.integers(-1, 4, 4000))
    bad = np.where(rng.random(4000) < 0.4, truth, rng.integers(-1, 4, 4000))
    votes = np.stack([good, np.full(4000, -2), good, bad, np.full(4000, -2)], axis=1)
    unique, counts = np.unique(votes, axis=0, return_counts=True)
    log_vote, _, _ = fit_accuracies(unique, counts.astype(float), 4)
    assert log_vote[0][0, 0] > log_vote[3][0, 0]


@pytest.mark.parametrize("scale", [1, 1000])
def test_rare_bad_function_loses_weight(scale):
    rng = np.random.default_rng(12)
    truth = rng.integers(-1, 4, 20_000)
    lexicon = np.where(rng.random(20_000) < 0.9, truth, rng.integers(-1, 4, 20_000))
    frame = np.where(rng.random(20_000) < 0.5, truth, -2)
    none = np.full(20_000, -2)
    address = np.where(rng.random(20_000) < 0.01, rng.integers(0, 4, 20_000), -2)
    votes = np.stack([lexicon, frame, none, none, address, none], axis=1)
    unique, counts = np.unique(votes, axis=0, return_counts=True)
    _, _, right = fit_accuracies(unique, scale * counts.astype(float), 4)
    assert right[0] > 0.88 and right[4] < 0.6


def test_heading_votes_for_its_section():
    know = Knowledge(["law", "sport"], {"court": np.array([3.0, 0.0]), "goal": np.array([0.0, 3.0])}, least=1.0, margin=0.5)
    batch = _Reader().read(["Nothing yet. Chapter 3: the court. It was late. <h2>The goal</h2> Rain fell. <p>Nobody came.</p>", "It was late."])
    batch.sources = [None, None]
    section = know.votes(batch)[:, FUNCTIONS.index("section")]
    assert section.tolist() == [-2, -2, 0, -2, 1, 1, -2]


WORDS = {
    "law": "court judge verdict lawsuit bailiff tribunal notary statute plaintiff witness probate clause".split(),
    "sport": "goal striker racket hurdle trophy referee marathon javelin goalkeeper regatta league stadium".split(),
    "cooking": "oven dough garlic risotto saucepan ladle marinade pastry brine turmeric casserole whisk".split(),
}


def corpus(rng, n):
    rows, truth = [], set()
    chatter = ["The parcel came on day {}.", "Two of {} photos are upside down.", "Nobody answered for {} days."]
    for i in range(n):
        subject = rng.choice(list(WORDS))
        own = int(rng.integers(0, 5))
        parts = [f"Between the {rng.choice(WORDS[subject])} and the {rng.choice(WORDS[subject])} there is little to choose." for _ in range(own)]
        parts += [str(rng.choice(chatter)).format(rng.integers(1, 60)) for _ in range(4)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), "review"))
        if own and own / len(parts) >= 0.25:
            truth.add((i, subject))
    return rows, truth


def test_subjects_of_documents(spark):
    rng = np.random.default_rng(10)
    rows, truth = corpus(rng, 400)
    rows += [(900, None, "review"), (901, "", None), (902, "   ", "review"), (903, "word", "x")]
    examples = [(s.upper() + " ", f"Between the {a} and the {b} there is little to choose. Ask about the {b}.") for s, w in WORDS.items() for a, b in zip(w[:9], w[1:9] + w[:1])]
    examples += [(None, "x y z."), ("law", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS subject", "2 AS key")
    known, parsed = fit_subjects(df, spark.createDataFrame(examples, "subject string, text string"))
    assert known.subjects == ["cooking", "law", "sport"] and "clause" in known.lexicon
    got = {(r.doc_id, r.subject) for r in assign_subjects(df, known).collect()}
    assert len(got & truth) / len(got | truth) > 0.97
    assert {(r.doc_id, r.subject) for r in assign_subjects(df, known, parsed).collect()} == got
    assert assign_subjects(df.limit(0), known).count() == 0


def test_rare_words_are_learned_in_large_corpora(spark):
    rng = np.random.default_rng(11)
    rows, _ = corpus(rng, 400)
    rows += [(1000 + i, f"Between the zamboni and the {a} there is little to choose. Ask the {b} about the {c}. The {c} and the {a} came.", "review") for i, (a, b, c) in enumerate(zip(WORDS["sport"], WORDS["sport"][1:], WORDS["sport"][2:])) if i < 6]
    examples = [(s, f"Between the {a} and the {b} there is little to choose. Ask about the {b}.") for s, w in WORDS.items() for a, b in zip(w, w[1:] + w[:1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(spark.range(10_000, 210_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text", "'review' AS source"))
    known, parsed = fit_subjects(df, spark.createDataFrame(examples, "subject string, text string"))
    assert "zamboni" in known.lexicon and known.lexicon["zamboni"].argmax() == known.subjects.index("sport")


def test_subjects_without_examples_or_documents(spark):
    none = spark.createDataFrame([], "subject string, text string")
    docs = spark.createDataFrame([(1, "Some text here.", "a")], "doc_id long, text string, source string")
    assert assign_subjects(docs, *fit_subjects(docs, none)).count() == 0
    one = spark.createDataFrame([("law", "The court and the judge. The court and the judge.")], "subject string, text string")
    assert assign_subjects(docs.limit(0), *fit_subjects(docs.limit(0), one)).count() == 0
