import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm.bpe import TOKENIZERS, Encoder, Merges, token_counts, token_ids
from tideline.llm import mixing
from tideline.llm.mixing import mix_sources, permuted, split_quotas

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Merges.load(FILE))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=120))
def test_ids_equal_the_library(encoder, library, text):
    assert encoder.encode([text]) == [library(text)]


@pytest.mark.parametrize("text", ["", " ", "\n \t\n", "don't WE'LL 's", "a" * 5000, "ab" * 3000, "<|endoftext|>", "中文" * 3000, "é́​🧵👩‍🔬", "9" * 700, " " * 600 + "x", "https://shop.example/i/1?ref=daa77344cfd4"])
def test_odd_texts(encoder, library, text):
    assert encoder.encode([text])[0] == library(text)


def test_table_of_texts(spark, library):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc étß中 \n.,'x") for _ in range(rng.randrange(80)))) for i in range(200)] + [(500, None), (501, ""), (501, ""), (None, "x"), (502, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids", "1 AS tokens")
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_ids(df, "doc_id").collect())
    assert got == Counter((k, tuple(library(t)) if t else ()) for k, t in rows)
    counts = Counter((r.doc_id, r.tokens) for r in token_counts(df.drop("tokens"), ["doc_id"]).collect())
    assert counts == Counter((k, len(library(t)) if t else 0) for k, t in rows)
    assert token_ids(df.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("unit", [1, 10**9])
def test_split_quotas_keeps_sums(unit):
    counts = np.array([100, 3, 0, 57]) * unit
    ranges, out = split_quotas(counts, 0, 7, 1)
    assert (out.sum(axis=0) == counts).all() and (out >= 0).all() and [tuple(r) for r in ranges] == [(i, i + 1) for i in range(7)]
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= max(3, 0.01 * counts.sum())
    top, part = split_quotas(counts, 0, 7, 1, most=4)
    below = [split_quotas(part[i], int(l), int(h), 1)[1] for i, (l, h) in enumerate(top)]
    assert len(top) == 4 and (np.concatenate(below) == out).all()


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4097])
def test_permutation_is_one(n):
    assert sorted(permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_many_shards_are_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOP_NODES", 64)
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 6 == 0, "b").otherwise("a").alias("source"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    per = defaultdict(Counter)
    for r in mix_sources(df, targets, shard_tokens=200).rows.collect():
        per[r.shard][r.source] += r.tokens
    assert len(per) == 300 and sum(sum(c.values()) for c in per.values()) == pytest.approx(60_000, abs=2)
    assert all(140 <= sum(c.values()) <= 260 and 0.3 <= c["b"] / sum(c.values()) <= 0.7 for c in per.values())
    assert sum(c["b"] for c in per.values()) == pytest.approx(30_000, abs=1)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randrange(1, 60), s) for i, s in enumerate(["A"] * 300 + [" b "] * 60 + ["C"] * 5 + ["other"] * 20 + [None] * 5)]
    rows += [(900, None, "a"), (901, "", "A"), (902, "x y", "B")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'z' AS shard", "0 AS tokens")


TARGETS = [("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 4)]


def test_mix_reaches_shares_or_what_sources_can_give(spark, corpus):
    rows, df = corpus
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mix_sources(df.drop("tokens"), targets, shard_tokens=2000)
    drawn = mix.rows.collect()
    size = {r.doc_id: r.tokens for r in drawn}
    own = defaultdict(int)
    for k, t, s in rows:
        if t is not None and s is not None and s.strip().lower() in ("a", "b", "c"):
            own[s.strip().lower()] += size.get(k, 0) if t else 0
    times = Counter((r.source, r.doc_id) for r in drawn)
    assert all(n <= {s: m for s, _, m in TARGETS}[source] for (source, _), n in times.items())
    shares = {r.source: r for r in mix.shares.collect()}
    total = sum(r.source_tokens for r in shares.values())
    for source, share, repeats in TARGETS:
        r = shares[source]
        quota = min(share * total, repeats * r.source_tokens)
        assert quota - 70 <= r.used_tokens <= quota + 1e-6
        assert r.capacity_tokens == repeats * r.source_tokens and r.wanted_tokens == pytest.approx(share * total)
    assert sum(r.reached_share for r in shares.values()) == pytest.approx(1.0)
    per_shard = Counter()
    for r in drawn:
        per_shard[r.shard] += r.tokens
    assert len(per_shard) > 3
    places = defaultdict(list)
    for r in drawn:
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_full_passes_use_each_document_equally(spark, corpus):
    _, df = corpus
    targets = spark.createDataFrame([("c", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = mix_sources(df.drop("tokens"), targets, total_tokens=10**9)
    assert set(Counter(r.doc_id for r in mix.rows.collect()).values()) == {2}
    assert mix.shares.first().used_tokens == mix.shares.first().capacity_tokens


def test_mix_of_nothing(spark, corpus):
    _, df = corpus
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix = mix_sources(df.drop("tokens").limit(0), targets)
    assert mix.rows.count() == 0 and mix.shares.count() == 4
    assert mix_sources(df.drop("tokens"), targets.limit(0)).rows.count() == 0
    with pytest.raises(ValueError):
        mix_sources(df.drop("tokens"), targets.union(targets))
