"""The fit of toxicity: every labelled text is learnt from, in one shard or many, and curve and thresholds come from all scores."""

import numpy as np
import pytest

from seatrace.llm import toxicity
from seatrace.llm.common import platt, sigmoid


def tables(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic long")


def test_long_texts_are_learnt_from(spark):
    texts = ["fine words here " * 1500 + ("vile" if i % 2 else "kind") for i in range(24)]
    net, prior = toxicity.fit(*tables(spark, texts, [i % 2 for i in range(24)]), updates=300)
    assert prior == 0.5 and net is not None

    class Held:
        value = net

    kind, vile = toxicity._kernel(Held, prior)(["kind", "vile"])["score"]
    assert vile > kind


@pytest.mark.parametrize("shard", [20, 6000])
def test_every_label_counts_in_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(toxicity, "SHARD", shard)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, 15)) + (" vile" if i % 4 == 0 else "") for i in range(120)]
    docs, labels = tables(spark, texts, [int(i % 4 == 0) for i in range(120)])
    rows = toxicity.learning_rows(docs, labels, "toxic", 120, folds=3, slices=2, id_col="doc_id", text_col="text", lang_col="lang")
    assert sorted(r["text"] for r in rows.collect()) == sorted(texts)
    df = np.zeros(1 << 12, int)
    for t in texts:
        df[sorted({b for w in toxicity.words(t) for b in toxicity.parts(w, 1 << 12) if b >= 0})] += 1
    assert toxicity.frequent_buckets(rows, 1 << 12, 5).tolist() == np.flatnonzero(df >= 5).tolist()
    model = toxicity.fit(docs, labels, updates=1200, buckets=1 << 12)
    got = toxicity.score_toxicity(docs, model).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got]) > 0.95


@pytest.mark.parametrize("buckets", [1 << 20, 1000003])
def test_words_hashed_side_by_side_have_their_parts(buckets):
    found = ["a", "abcd", "abcde", "abcdef", "abcdefg", "a" * 64, "a" * 65, "b" * 3000, "é", "ééééé", "abcdé", "日本語テキスト", "x_1", "0"]
    assert toxicity.parts_of(found, buckets).tolist() == [toxicity.parts(w, buckets) for w in found]
    vocabulary = toxicity.Vocabulary(buckets)
    assert vocabulary("b a b").tolist() == [1, 2, 1] and vocabulary("c a").tolist() == [3, 2]
    assert vocabulary.parts(2).tolist() == [toxicity.parts(w, buckets) for w in "ac"] and vocabulary.parts()[:2].tolist() == [[-1] * toxicity.PARTS, toxicity.parts("b", buckets)]


def test_numbers_are_told_apart_as_by_unique():
    distinct, rng = toxicity._Distinct(50), np.random.default_rng(1)
    for n in (0, 1, 40, 200):
        numbers = rng.integers(0, 50, n)
        for got, want in zip(distinct(numbers), np.unique(numbers, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()


def test_curve_and_cuts_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    y = rng.random(400) < 0.3
    raw = np.round(rng.normal(0, 1, 400) + y, 2)
    lang = np.where(rng.random(400) < 0.1, "de", "en")
    scores = spark.createDataFrame([(str(a), int(b), float(c)) for a, b, c in zip(lang, y, raw, strict=True)], "lang string, y int, raw double").repartition(4)
    assert np.allclose(toxicity.curve(scores), platt(raw, y.astype(float), np.ones(400)), atol=1e-6)
    cuts = {(r["lang"], r["every"]): r for r in toxicity.best_cuts(scores).collect()}
    assert set(cuts) == {("", True), ("de", False), ("en", False)}
    for (name, every), r in cuts.items():
        own = (lang == name) | every
        middle = (sigmoid(r["raw"]) + (0 if r["below"] is None else sigmoid(r["below"]))) / 2
        assert np.isclose(middle, toxicity._best(sigmoid(raw[own]), y[own].astype(float), np.ones(own.sum()), 0.5))
        assert r["rarer"] == min(y[own].sum(), (~y[own]).sum())
