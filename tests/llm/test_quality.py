"""Quality: held-out accuracy, one pass against a brute-force average, and the order of rows."""

import random

import numpy as np
import pytest

from noticeloom.llm import quality
from noticeloom.llm.ftrl import softmax


def corpus(n=160):
    rng = random.Random(3)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sal"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        docs.append((i, text if good else rng.choice([" | ".join(text.split()), text.upper() + "!!", " ".join(w for w in text.split() for _ in range(6))])))
        labels.append((i, int(good)))
    return docs, labels


def tables(spark, docs, labels, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_classes(spark):
    docs, labels = corpus()
    d, y = tables(spark, docs, labels)
    model = quality.train(d, y.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in quality.score(d, model, keep=["doc_id"]).collect()}
    held = [(got[i]["score"], got[i]["predicted"], q) for i, q in labels if i % 5 == 0]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in held)
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([p == q for _, p, q in held]) > 0.9


def test_fit_does_not_depend_on_how_rows_lie(spark):
    docs, labels = corpus(60)
    one, seven = (quality.train(*tables(spark, docs, labels, n)) for n in (1, 7))
    assert all(np.array_equal(one[k], seven[k]) for k in ("vectors", "layer", "constant"))


def test_score_is_the_average_of_vectors(spark):
    rng = np.random.default_rng(1)
    model = {"classes": [0, 1], "vectors": rng.normal(size=(quality.VECTORS, quality.WIDTH)).astype("f4"), "layer": rng.normal(size=(2, quality.WIDTH)).astype("f4"), "constant": np.array([0.3, -0.2], "f4")}
    texts = ["a", "ab ab ab", "The the\tthe  end.", "é " * 400 + "日本", "", None, " \n", "x" * 9000]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        words = (text or "").split()
        at = []
        for w in words:
            at += quality.word_vectors([w])[0].tolist()
        for v, w in zip(words, words[1:]):
            at += quality.pair_vectors(np.array([quality.word_vectors([x])[2][0] for x in (v, w)])).tolist()
        hidden = model["vectors"][at].mean(0) if at else np.zeros(quality.WIDTH)
        assert got[k] == pytest.approx(softmax(model["layer"] @ hidden + model["constant"])[1], abs=1e-4)


def test_edges(spark):
    docs, labels = corpus(30)
    d, y = tables(spark, docs, labels)
    none = quality.train(d, y.limit(0))
    assert {r["score"] for r in quality.score(d, none).collect()} == {1.0}
    assert {r["score"] for r in quality.score(d, quality.train(d, y.where("quality = 0"))).collect()} == {0.0}
    model = quality.train(d, y)
    rows = spark.createDataFrame([(1, "a b", 0.5, "x"), (1, "a b", 0.5, "x"), (None, None, None, None)], "doc_id long, text string, score double, vectors string")
    with pytest.raises(ValueError, match="score"):
        quality.score(rows, model)
    out = quality.score(rows, model, names=("good", "kept")).collect()
    assert len(out) == 3 and {r["score"] for r in out} == {0.5, None} and len({r["good"] for r in out if r["doc_id"] == 1}) == 1
    assert quality.score(rows.limit(0), model, keep=["doc_id"]).collect() == []
