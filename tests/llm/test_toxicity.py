"""The toxicity classifier."""

import zlib

import numpy as np

from paperloom.llm import entry, toxicity
from paperloom.llm.toxicity import Classifier, count_features, present, score, select_features, train


def test_features_do_not_cross_texts():
    slots = np.arange(1 << 20, dtype=np.int64)
    texts = ["abc def", "", "x", "ABC def", "é" * 50]
    doc, feature = present(texts, slots)
    for k, t in enumerate(texts):
        own = present([t], slots)[1]
        assert sorted(feature[doc == k]) == sorted(own)
    assert sorted(feature[doc == 0]) == sorted(feature[doc == 3])


def test_ratios_are_naive_bayes():
    counts = np.zeros((2, 1 << 20), np.int32)
    count_features(["vile word", "vile thing", "nice word", "nice day"] * 5, np.array([1, 1, 0, 0] * 5), counts)
    at = np.nonzero(counts.any(0))[0]
    best, ratio = select_features(counts[:, at].astype(float), np.array([10.0, 10.0]), 50)
    c = counts[:, at[best]]
    assert np.allclose(ratio, np.log((c[1] + 1) / 12) - np.log((c[0] + 1) / 12)) and len(best) == 50


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["river", "stone", "bridge", "mill", "garden", "window", "paper"]
    rows = []
    for k in range(n):
        toxic = k % 4 == 0
        own = rng.choice(words, rng.integers(3, 60)).tolist()
        if toxic:
            own.insert(rng.integers(0, len(own)), rng.choice(["blockhead", "nitwit"]))
        rows.append((k, " ".join(own), int(toxic)))
    return rows


def test_fit_and_score(spark):
    rows = texts(400, 1)
    docs = spark.createDataFrame([(k, t, -1.0, "x") for k, t, _ in rows] + [(9000, None, 0.0, None), (9000, None, 0.0, None)], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows[:300]] + [(301, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    model = train(docs, labels, "toxic", features=512)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    right = [(got[k] >= 0.5) == bool(y) for k, _, y in rows[300:]]
    assert np.mean(right) >= 0.97 and 0 <= got[9000] < 0.5 and score(docs, model).count() == 402
    assert score(docs.where("false"), model).count() == 0


def test_a_very_long_text_is_scored_whole(spark):
    rows = texts(400, 2)
    long = "river stone " * 40_000
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, long), (9001, "blockhead nitwit " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score(docs, train(docs, labels, "toxic", features=512)).collect()}
    assert got[9000] < 0.5 < got[9001]


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    scores = lambda rows: {round(r.score, 6) for r in score(docs, train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), "toxic")).collect()}
    assert scores([]) == {0.5} and scores([(1, 0)]) == {0.0} and scores([(1, 1), (1, 1)]) == {1.0}


def test_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.op8_toxicity(spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    pos, neg = ([s for s, y in held if y == k] for k in (1, 0))
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    accuracy = np.mean([(s >= 0.5) == bool(y) for s, y in held])
    assert auc >= 0.97 and accuracy >= 0.95


def test_empty_text_has_the_bias():
    model = Classifier(np.full(1 << 20, -1, np.int16), np.zeros(1, np.float32), 0.0)
    assert len(present([""], model.slots)[0]) == 0 and toxicity.ORDERS[0] == 3
