"""Toxicity: held-out accuracy, located sentences, what a score may depend on, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs
from turnlens.llm.queries import op7
from turnlens.llm.toxicity import Model, fit_noisy_or, held_out, score_documents, train, with_score


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op7(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id") \
        .select("doc_id", "held_out", "score", "predicted", "toxic").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    test = rows[rows.held_out]
    y, p = test.toxic.to_numpy(), test.predicted.to_numpy()
    rank = test.score.rank().to_numpy()
    auc = (rank[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()
    precision, recall = (p & y).sum() / p.sum(), (p & y).sum() / y.sum()
    assert auc > 0.97 and precision > 0.85 and recall > 0.85
    assert ((test.score >= 0.3).astype(int) == test.predicted).all() and test.score.between(0, 1).all()


@pytest.fixture(scope="module")
def small(spark):
    bad, ok = "What a {} thing. The sun is out. We walk home.", "What a nice thing. The sun is out. We walk home."
    docs = [(i, bad.format(["vile", "vileness", "awful"][i % 3]) if i % 4 == 0 else ok) for i in range(1, 200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1, 200)] + [(500, 1, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    return make_docs(spark, docs), labels


def test_locates_the_sentence(spark, small, edge_rows):
    model = train(*small, ~held_out())
    docs = make_docs(spark, [(1, "Nice day. This is vile! Bye."), (2, "Nice day. Bye."), *edge_rows])
    got = [r for r in score_documents(docs, model).collect()]
    first = next(r for r in got if r["doc_id"] == 1 and r["sentences"])
    assert first["score"] > 0.3 and first["sentences"][0]["place"] == 1 and first["sentences"][0]["text"] == "This is vile"
    assert len(got) == len(edge_rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 2)["score"] < 0.3
    empty = {round(r["score"], 12) for r in got if r["doc_id"] in (3, 4)}
    assert len(empty) == 1 and empty.pop() < 0.3
    kept = with_score(docs, model, score_col="s")
    assert kept.columns == [*docs.columns, "s"] and kept.count() == len(got)


def test_held_out_labels_are_never_read(spark, small):
    docs, labels = small
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels, ~held_out()), train(docs, flipped, ~held_out())
    assert a.weight == b.weight and a.bias == b.bias


def test_without_labels(spark, small):
    docs, labels = small
    for some in (labels.where("false"), labels.where("toxic = 0")):
        model = train(docs, some, ~held_out())
        assert {r["score"] < 1e-9 for r in score_documents(docs, model).collect()} == {True}
    assert score_documents(docs.where("false"), Model({}, -3.0)).count() == 0


def test_noisy_or_gradient():
    """The fit lowers the loss and puts the weight on the feature that explains the positive bags."""
    # bags 0-19: positive, one sentence with feature 0 among others with feature 1; bags 20-39: only feature 1
    bag = np.repeat(np.arange(40), 3)
    sentence = np.arange(120)
    feature = np.ones(120, dtype=int)
    feature[0:60:3] = 0
    y = (np.arange(40) < 20).astype(float)
    w, bias = fit_noisy_or(y, np.zeros(40), bag, sentence, feature, 2)
    p = 1 / (1 + np.exp(-(bias + w)))
    assert p[0] > 0.9 and p[1] < 0.05


def test_score_is_the_noisy_or_of_the_sentences():
    import math
    import random
    import re
    from turnlens.llm.toxicity import word_features
    r = random.Random(2)
    names = ["vile", "vil*", "nice", "aw*", "awf*"]
    model = Model({n: r.uniform(-2, 3) for n in names}, -2.5)
    for _ in range(80):
        text = "".join(r.choice(["vile ", "vilest ", "nice ", "awful ", "day ", ". ", "! ", "\n"]) for _ in range(r.randint(0, 40)))
        clean = 1.0
        parts = [s for s in re.split(r"[.!?\n]+", text) if s.strip()] or [""]
        for s in parts:
            z = model.bias + sum(model.weight.get(f, 0.0) for w in re.findall(r"\w+", s.lower()) for f in word_features(w))
            clean *= 1 - 1 / (1 + math.exp(-z))
        total, found, own = model.bag(text)
        assert total == pytest.approx(1 - clean) and found == parts and len(own) == len(parts)


def test_counted_sentences_fit_alike():
    """Repeated sentences as one row with a count give the fit of the single rows."""
    r = np.random.default_rng(1)
    bag = np.repeat(np.arange(30), 3)
    sentence, feature = np.arange(90), r.integers(0, 4, size=90)
    y, empty = (np.arange(30) % 3 == 0).astype(float), np.ones(30)
    twice = fit_noisy_or(y, empty, np.repeat(bag, 2), np.arange(2 * len(bag)), np.repeat(feature, 2), 4)
    counted = fit_noisy_or(y, empty, bag, sentence, feature, 4, np.full(len(bag), 2.0))
    assert np.allclose(twice[0], counted[0]) and twice[1] == pytest.approx(counted[1])


def test_training_rows_are_one_for_each_id(spark):
    from turnlens.llm.toxicity import training_rows
    docs = make_docs(spark, [(1, "b"), (1, "a"), *[(2, "hot")] * 200, (3, None), (None, "x"), (5, "z" * 100)])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1), (5, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    rows = lambda **kw: sorted(tuple(r) for r in training_rows(docs, labels, F.lit(True), **{"sample": 100, **kw}).collect())
    assert rows() == [("", 1), ("a", 1), ("hot", 0), ("z" * 100, 0)]
    assert len(rows(sample=2)) == 2 and all(len(t) < 50 for t, _ in rows(most_chars=50))
    many = spark.range(10_000).select((F.col("id") + 100).alias("doc_id"), F.lit(1).alias("toxic"))
    assert ("a", 1) in [tuple(r) for r in training_rows(docs, labels.unionByName(many), F.lit(True), 10).collect()]  # ids without a document
    named = docs.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    assert training_rows(named, labels, F.lit(True), 10).count() == 0


def test_very_long_texts_train(spark):
    text = "What a vile thing it is. " * 30_000
    docs = make_docs(spark, [(i, text if i == 4 else "What a vile day." if i % 4 == 0 else "What a nice day.") for i in range(1, 80)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1, 80)], "doc_id long, quality int, toxic int")
    model = train(docs, labels, F.lit(True))
    assert model.bag("vile")[0] > 0.3 > model.bag("nice")[0]
