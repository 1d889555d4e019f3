"""The classifier: its trees, its features, its handling of odd tables, and accuracy on held-out documents."""

import os
import random
import zlib

import numpy as np
import pytest

from ridgeline.llm import quality_model as q


def walked(model, row):
    total = model.prior
    for feature, threshold, value in zip(model.feature, model.threshold, model.value):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + (row[feature[at]] > threshold[at])
        total += value[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_arrays_equal_a_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = q.fit(x[:2000], y[:2000])
    score = model.score(x[2000:])
    assert ((score > 0.5) == y[2000:]).mean() > 0.9
    assert np.allclose(score[:50], [walked(model, row) for row in x[2000:2050]])
    assert np.array_equal(model.score(x[:1]), model.score(x[:2])[:1]) and model.score(x[:0]).shape == (0,)


def test_without_both_labels_a_constant():
    for x, y in ((np.empty((0, 3)), np.empty(0)), (np.ones((5, 3)), np.ones(5))):
        score = q.fit(x, y).score(np.ones((4, 3)))
        assert np.ptp(score) == 0 and 0 < score[0] < 1


def test_features_of_odd_texts():
    for text in (None, "", " \n", "a", "é" * 5, "x " * 5000, "\x00\n\n", "A!? 1|2 <b>"):
        row = q.features(text)
        assert len(row) == q.N_FEATURES and np.isfinite(row).all()


def test_scores_of_a_table(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(80)) + "."
    bad = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(4)) + "###" for _ in range(80))
    docs = [(i, good() if i % 3 else bad()) for i in range(600)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(600)]
    df = spark.createDataFrame([*docs, (None, None), (700, ""), (5, docs[5][1])], "doc_id long, text string").selectExpr("*", "9 score", "'q' quality")
    marks = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (4, 7, 1)], "doc_id long, quality int, toxic int")
    got = q.scored(df, q.train(df.select("doc_id", "text"), marks)).collect()
    assert len(got) == 603 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert len({x.score for x in got if x.doc_id == 5}) == 1
    held = [x for x in got if x.held_out and x.doc_id < 600]
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.95
    # Labels of held-out documents make no difference.
    turned = [(i, k if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - k, t) for i, k, t in labels]
    again = q.scored(df, q.train(df.select("doc_id", "text"), spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))).collect()
    assert {x.doc_id: x.score for x in again} == {x.doc_id: x.score for x in got}


def test_empty_tables(spark):
    df, marks = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.scored(df, q.train(df, marks)).count() == 0
    one = spark.createDataFrame([(1, "some text")], df.schema)
    assert q.scored(one, q.train(df, marks)).first().score == pytest.approx(0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = q.scored(docs, q.train(docs, labels)).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([x.score for x in rows if x.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
