"""Features by hand, sums kept by word against whole texts, and held-out accuracy."""

import numpy as np

from imgcurate.llm.quality_classifier import Scorer, Shape, document_features, score_quality, train, word_features

FOLDER = "/root/testdata/sf0.1"


def test_features_of_words():
    shape = Shape()
    buckets, owner = word_features(["abc", "x", "abc"], shape)
    # <abc> has itself and 3 + 2 n-grams of 3 and 4; <x> only itself, which is its 3-gram too.
    assert np.bincount(owner).tolist() == [6, 1, 6]
    assert sorted(buckets[owner == 0]) == sorted(buckets[owner == 2])
    assert buckets.max() < shape.buckets - 2


def test_a_text_scores_as_its_features():
    shape = Shape(buckets_log2=10)
    odds = np.random.default_rng(1).normal(size=shape.buckets).astype(np.float32)
    texts = ["", "a", "the the cat", "é 😀 long word " * 50, "x y z"]
    want = []
    for t in texts:
        buckets, share = document_features(t, shape)
        want.append(1 / (1 + np.exp(-(odds[buckets].astype(float) * share).sum())))
    for most in (2, 1_000):
        scorer = Scorer(odds, shape, most)
        assert np.allclose(scorer.score(texts), want)
        assert np.allclose(np.concatenate([scorer.score([t]) for t in texts]), want)


def test_learns_words_and_repeats():
    shape = Shape(buckets_log2=12)
    texts = [(f"good word{i} fine", 1) for i in range(60)] + [(f"bad bad word{i}", 0) for i in range(60)]
    odds = train([(*document_features(t, shape), y) for t, y in texts], shape)
    scores = Scorer(odds, shape).score(["fine good new", "bad bad new"])
    assert scores[0] > 0.8 and scores[1] < 0.2
    assert (train([(*document_features("a", shape), 1)], shape) == 0).all()


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    kept = {v: np.mean([r.predicted for r in rows if r.quality == v]) for v in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.05


def test_edges(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (2, "word " * 300_000, "b"), (2, "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (99, 1), (2, 0)], "doc_id long, quality int")
    out = score_quality(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text is None}) == 1
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0
