"""Texts of the same words are compared once, and no pair of texts is joined."""

import random

import pytest
from test_similarity_blocks import brute

from symbolarium.operators import similarity
from symbolarium.plans import reference


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_equal_texts_same_as_brute_force(spark, threshold):
    rng = random.Random(5)
    phrases = ["w1x", "w1x w1x", "w2x w1x", "w1x w2x", "w2x w1x w3x", "w4x", "", "w3x w4x", "w5x w5x w6x"]
    texts = [(p, f"{p}{k}", rng.choice(phrases)) for p, n in (("p", 90), ("q", 9), ("r", 1)) for k in range(n)]
    df = spark.createDataFrame(texts, "project STRING, id STRING, text STRING")
    for block in (2, 1000):
        rows = similarity.related_by_blocks(df, "project", threshold, 6, block).collect()
        assert len({(r.project, r.id, r.other) for r in rows}) == len(rows)
        assert {(r.project, r.id, r.other, round(r.similarity, 6)) for r in rows} == brute(texts, threshold, 6)


def test_similar_texts_without_pairs_in_a_shuffle(spark, monkeypatch):
    def pairs(*_):
        raise AssertionError("pairs of texts are joined")

    monkeypatch.setattr(similarity, "related", pairs)
    assert reference.tfidf_similar(spark, "/root/testdata/sf0.01").count() == 442


def test_one_row_compared_for_equal_texts(spark, monkeypatch):
    sizes = []
    real = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df: sizes.append(real(df)) or sizes[-1])
    texts = [("p", f"{k}", f"same words {k % 3 * 'again '}") for k in range(50)]
    similarity.related_by_blocks(spark.createDataFrame(texts, "project STRING, id STRING, text STRING"), "project", 0.2, 6)
    assert min(df.count() for df in sizes) == 3
