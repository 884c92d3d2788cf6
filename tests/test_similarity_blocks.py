"""Blocks of texts against brute force, and the plans' threshold."""

import math
import random
from collections import Counter

import pytest

from symbolarium.operators import similarity
from symbolarium.plans import reference


def brute(texts, threshold, top):
    out = set()
    for p in {t[0] for t in texts}:
        bags = {i: Counter(x.split()) for q, i, x in texts if q == p}
        df = Counter(w for b in bags.values() for w in b)
        vs = {i: {w: n * math.log(1 + len(bags) / df[w]) for w, n in b.items()} for i, b in bags.items()}
        norms = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vs.items()}
        for a, v in vs.items():
            sims = [(sum(x * u.get(w, 0) for w, x in v.items()) / norms[a] / norms[b], b) for b, u in vs.items() if b != a and u and v]
            best = sorted((-round(s, 9), b) for s, b in sims if s >= threshold)[:top]
            out |= {(p, a, b, round(-s, 6)) for s, b in best}
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_same_as_brute_force(spark, monkeypatch, block):
    rng = random.Random(3)
    words = [f"w{k}x" for k in range(25)]
    texts = [(p, f"{p}{k}", " ".join(rng.choices(words, k=rng.randrange(0, 7)))) for p, n in (("p", 40), ("q", 9), ("r", 1)) for k in range(n)]
    df = spark.createDataFrame(texts, "project STRING, id STRING, text STRING")
    got = {(r.project, r.id, r.other, round(r.similarity, 6)) for r in similarity.related_by_blocks(df, "project", 0.2, 6, block).collect()}
    assert got == brute(texts, 0.2, 6)
    assert any(s < 0.6 for *_, s in got)


def test_plan_keeps_weak_links(spark, sf):
    weak = {(r.project, r.id, r.other) for r in reference.tfidf_related(spark, sf).collect()}
    strong = {(r.project, r.id, r.other) for r in reference.tfidf_similar(spark, sf).collect()}
    assert strong < weak
