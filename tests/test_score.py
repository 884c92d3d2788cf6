import math
import random

import pytest
from pyspark.sql import functions as F

from symbolarium.operators import cochange, score, similarity

DAY = 86400
NOW = 1000 * DAY


def brute_score(events, now=NOW):
    kept = sorted(events, reverse=True)[:50]
    total, anchor = 0.0, None
    for ts, size in kept:
        if anchor is None or anchor - ts >= DAY:
            anchor = ts
        total += size * math.exp(-(now - anchor) / DAY / 30)
    age = (now - kept[0][0]) / DAY
    return total * (math.exp(-(age - 30) / 30) if age > 30 else 1)


@pytest.mark.parametrize("start", [NOW - 5 * DAY, NOW - 200 * DAY])
def test_change_score(spark, start):
    rng = random.Random(8)
    groups = {k: [(start - rng.randrange(40 * DAY), rng.randrange(1, 20)) for _ in range(n)] for k, n in {"a": 1, "b": 12, "c": 120}.items()}
    groups["d"] = [(start, 1), (start - DAY + 1, 2), (start - DAY, 3), (start - 2 * DAY + 1, 4)]  # the third begins a window, the fourth joins it
    df = spark.createDataFrame([(k, t, s) for k, xs in groups.items() for t, s in xs] + [("a", None, 1), ("n", None, None)], "k STRING, ts LONG, size INT")
    found = {r.k: r.score for r in score.activity(df, ["k"], F.lit(NOW)).collect()}
    assert found.keys() == groups.keys()
    assert all(math.isclose(found[k], brute_score(xs), rel_tol=1e-12) for k, xs in groups.items())


def test_innermost(spark):
    rng = random.Random(9)
    ranges = [("f" if i % 3 else "g", f"r{i}", a, a + rng.choice([0, 3, 70, 500])) for i in range(60) for a in [rng.randrange(1, 600)]] + [("f", "open", 5, 0), ("f", "none", 5, None)]
    points = [(f, i, i) for f in "fg" for i in range(0, 700, 7)]
    got = score.innermost(spark.createDataFrame(points, "file STRING, point_id INT, line INT"), spark.createDataFrame(ranges, "file STRING, owner STRING, first INT, last INT"), ["file"])
    expected = {}
    for f, i, line in points:
        around = [(b - a, a, o) for g, o, a, b in ranges if g == f and b and a <= line <= b]
        if around:
            expected[f, i] = min(around)[2]
    assert {(r.file, r.point_id): r.owner for r in got.collect()} == expected


def test_percentiles_and_states(spark):
    rows = [
        ("main", True, False, "", 1.0, 10 * DAY, "ast"), ("used", True, False, "", 2.0, 10 * DAY, "ast"), ("old", False, False, "", 4.0, 900 * DAY, "regex"), ("unstable", True, False, None, 8.0, 10 * DAY, None),
        ("todo", False, True, "", 0.5, 5 * DAY, "lexical"), ("marked", False, True, "unused", 0.5, 5 * DAY, "ast"), ("new", False, False, "", float("nan"), 5 * DAY, "lexical"), ("nulls", False, False, None, None, None, None),
    ]
    df = spark.createDataFrame([("p", n, c, t, m, s, None if a is None else NOW - a, src) for n, c, t, m, s, a, src in rows], "project STRING, name STRING, is_called BOOLEAN, has_todo BOOLEAN, intent_marker STRING, instability_score DOUBLE, touched LONG, signal_source STRING")
    limits = score.thresholds(df, ["project"], F.lit(NOW))
    assert math.isclose(limits.head().score_p90, 6.0)  # of 0.5, 0.5, 1, 2, 4, 8
    got = {r.name: (r.found_state, r.found_confidence) for r in score.classify(df, limits, ["project"], F.lit(NOW)).collect()}
    assert got == {
        "main": ("active", 0.9), "used": ("active", 0.9), "old": ("abandoned", 0.35), "unstable": ("unstable", 0.8), "todo": ("planned", 0.7), "marked": ("ignored", 1.0), "new": ("unused", 0.65), "nulls": ("unused", 0.6)
    }


def test_called_in_any_file(spark):
    symbols = spark.createDataFrame([("p", "a.go", "helper"), ("p", "b.py", "helper2"), ("q", "a.go", "helper"), ("p", "c", None)], "project STRING, file STRING, name STRING")
    calls = spark.createDataFrame([("p", "helper")] * 3 + [("p", None)], "project STRING, name STRING")
    got = {(r.project, r.name): r.is_called for r in score.called(symbols, calls, ["project", "name"]).collect()}
    assert got == {("p", "helper"): True, ("p", "helper2"): False, ("q", "helper"): False, ("p", None): False}


def test_hunks(spark):
    df = spark.createDataFrame([("@@ -1,2 +10,5 @@ x",), ("@@ -1 +7 @@",), ("no",)], "h STRING").select(score.hunk(F.col("h")).alias("r"))
    assert [tuple(r.r) for r in df.collect()][:2] == [(10, 5), (7, 1)]
    rows = [("a", 5, 20, 10, 5, 7, False), ("a", 5, 20, 100, 5, 9, False), ("b", 5, 30, 1, 99, 50, False), ("c", 5, 50, 1, 99, 50, True), ("d", 5, 8, 90, 1, 4, False)]
    sizes = score.change_size(spark.createDataFrame(rows, "k STRING, first INT, last INT, start INT, length INT, changed INT, is_new BOOLEAN"), ["k"])
    assert dict(map(tuple, sizes.collect())) == {"a": 7, "b": 20, "c": 10, "d": 1}


def test_ignored_symbols(spark):
    symbols = spark.createDataFrame([("f", "a", 10, 20), ("f", "b", 12, 14), ("g", "a", 1, 5)], "file STRING, name STRING, line INT, end_line INT")
    markers = spark.createDataFrame([("f", 1, "b", 3, "unused"), ("f", 2, "zzz", 13, "unstable"), ("g", 3, "zzz", 99, "unused")], "file STRING, marker_id INT, mark_name STRING, mark_line INT, ignore_type STRING")
    assert sorted((r.marker_id, r.name) for r in score.ignored(symbols, markers, ["file"]).collect()) == [(1, "b"), (2, "a")]


def brute_cosine(texts, threshold, top):
    from collections import Counter

    vectors = {i: Counter(t.split()) for i, t in texts.items()}
    n, df = len(texts), Counter(w for v in vectors.values() for w in v)
    unit = {}
    for i, v in vectors.items():
        w = {t: c * math.log(1 + n / df[t]) for t, c in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {t: x / norm for t, x in w.items()}
    out = {}
    for i in unit:
        sims = sorted(((-round(s, 9), j) for j in unit if j != i if (s := sum(x * unit[j].get(t, 0) for t, x in unit[i].items())) >= threshold))
        out.update({(i, j): -s for s, j in sims[:top]})
    return out


@pytest.mark.parametrize(("threshold", "top"), [(0.2, 6), (0.5, 1), (0.9, 3), (1.01, 3)])
def test_related_texts(spark, threshold, top):
    rng = random.Random(10)
    words = [f"w{i}x" for i in range(40)]
    texts = {f"t{i}": " ".join(rng.choices(words, weights=range(1, 41), k=rng.randrange(3, 12))) for i in range(60)}
    df = spark.createDataFrame([("g", i, t) for i, t in texts.items()], "grp STRING, id STRING, text STRING")
    got = {(r.id, r.other): r.similarity for r in similarity.related(df, "grp", threshold, top).collect()}
    expected = brute_cosine(texts, threshold, top)
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-8) for k in got)


def test_cosine(spark):
    df = spark.createDataFrame([("g", "a", "cache token"), ("g", "b", "caches tokens"), ("g", "c", "cache graph"), ("g", "d", None), ("h", "e", "cache token")], "grp STRING, id STRING, text STRING")
    got = {(r.id, r.other): round(r.similarity, 6) for r in similarity.cosine(df, "grp", 0.1).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.5, ("b", "c"): 0.5}


def test_co_change(spark):
    commits = [("p", h, f) for h, fs in {"1": "ab", "2": "ab", "3": "abc", "4": "b"}.items() for f in fs] + [("p", "1", "a"), ("p", None, "a")]
    got = cochange.co_changes(spark.createDataFrame(commits, "project STRING, hash STRING, file STRING")).collect()
    assert [(r.file_a, r.file_b, r.co_occurrences, r.commits_a, r.commits_b, r.jaccard) for r in got] == [("a", "b", 3, 3, 4, 0.75)]
    pairs = spark.createDataFrame([("p", "a", "b", 0.75), ("p", "c", "d", 0.5)], "project STRING, file_a STRING, file_b STRING, jaccard DOUBLE")
    hidden = cochange.hidden(pairs, spark.createDataFrame([("p", "b", "a")], "project STRING, src STRING, dst STRING"))
    assert sorted((r.src, r.dst) for r in hidden.collect()) == [("c", "d"), ("d", "c")]
