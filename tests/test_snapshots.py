import random

import pytest
from pyspark.sql import functions as F

from symbolarium.operators import snapshots

ROW = "file STRING, name STRING, state STRING, churn INT"
KEY = ["file", "name"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_diff_and_apply(spark):
    a = spark.createDataFrame([("f", "a", "x", 1), ("f", "b", "x", None), ("f", "c", None, 3), (None, "n", "x", 1)], ROW)
    b = spark.createDataFrame([("f", "b", "x", None), ("f", "c", "y", 3), ("f", "d", "x", 4), (None, "n", "x", 1)], ROW)
    delta = snapshots.diff(a, b, KEY, ["state", "churn"])
    assert rows(delta) == [("f", "a", "x", 1, "removed"), ("f", "c", "y", 3, "changed"), ("f", "d", "x", 4, "added")]
    keyed = a.filter("file IS NOT NULL")
    assert rows(snapshots.apply(keyed, delta, KEY)) == rows(b.filter("file IS NOT NULL"))
    assert snapshots.diff(a, a, KEY, ["state", "churn"]).count() == 0
    empty = spark.createDataFrame([], ROW)
    assert snapshots.diff(empty, a, KEY, ["state"]).filter("change = 'added'").count() == 4


def test_chain_is_the_last_state(spark):
    rng = random.Random(11)
    state, events = {}, []
    for seq in range(12):
        for k in range(8):
            if rng.random() < 0.4:
                if k in state and rng.random() < 0.4:
                    del state[k]
                    events.append((f"f{k}", "n", seq, "removed", None, None))
                else:
                    events.append((f"f{k}", "n", seq, "changed" if k in state else "added", f"s{seq}", seq))
                    state[k] = (f"s{seq}", seq)
    df = spark.createDataFrame(events, "file STRING, name STRING, seq INT, change STRING, state STRING, churn INT")
    assert rows(snapshots.chain(df, KEY)) == sorted((f"f{k}", "n", *v) for k, v in state.items())


@pytest.fixture
def headers(spark):
    return snapshots.sequence(spark.createDataFrame([("p", f"{k:02x}", k) for k in range(35)], "project STRING, hash STRING, at INT"))


def test_sequence_chain_prune(headers):
    assert [r.seq for r in headers.filter("is_checkpoint").orderBy("seq").collect()] == [0, 10, 20, 30]
    assert rows(snapshots.chain_of(headers, "0d")) == [("0a", 0), ("0b", 1), ("0c", 2), ("0d", 3)]
    assert rows(snapshots.chain_of(headers, "0a")) == [("0a", 0)]
    assert snapshots.chain_of(headers, "zz").count() == 0
    assert snapshots.pruned(headers, 2).agg(F.max("seq"), F.count(F.lit(1))).head() == (19, 20)
    assert snapshots.resolved(headers.select("hash"), "0A").head().hash == "0a"


def test_hashes_of_sets(spark):
    df = spark.createDataFrame([("g", f"n{i}", None, i) for i in range(50)], ROW)
    same = df.repartition(7).orderBy(F.desc("churn"))
    for f in (snapshots.fingerprint, snapshots.content_hash):
        assert rows(f(df, ["file"], ["name", "state", "churn"])) == rows(f(same, ["file"], ["name", "state", "churn"]))
        assert rows(f(df, ["file"], ["name", "churn"])) != rows(f(df.filter("churn > 0"), ["file"], ["name", "churn"]))
    twice = df.unionByName(df)
    assert snapshots.fingerprint(twice, ["file"], ["name"]).head().rows == 100


def test_cache(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "file STRING, v STRING")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "file STRING, v STRING")
    assert rows(snapshots.upserted(stored, new, ["file"])) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert rows(snapshots.evicted(stored, new, ["file"])) == [("b", "2")]
    listing = spark.createDataFrame([("a", 1), ("b", 5), ("z", 1)], "file STRING, mtime INT")
    manifest = spark.createDataFrame([("a", 1), ("b", 2)], "file STRING, mtime INT")
    assert rows(snapshots.rescan(listing, manifest, ["file"])) == [("a", 1, "reuse"), ("b", 5, "extract"), ("z", 1, "new")]


def test_deltas_same_as_diffs(spark):
    rng = random.Random(5)
    states = [{f"f{k}": rng.choice(["x", "y", None]) for k in range(6) if rng.random() < 0.6} for _ in range(5)]
    df = spark.createDataFrame([(f, k, 5, v) for k, s in enumerate(states) for f, v in s.items()], "file STRING, ord INT, n INT, state STRING")
    expected = []
    for k, (a, b) in enumerate(zip([{}, *states], states)):
        expected += [(f, k, "added" if f not in a else "removed" if f not in b else "changed") for f in {*a, *b} if f not in a or f not in b or a[f] != b[f]]
    got = [(r.file, r.seq, r.change) for r in snapshots.deltas(df, ["file"], ["state"]).collect()]
    assert sorted(got) == sorted(expected)
