from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from symbolarium.operators import current, history

SYMBOL = "snapshot_hash STRING, file STRING, name STRING, state STRING, last_touched TIMESTAMP, delivered_at TIMESTAMP, attr INT, first INT"
INTENT = "project STRING, id STRING, updated_at TIMESTAMP_NTZ, status STRING, delivered_at TIMESTAMP_NTZ, at INT"
T0 = datetime(2025, 1, 1)


def at(n):
    return T0 + timedelta(seconds=n)


def epoch(n):
    return int((at(n) - datetime(1970, 1, 1)).total_seconds())


def snaps(spark, n):
    rows = [("p", f"h{k}", at(k * 10)) for k in range(n)]
    return current.snapshots(spark.createDataFrame(rows, "project STRING, snapshot_hash STRING, updated_at TIMESTAMP_NTZ"))


def versions(spark, seen, n):
    rows = [(f"h{k}", "f", name, state, None, at(0), 1, 1) for k, name, state in seen]
    return sorted((r.item, r.valid_from, r.valid_to) for r in history.symbol_versions(spark.createDataFrame(rows, SYMBOL), snaps(spark, n)).collect())


def brute(seen, n):
    table = {}
    for k, name, state in seen:
        table.setdefault(name, {})[k] = state
    out = []
    for name, by in table.items():
        k = 0
        while k < n:
            if k in by:
                e = k
                while e + 1 in by and by[e + 1] == by[k]:
                    e += 1
                out.append((f"f#{name}", epoch(k * 10), epoch((e + 1) * 10) if e + 1 < n else -1))
                k = e
            k += 1
    return sorted(out)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(0, 9), st.sampled_from("xyz")), st.sampled_from(["a", "b", None]), max_size=30))
def test_same_as_walking(spark, table):
    seen = [(k, name, state) for (k, name), state in table.items()]
    assert versions(spark, seen, 10) == brute(seen, 10)


def test_runs_across_words(spark):
    """More snapshots than a bitmap's word has bits; gaps and changes at and around the edges."""
    seen = [(k, "x", "a") for k in range(150) if k not in (63, 127)] + [(k, "y", "b" if k < 64 else "c") for k in range(150)] + [(64, "z", "a")]
    assert versions(spark, seen, 150) == brute(seen, 150)


def intents(spark, rows):
    df = spark.createDataFrame([("p", i, at(t), s, at(d), 0) for i, t, s, d in rows], INTENT)
    return sorted((r.item, r.valid_from, r.valid_to) for r in history.intent_versions(df).collect())


def test_intent_versions(spark):
    rows = [("i", 0, "active", 1), ("i", 5, " ACTIVE", 6), ("i", 9, None, 10), ("i", 10, "closed", 11), ("i", 10, "deferred", 12), ("i", 20, "active", 21), ("i", 20, "active", 21), ("j", 3, "\t ", 4)]
    assert intents(spark, rows) == [("i", epoch(0), epoch(10)), ("i", epoch(10), epoch(20)), ("i", epoch(20), -1)]


def test_many_updates(spark):
    rows = [("i", k, "ab"[k // 70 % 2], 0) for k in range(210)]
    assert intents(spark, rows) == [("i", epoch(0), epoch(70)), ("i", epoch(70), epoch(140)), ("i", epoch(140), -1)]


def test_empty_and_null(spark):
    assert versions(spark, [], 3) == []
    assert intents(spark, []) == []
    df = spark.createDataFrame([(None, None, None, None, None, None), (None, "i", at(0), "active", at(0), 1)], INTENT)
    assert history.intent_versions(df).count() == 0
    rows = spark.createDataFrame([("h0", None, None, None, None, None, 1, 1), (None,) * 8], SYMBOL)
    assert [r.item for r in history.symbol_versions(rows, snaps(spark, 1)).collect()] == ["#"]
