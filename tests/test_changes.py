from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from symbolarium.operators import changes, current

ROW = "snapshot_hash STRING, kind STRING, file STRING, item STRING, attr LONG, delivered_at TIMESTAMP"
STATE = "project STRING, snapshot_hash STRING, updated_at TIMESTAMP, n INT"


def day(n):
    return datetime(2025, 1, 1 + n)


def states(spark, rows):
    return current.snapshots(spark.createDataFrame([(p, h, day(d), 7) for p, h, d in rows], STATE).withColumnRenamed("n", "ord"))


def run(spark, rows, snaps, **more):
    found = changes.snapshot_changes(spark.createDataFrame(rows, ROW), snaps, **more)
    return sorted(map(tuple, found.collect()), key=str)


def brute(rows, order):
    """Differences of consecutive snapshots, by dictionaries; the row delivered last of each key counts."""
    tables = {h: {} for _, h, _ in order}
    for h, kind, file, item, attr, at in sorted(rows, key=lambda r: r[5]):
        if h in tables:
            tables[h][kind, file, item] = attr
    out = []
    for p in {p for p, _, _ in order}:
        hashes = [h for _, h, _ in sorted((x for x in order if x[0] == p), key=lambda x: x[2])]
        for a, b in zip(hashes, hashes[1:]):
            for k in {*tables[a], *tables[b]}:
                if k not in tables[a]:
                    out.append((b, *k, "added"))
                elif k not in tables[b]:
                    out.append((b, *k, "removed"))
                elif tables[a][k] != tables[b][k]:
                    out.append((b, *k, "changed"))
    return sorted(out, key=str)


ORDER = [("p", "a", 0), ("p", "b", 1), ("p", "c", 2), ("q", "d", 5), ("q", "e", 6)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcde?"), st.sampled_from(["symbol", "todo"]), st.sampled_from(["f", "g", None]), st.sampled_from([*"uvwxyz", None, ""]), st.integers(0, 2)), max_size=60))
def test_same_as_dictionaries(spark, cases):
    rows = [(h, k, f, i, a, datetime(2025, 2, 1, 0, 0, n)) for n, (h, k, f, i, a) in enumerate(cases)]
    assert run(spark, rows, states(spark, ORDER)) == brute(rows, ORDER)


@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_chunk_size_does_not_matter(spark, chunk_rows):
    rows = [(h, "symbol", f"f{i % 7}", f"n{i}", (i * k) % 3, day(0)) for k, h in enumerate("abc") for i in range(300) if (i + k) % 10]
    assert run(spark, rows, states(spark, ORDER), chunk_rows=chunk_rows) == brute(rows, ORDER)


def test_snapshot_without_rows_is_empty(spark):
    rows = [("a", "symbol", "f", "x", 1, day(0)), ("c", "symbol", "f", "x", 1, day(0))]
    assert run(spark, rows, states(spark, ORDER)) == [("b", "symbol", "f", "x", "removed"), ("c", "symbol", "f", "x", "added")]


def test_row_delivered_last_counts(spark):
    rows = [("a", "symbol", "f", "x", 1, day(0)), ("b", "symbol", "f", "x", 2, day(0)), ("b", "symbol", "f", "x", 1, day(1)), ("b", "symbol", "f", "x", 1, day(1))]
    assert run(spark, rows, states(spark, ORDER[:2])) == []


def test_empty_tables_and_nulls(spark):
    assert run(spark, [], states(spark, ORDER)) == []
    assert run(spark, [("a", "symbol", "f", "x", 1, day(0))], states(spark, [])) == []
    assert run(spark, [(None, None, None, None, None, None), ("b", None, None, None, None, None)], states(spark, ORDER[:2])) == [("b", None, None, None, "added")]


def test_null_and_nan_are_equal_to_themselves(spark):
    sym = "snapshot_hash STRING, file STRING, name STRING, state STRING, confidence DOUBLE, churn_count INT, instability_score DOUBLE, delivered_at TIMESTAMP, attr STRING"
    nan = float("nan")
    rows = [("A", ".\\f", "x", " Active", None, None, nan, day(0), "extra"), ("b", "f", "x", "active\t", None, None, nan, day(0), "extra"), ("c", "f", "x", None, None, 0, nan, day(0), "e")]
    todo = spark.createDataFrame([], "snapshot_hash STRING, file STRING, line INT, delivered_at TIMESTAMP")
    found = changes.snapshot_changes(changes.symbol_and_todo_rows(spark.createDataFrame(rows, sym), todo), states(spark, ORDER[:3]))
    assert [tuple(r) for r in found.collect()] == [("c", "symbol", "f", "x", "changed")]
