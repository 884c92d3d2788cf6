"""Plans over snapshots that differ only in confidence, score or todos."""

import datetime as dt

import pytest

from symbolarium.plans import reference

T = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("states"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")

    put("project_states", [("p", h, T + dt.timedelta(days=k)) for k, h in enumerate("abcd")], "project STRING, snapshot_hash STRING, updated_at TIMESTAMP")
    values = {"a": (0.5, 1.0), "b": (0.6, 1.0), "c": (0.6, 2.0), "d": (0.6, 2.0)}
    symbols = [("p", h, "f.go", "F", "active", c, 3, s, T) for h, (c, s) in values.items()]
    put("symbols", symbols, "project STRING, snapshot_hash STRING, file STRING, name STRING, state STRING, confidence DOUBLE, churn_count INT, instability_score DOUBLE, delivered_at TIMESTAMP")
    todos = [("p", h, "f.go", line, "t", "TODO", False, T) for h, line in [("a", 1), ("b", 1), ("c", 1), ("d", 2)]]
    put("todos", todos, "project STRING, snapshot_hash STRING, file STRING, line INT, text STRING, type STRING, resolved BOOLEAN, delivered_at TIMESTAMP")
    return at


def test_all_values_and_todos_count(spark, root):
    got = {(r.kind, r.change, r.n) for r in reference.snapshot_diff_whole(spark, root).collect()}
    assert got == {("symbol", "changed", 1), ("todo", "added", 1), ("todo", "removed", 1)}


@pytest.mark.parametrize("query", [reference.snapshot_apply_whole, reference.delta_chain_whole])
def test_rebuilt_whole(spark, root, query):
    got = {(r.kind, r.item, r.state, r.confidence, r.churn_count, r.instability_score) for r in query(spark, root).collect()}
    assert got == {("symbol", "F", "active", 0.6, 3, 2.0), ("todo", "2", None, None, None, None)}


@pytest.mark.parametrize(("query", "columns"), [(reference.fingerprint, ("mixed", "total")), (reference.content_hash, ("hash",))])
def test_hashes_differ(spark, root, query, columns):
    assert len({tuple(r[c] for c in columns) for r in query(spark, root).collect()}) == 4
