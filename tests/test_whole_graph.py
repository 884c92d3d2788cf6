"""Queries over the whole graph against plain Python on its edges."""

import datetime as dt
from collections import Counter

import pytest
from test_graph import brute_radius

from symbolarium.operators import graph
from symbolarium.plans import reference

T = dt.datetime(2025, 1, 1)
GO = {
    "a/one.go": 'package a\nimport "fmt"\nimport "m/b"\nfunc One() {\n\tTwo()\n}\n',
    "b/two.go": "package b\nfunc Two() {\n\tOne()\n}\n",
    "b/two_test.go": "package b\nfunc TestTwo() {\n\tTwo()\n}\n",
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")

    put("project_states", [("p", "aa", T)], "project STRING, snapshot_hash STRING, updated_at TIMESTAMP")
    names = [("a/one.go", "One", 4, 6), ("b/two.go", "Two", 2, 4), *[("c/more.go", f"M{k}", 10 * k + 1, 10 * k + 9) for k in range(120)]]
    put(
        "symbols", [("p", "aa", f, n, a, b, "func", "go", "active", 1.0, True, False, T, 1, 1.0, None, "git", T) for f, n, a, b in names],
        "project STRING, snapshot_hash STRING, file STRING, name STRING, line INT, end_line INT, type STRING, language STRING, state STRING, confidence DOUBLE, is_called BOOLEAN, has_todo BOOLEAN,"
        "last_touched TIMESTAMP, churn_count INT, instability_score DOUBLE, intent_marker STRING, signal_source STRING, delivered_at TIMESTAMP",
    )
    put("todos", [("p", "aa", "b/two.go", 3, "cache parser tokens", "TODO", False, T)], "project STRING, snapshot_hash STRING, file STRING, line INT, text STRING, type STRING, resolved BOOLEAN, delivered_at TIMESTAMP")
    put(
        "intent_updates", [("p", i, "fix", m, "a/one.go", T, 2, "active", [], T) for i, m in [("1", "cache parser slow"), ("2", "rename window")]],
        "project STRING, id STRING, type STRING, message STRING, scope STRING, updated_at TIMESTAMP, severity INT, status STRING, tags ARRAY<STRING>, delivered_at TIMESTAMP",
    )
    put("documents", [(k, x, "source_file", "p", f) for k, (f, x) in enumerate(GO.items())], "doc_id BIGINT, text STRING, source STRING, project STRING, file STRING")
    put("commit_files", [("p", f"h{k}", f, T) for k in range(4) for f in ("a/one.go", "c/more.go")], "project STRING, hash STRING, file STRING, delivered_at TIMESTAMP")
    return at


@pytest.fixture(scope="module")
def whole(spark, root):
    n, e = reference.graph_parts(spark, root)
    return n.collect(), e.collect()


def chosen(spark, whole):
    rows = spark.createDataFrame([(r.project, r.id) for r in whole[0]], "project STRING, id STRING")
    return {r.id for r in reference._some_nodes(rows).collect()}


def test_all_relations_are_there(whole):
    assert {r.type for r in whole[1]} >= {"CALLS", "IMPORTS", "DEPENDS_ON", "TESTS", "RELATED_TO", "CO_CHANGES_WITH", "HAS_TODO", "SCOPE_MATCH"}
    assert {r.type for r in whole[0]} >= {"symbol", "file", "todo", "intent", "test", "dep", "snapshot", "guardrail"}


def test_blast_radius_whole(spark, root, whole):
    edges = [("p", r.type, r.src, r.dst, r.weight) for r in whole[1]]
    got = {}
    for r in reference.blast_radius_whole(spark, root).collect():
        got.setdefault(r.seed, {})[r.id] = (r.score, r.depth)
    expected = {s: {k: (round(v, 6), d) for k, (v, d) in brute_radius(edges, s, 3).items()} for s in chosen(spark, whole)}
    assert {s: {k: d for k, (_, d) in x.items()} for s, x in got.items()} == {s: {k: d for k, (_, d) in x.items()} for s, x in expected.items() if x}
    assert all(abs(v - expected[s][k][0]) < 2e-6 for s, x in got.items() for k, (v, _) in x.items())
    assert any(d == 3 for x in got.values() for _, d in x.values()) and any(s.startswith("symbol:") for s in got)


def test_trace_whole(spark, root, whole):
    ids = chosen(spark, whole)
    edges = spark.createDataFrame([(r.project, r.type, r.src, r.dst, r.weight) for r in whole[1] if r.src in ids or r.dst in ids], "project STRING, type STRING, src STRING, dst STRING, weight DOUBLE")
    got = reference.trace_node_whole(spark, root).collect()
    assert {(r.id, r.type, r.src, r.dst) for r in got} <= {(i, r.type, r.src, r.dst) for r in whole[1] for i in (r.src, r.dst) if i in ids}
    assert len(got) == graph.trace(edges, spark.createDataFrame([("p", i) for i in ids], "project STRING, id STRING")).count()


def test_edges_nodes_degrees_whole(spark, root, whole):
    nodes, edges = whole
    assert {(r.type, r.src, r.dst) for r in reference.graph_edges_whole(spark, root).collect()} == {(r.type, r.src, r.dst) for r in edges}
    assert {(r.id, r.type) for r in reference.graph_nodes_whole(spark, root).collect()} == {(r.id, r.type) for r in nodes}
    degree = Counter(i for r in edges for i in (r.src, r.dst))
    assert {r.id: r.degree for r in reference.node_degree_whole(spark, root).collect()} == degree
    assert {r.id: r.degree for r in reference.exported_nodes_whole(spark, root).collect()} == {r.id: degree[r.id] for r in nodes}
    assert {r.id for r in reference.exported_edges_whole(spark, root).collect()} == {f"{r.type}|{r.src}|{r.dst}" for r in edges}
    kept = {r.id for r in nodes if r.type in ("file", "todo")}
    links = {(r.type, r.src, r.dst) for r in reference.visible_links_whole(spark, root).collect()}
    assert links == {(r.type, r.src, r.dst) for r in edges if r.src in kept and r.dst in kept}
    assert {t for t, *_ in links} >= {"IMPORTS", "CO_CHANGES_WITH"}


def test_shortest_path_whole(spark, root, whole):
    steps = {}
    for r in whole[1]:
        steps.setdefault(r.src, set()).add(r.dst)
    for r in reference.shortest_path_whole(spark, root).collect():
        level, far = {r.src}, 0
        while r.dst not in level:
            level, far = {d for s in level for d in steps.get(s, ())}, far + 1
        assert r.src.startswith("intent:") and len(r.path) == far + 1
        assert all(b in steps[a] for a, b in zip(r.path, r.path[1:]))
