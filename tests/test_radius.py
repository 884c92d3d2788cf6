"""Blast radii of a file of many symbols: nothing that seeds reach is moved, and large projects give the same by joins."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from test_graph import EDGE, brute_radius

from symbolarium.operators import graph, radius


@pytest.fixture(scope="module")
def hub(spark):
    """A file of 60 symbols, some of which call others or have todos, in each of two projects."""
    edges = []
    for k in range(60):
        edges += [("DEFINED_IN", f"symbol:f::s{k}", "file:f", 1.0), ("CONTAINS", "file:f", f"symbol:f::s{k}", 1.0)]
        edges += [("CALLS", f"symbol:f::s{k}", f"symbol:f::s{k * 7 % 60}", 1 / (k % 5 + 1))] * (k % 3 == 0)
        edges += [("HAS_TODO", f"symbol:f::s{k}", f"todo:g{k % 4}:1", 0.35)] * (k % 4 == 0)
    edges += [("SCOPE_MATCH", f"intent:{k}", "file:f", 0.7) for k in range(3)] + [("RELATED_TO", "intent:0", "todo:g0:1", 0.4321875)]
    rows = [(p, *e) for p in ("p", "q") for e in sorted(set(edges))]
    held = spark.createDataFrame(rows, EDGE)
    seeds = [f"symbol:f::s{k}" for k in range(0, 60, 7)] + ["file:f", "intent:0", "nothing"]
    files = {i: i.split(":")[1] for r in rows for i in r[2:4] if not i.startswith("intent:")}
    nodes = [(p, i, {"path" if i.startswith("file:") else "file": files[i]} if i in files else {"status": "open"}) for p in ("p", "q") for i in sorted({i for r in rows for i in r[2:4]})]
    expected = {s: brute_radius([r for r in rows if r[0] == "p"], s, 3) for s in seeds}
    return (
        held, spark.createDataFrame(nodes, "project STRING, id STRING, attrs MAP<STRING, STRING>"), spark.createDataFrame([(p, s) for p in ("p", "q") for s in seeds], "project STRING, seed STRING"),
        {s: x for s, x in expected.items() if x}, files,
    )


@pytest.fixture(params=["packed", "cut", "joined"])
def way(request, monkeypatch):
    if request.param != "packed":
        monkeypatch.setattr(radius, *(("LARGEST", 1) if request.param == "joined" else ("SEEDS", 3)))
    return request.param


def test_same_as_queue(hub, way):
    edges, _, seeds, expected, _ = hub
    got = {}
    for r in graph.blast_radius(edges, seeds).collect():
        assert r.id not in got.setdefault((r.project, r.seed), {})
        got[r.project, r.seed][r.id] = (round(r.score, 9), r.depth)
    assert got == {(p, s): x for p in ("p", "q") for s, x in expected.items()}


def test_ordered(hub, way):
    edges, _, seeds, expected, _ = hub
    got = {}
    for r in graph.ordered_radius(edges, seeds).collect():
        got.setdefault((r.project, r.seed), {})[r.place] = r.id
    six = lambda v: Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    assert got == {(p, s): dict(enumerate(sorted(x, key=lambda i: (-six(x[i][0]), i)), 1)) for p in ("p", "q") for s, x in expected.items()}


def test_affected(hub, way):
    edges, nodes, seeds, expected, files = hub
    got = {(r.project, r.seed): (r.files, r.nodes) for r in graph.affected_files(edges, nodes, seeds).collect()}
    assert got == {(p, s): (len({files[i] for i in x if i in files}), len(x)) for p in ("p", "q") for s, x in expected.items()}


def test_nothing_reached_is_moved(hub):
    edges, nodes, seeds, _, _ = hub
    for found in (graph.blast_radius(edges, seeds, digits=6), graph.ordered_radius(edges, seeds), graph.affected_files(edges, nodes, seeds)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.startswith("MapInArrow"), plan


def test_rounded_as_sql(spark):
    values = [0.0, 0.0000005, 0.1234565, 0.0078125, 1.0000005, 2.5, 123456.7890125, 1e13, 0.7 * 0.375, 1 / 3, float("inf")]
    expected = [r.x for r in spark.createDataFrame([(v,) for v in values], "v DOUBLE").selectExpr("round(v, 6) AS x").collect()]
    assert radius.rounded(np.array(values), 6).tolist() == expected
