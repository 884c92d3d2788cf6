import random

import pytest

from symbolarium.operators import graph

EDGE = "project STRING, type STRING, src STRING, dst STRING, weight DOUBLE"
SYMBOL = "project STRING, file STRING, name STRING, state STRING, line INT, end_line INT"


@pytest.fixture(scope="module")
def project(spark):
    symbols = spark.createDataFrame(
        [("p", "internal/auth/login.go", "Login", "active", 10, 30), ("p", "internal/auth/token.go", "Validate", "active", 5, 20), ("p", "internal/store/store.go", "Save", "unused", 1, 9), ("p", "internal/store/alt.go", "Save", "unused", 1, 9)],
        SYMBOL,
    )
    return symbols, symbols.select("project", "file").distinct()


def test_symbol_and_todo_parts(spark, project):
    symbols, _ = project
    todos = spark.createDataFrame([("p", "internal/auth/login.go", 15, "fix it", "TODO", False), ("p", "internal/auth/login.go", 40, "done", "TODO", True)], "project STRING, file STRING, line INT, text STRING, type STRING, resolved BOOLEAN")
    n, e = graph.todo_part(symbols, todos)
    assert [r.id for r in n.collect()] == ["todo:internal/auth/login.go:15"]
    assert sorted(r.src for r in e.collect()) == ["file:internal/auth/login.go", "symbol:internal/auth/login.go::Login"]
    n, e = graph.symbol_part(symbols)
    assert n.count() == 8 and e.count() == 8


def test_calls_split_among_names(spark, project):
    calls = spark.createDataFrame([("p", "internal/auth/login.go", 12, "Validate", 1.0), ("p", "internal/auth/login.go", 13, "Save", 0.8), ("p", "internal/auth/login.go", 99, "Save", 0.8)], "project STRING, file STRING, line INT, name STRING, confidence DOUBLE")
    e = {(r.src, r.dst): r.weight for r in graph.call_part(project[0], calls).collect()}
    assert e == {(f"symbol:internal/auth/login.go::{a}", f"symbol:{b}"): w for a, b, w in [("Login", "internal/auth/token.go::Validate", 1.0), ("Login", "internal/store/store.go::Save", 0.4), ("Login", "internal/store/alt.go::Save", 0.4)]}


def test_merging(spark):
    rows = [("p", "CALLS", "a", "b", 0.5, ""), ("p", "CALLS", "a", "b", 0.9, "x"), ("p", "CALLS", "b", "a", 0.1, "")]
    got = {(r.src, r.dst): (r.weight, r.evidence, r.occurrences) for r in graph.merged_edges(spark.createDataFrame(rows, EDGE + ", evidence STRING")).collect()}
    assert got == {("a", "b"): (0.9, "x", 2), ("b", "a"): (0.1, None, 1)}


@pytest.mark.parametrize(("imp", "expected"), [
    ("example.com/mod/internal/store", "internal/store/alt.go"), ("./token", "internal/auth/token.go"), ("../store/store", "internal/store/store.go"), ("../store", "internal/store/alt.go"), ("fmt", None), ("store", "internal/store/store.go"),
    ("'./token'", "internal/auth/token.go"), ("../../../x", None), ("/abs/path", None),
])
def test_imports(spark, project, imp, expected):
    df = spark.createDataFrame([("p", "internal/auth/login.go", imp)], "project STRING, file STRING, name STRING")
    assert [r.dst for r in graph.resolved_imports(df, project[1]).collect()] == [expected]


def test_tests(spark, project):
    symbols, files = project
    defs = spark.createDataFrame([("p", "internal/auth/login_test.go", "TestValidate"), ("p", "internal/auth/login.go", "TestSave")], "project STRING, file STRING, name STRING")
    imports = spark.createDataFrame([("p", "internal/auth/login_test.go", "x/store", "internal/store/store.go")], "project STRING, src STRING, import STRING, dst STRING")
    _, e = graph.test_part(symbols, defs, imports)
    assert {(r.dst.split("::")[1], r.weight) for r in e.collect()} == {("Login", 0.9), ("Validate", 0.9), ("Save", 0.6)}


def test_scopes_and_guardrails(spark, project):
    scopes = spark.createDataFrame([("p", "1", "internal/auth/*"), ("p", "2", "./internal/auth/login.go:10-20"), ("p", "3", "project"), ("p", "4", ""), ("p", "5", None), ("p", "6", "internal/*")], "project STRING, id STRING, scope STRING")
    assert sorted((r.id, r.file[14:]) for r in graph.scope_matches(scopes, project[1]).collect()) == [("1", "login.go"), ("1", "token.go"), ("2", "login.go")]
    rails = spark.createDataFrame([("p", "all", [], None), ("p", "auth", ["internal/auth/**"], "r")], "project STRING, id STRING, paths ARRAY<STRING>, reason STRING")
    _, e = graph.guardrail_part(rails, project[1])
    assert e.groupBy("src").count().orderBy("src").collect() == [("guardrail:all", 4), ("guardrail:auth", 2)]


def brute_radius(edges, seed, depth):
    """The queue: each node expanded once, in the order it was reached."""
    steps = {}
    for _, t, a, b, w in edges:
        steps.setdefault(a, []).append((0, t, b, w))
        if t in graph.BACKWARDS:
            steps.setdefault(b, []).append((1, t, a, w))
    queue, seen, total, far = [(seed, 1.0, 0)], {seed}, {}, {}
    for node, first, d in queue:
        if d == depth:
            continue
        for _, _, to, w in sorted(steps.get(node, [])):
            if to != seed:
                total[to] = total.get(to, 0) + first * w
                far.setdefault(to, d + 1)
            if to not in seen:
                seen.add(to)
                queue.append((to, first * w, d + 1))
    return {k: (round(v, 9), far[k]) for k, v in total.items()}


@pytest.mark.parametrize("seed", range(3))
def test_blast_radius_same_as_queue(spark, seed):
    rng = random.Random(seed)
    edges = sorted({("p", rng.choice(["CALLS", "CONTAINS", "TESTS"]), f"n{rng.randrange(9)}", f"n{rng.randrange(9)}"): rng.choice([1.0, 0.9, 0.6]) for _ in range(18)}.items())
    edges = [(*k, w) for k, w in edges]
    df = spark.createDataFrame(edges, EDGE)
    got = graph.blast_radius(df, spark.createDataFrame([("p", "n0"), ("p", "n1")], "project STRING, seed STRING"), 3).collect()
    for s in ("n0", "n1"):
        assert {r.id: (round(r.score, 9), r.depth) for r in got if r.seed == s} == brute_radius(edges, s, 3)


def test_shortest_paths(spark):
    df = spark.createDataFrame([("p", "X", a, b, 1.0) for a, b in [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "a")]], EDGE)
    pairs = spark.createDataFrame([("p", "a", "e"), ("p", "a", "a"), ("p", "e", "zzz"), ("p", "c", "b")], "project STRING, src STRING, dst STRING")
    assert {(r.src, r.dst): r.path for r in graph.shortest_paths(df, pairs).collect()} == {("a", "e"): ["a", "b", "c", "e"], ("a", "a"): ["a"], ("c", "b"): ["c", "e", "a", "b"]}


def test_lookup_and_trace(spark, project):
    n, e = graph.symbol_part(project[0])
    assert graph.resolve(n, "Login", "p") == "symbol:internal/auth/login.go::Login"
    assert graph.resolve(n, "Save@internal/store/alt.go", "p") == "symbol:internal/store/alt.go::Save"
    assert graph.resolve(n, "internal/store/alt.go", "p") == "file:internal/store/alt.go"
    for bad in ("Save", "Nothing"):
        with pytest.raises(LookupError):
            graph.resolve(n, bad, "p")
    ids = spark.createDataFrame([("p", "file:internal/auth/login.go")], "project STRING, id STRING")
    assert [r.role for r in graph.trace(e, ids).collect()] == ["contains"]
    assert graph.scope(n, "internal/auth/**").count() == 2
    assert graph.visible_links(n.filter("type = 'file'"), e).count() == 0
    assert {r.degree for r in graph.exported_nodes(n, e).collect()} == {2}
