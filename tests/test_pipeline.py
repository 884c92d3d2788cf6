"""State files, the store of snapshots, repeated analysis, changes of single symbols."""

import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from symbolarium.functions import ranking
from symbolarium.operators import analysis, graph, reports, score, snapshots
from symbolarium.sources import files as source_files
from symbolarium.sources import git, states, store

T0, T1 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_state_file_layout_and_types(spark, tmp_path):
    s = spark.createDataFrame([("p", "a|b\nc", "f.go", 3, 2.999821, 0.876, "2025-01-02 03:04:05", "extra")], "project STRING, name STRING, file STRING, line INT, instability DOUBLE, confidence DOUBLE, t STRING, x STRING").withColumn("touched", F.to_timestamp("t"))
    parts = {"state": spark.createDataFrame([("p", "1.0", T0), ("q", "1.0", T0)], "project STRING, version STRING, updated_at TIMESTAMP_NTZ"), "symbols": s, "files": spark.createDataFrame([("p", "f.go", "go", T0, 2, "x,y")], "project STRING, path STRING, lang STRING, modified TIMESTAMP_NTZ, churn INT, symbols STRING")}
    path = str(tmp_path / "states")
    states.write(states.lines(parts), path, compression="none")
    text = next((tmp_path / "states" / "project=p").glob("part*.txt")).read_text().split("\n")
    assert text[:3] == ["# state", "version|updated_at", "1.0|2025-01-01T00:00:00Z"] and text[3] == "# symbols"
    found = states.read(spark, path)
    r = states.table(found, "symbols").head()
    assert (r.name, r.file, r.line, r.end_line, r.instability, r.confidence, r.called, r.state) == ("a|b\nc", "f.go", 3, 0, 2.999821, 0.88, False, "")
    assert r.touched is not None and states.table(found, "symbols").count() == 1
    assert rows(states.table(found, "files").select("project", "path", "churn", "symbols")) == [("p", "f.go", 2, "x,y")]
    assert sorted(r.project for r in states.table(found, "state").collect()) == ["p", "q"] and states.table(found, "todos").count() == 0


def test_bad_numbers_and_other_columns(spark):
    lines = ["# symbols", "other|name|line|called", "z|n|x|true", "z|m|7|maybe", "z"]
    numbered = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "document STRING, line_no INT, line STRING")
    got = states.table(states.sections(numbered).withColumnRenamed("document", "project"), "symbols").select("name", "line", "called", "file")
    assert rows(got) == [("", 0, False, ""), ("m", 7, False, ""), ("n", 0, True, "")]


def test_intent_files(spark, tmp_path):
    (tmp_path / "i.txt").write_text("# note\nid|sev|type|status|msg\na|3|fixme|active|x \\| y\nb|no|todo|closed|\n")
    (tmp_path / "bad.txt").write_text("id|type\na|b\n")
    (tmp_path / "i.json").write_text(json.dumps({"intents": [{"id": "j", "type": "todo", "severity": 2, "status": "active", "message": "m", "tags": ["u", "v"]}]}))
    got = states.read_intents(spark, str(tmp_path / "i.txt"))
    assert rows(got.select("id", "sev", "msg", "scope")) == [("a", 3, "x | y", ""), ("b", 0, "", "")]
    other = states.read_intents(spark, str(tmp_path / "none.txt"), str(tmp_path / "i.json")).head()
    assert (other.id, other.sev, other.msg, other.tags) == ("j", 2, "m", "u,v")
    assert states.read_intents(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(ValueError, match="sev"):
        states.read_intents(spark, str(tmp_path / "bad.txt"))


@pytest.mark.parametrize("every", [1, 3, 10])
def test_any_snapshot_is_rebuilt(spark, tmp_path, every):
    kept = {("p", k): {f"n{i}": (i * k) % 4 for i in range(8) if (i + k) % 3} for k in range(7)} | {("q", 0): {"x": 1}}
    n = {"p": 7, "q": 1}
    new = spark.createDataFrame([(p, f"{p}{k:02x}", k) for p, k in kept], "project STRING, hash STRING, at LONG")
    entries = spark.createDataFrame([(p, k, n[p], i, v) for (p, k), items in kept.items() for i, v in items.items()], "project STRING, ord INT, n INT, item STRING, v INT")
    root = str(tmp_path)
    assert store.headers(spark, root).count() == 0
    assert store.save(new, entries, root, ["item"], ["v"], every) == 8
    assert store.save(new, entries, root, ["item"], ["v"], every) == 0  # all are there
    asked = spark.createDataFrame([("p03",), ("p06",), ("q00",), ("zz",)], "hash STRING")
    assert rows(store.load(spark, root, asked, ["item"]).select("target", "item", "v")) == sorted((f"{p}{k:02x}", i, v) for (p, k), items in kept.items() if (p, k) in {("p", 3), ("p", 6), ("q", 0)} for i, v in items.items())
    store.refer(new.select("project", F.lit("latest").alias("ref"), "hash", "at"), root)
    store.refer(spark.createDataFrame([("p", "c0ffee", "p02", 2)], "project STRING, ref STRING, hash STRING, at LONG"), root)
    assert rows(store.referred(spark, root)) == [("p", "c0ffee", "p02"), ("p", "latest", "p06"), ("q", "latest", "q00")]


GO = "package a\nfunc One() {\n\tTwo()\n}\n"


def test_second_analysis_reads_only_what_changed(spark):
    schema = "path STRING, content STRING, mtime TIMESTAMP"
    first = [("a.go", GO, T0), ("b.py", "def b():\n", T0), ("gone.py", "def g():\n", T0)]
    empty = spark.createDataFrame([], analysis.MANIFEST)
    none = analysis.extract.facts(spark.createDataFrame([], schema), ["path"])
    facts, manifest, changed = analysis.analysed(spark.createDataFrame(first, schema), empty, none, ["path"])
    assert changed.count() == 3 and rows(manifest.select("path", "version")) == [(p, analysis.VERSION) for p in ("a.go", "b.py", "gone.py")]
    kept = spark.createDataFrame([r if r.path != "a.go" else type(r)(*[("Cached" if c == "name" and r.name == "One" else r[c]) for c in facts.columns]) for r in facts.collect()], facts.schema)
    again = [("a.go", GO, T0), ("b.py", "def b():\n", T1), ("new.py", "def n():\n", T1)]
    facts2, manifest2, changed2 = analysis.analysed(spark.createDataFrame(again, schema), spark.createDataFrame(manifest.collect(), manifest.schema), kept, ["path"])
    assert rows(changed2) == [("b.py",), ("new.py",)] and sorted(r.path for r in manifest2.collect()) == ["a.go", "b.py", "new.py"]
    names = {(r.path, r.name) for r in facts2.filter("type = 'function_defined'").collect()}
    assert names == {("a.go", "Cached"), ("b.py", "b"), ("new.py", "n")}  # a.go wasn't read, gone.py is gone
    other = analysis.analysed(spark.createDataFrame(again, schema), manifest2.withColumn("version", F.lit("1")), kept, ["path"])
    assert other[2].count() == 3  # of another version


def test_symbols_and_their_history(spark):
    facts = analysis.extract.facts(spark.createDataFrame([("a.go", GO + "func One() {}\n"), ("b.py", "def b():\ndef c():\n")], "path STRING, content STRING"), ["path"])
    s = analysis.symbols_of(facts, ["path"])
    assert rows(s.select("path", "name", "line", "end_line", "signal_source")) == [("a.go", "One", 2, 4, "ast"), ("b.py", "b", 1, 0, "lexical"), ("b.py", "c", 2, 0, "lexical")]
    history = "path STRING, name STRING, churn_count INT, last_touched TIMESTAMP"
    before = spark.createDataFrame([("a.go", "One", 5, T0), ("b.py", "b", 6, T0)], history)
    fresh = spark.createDataFrame([("a.go", "One", 1, T1), ("b.py", "b", 2, T1)], history)
    changed = spark.createDataFrame([("b.py",)], "path STRING")
    got = {r.name: (r.churn_count, r.last_touched) for r in analysis.with_history(s, before, changed, fresh, ["path"]).collect()}
    assert got == {"One": (5, T0), "b": (2, T1), "c": (0, None)}
    by = facts.withColumn("project", F.col("path"))
    known = analysis.fingerprint_of(by, ["project"])
    assert rows(analysis.same_facts(by, known, ["project"])) == [("a.go",), ("b.py",)]
    assert rows(analysis.same_facts(by.filter("name <> 'c'"), known, ["project"])) == [("a.go",)]


def test_commits_of_symbols(spark, tmp_path):
    me = ["-c", "user.name=me", "-c", "user.email=me@here", "-c", "commit.gpgsign=false"]

    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), *me, *args], check=True, capture_output=True)

    run("init", "-q")
    body = [f"line {k}" for k in range(1, 31)]
    for message, change in (("new", None), ("five", 5), ("twenty", 20)):
        if change:
            body[change - 1] = message
        (tmp_path / "a.txt").write_text("\n".join(body) + "\n")
        run("add", "-A")
        run("commit", "-q", "-m", message)
    found = git.hunks(spark, str(tmp_path)).withColumn("project", F.lit("p"))
    assert sorted((r.start, r.length, r.changed, r.is_new) for r in found.collect()) == [(1, 30, 30, True), (5, 1, 2, False), (20, 1, 2, False)]
    symbols = spark.createDataFrame([("p", "a.txt", "early", 4, 8), ("p", "a.txt", "late", 18, 2_000_000_000), ("p", "a.txt", "none", 9, 9), ("p", "a.txt", "open", 3, 0)], "project STRING, file STRING, name STRING, line INT, end_line INT")
    got = score.symbol_commits(symbols, found, ["project", "file"]).collect()
    assert sorted((r.name, r.size) for r in got) == [("early", 2), ("early", 5), ("late", 2), ("late", 10), ("none", 1)]
    touched = score.churn(score.symbol_commits(symbols, found, ["project", "file"]), ["project", "file", "name"])
    assert {r.name: r.churn_count for r in touched.collect()} == {"early": 2, "late": 2, "none": 1}


def test_places_of_large_groups(spark):
    df = spark.createDataFrame([("g" if k % 4 else None, (k * 37) % 101) for k in range(300)], "g STRING, v INT").withColumn("id", F.monotonically_increasing_id())
    got = ranking.placed(df, ["g"], [F.col("v").desc(), F.col("id")]).collect()
    for g in ("g", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda r: (-r.v, r.id))
    assert ranking.placed(df.filter("v > 1000"), ["g"], [F.col("v")]).count() == 0
    first = ranking.first_overall(df, [F.col("v"), F.col("id")], 4).collect()
    assert [r.v for r in first] == sorted(k * 37 % 101 for k in range(300))[:4] and {r.more for r in first} == {296}


def test_views_and_sections(spark, tmp_path):
    s = spark.createDataFrame([("a", "unused"), ("b", None), ("c", "active")], "name STRING, state STRING")
    assert [r.name for r in reports.without_states(s, ["unused"]).collect()] == ["b", "c"] and reports.without_states(s, []).count() == 3
    assert [r.name for r in reports.log_view(s, ["ACTIVE "]).collect()] == ["c"]
    with pytest.raises(ValueError, match="odd"):
        reports.log_view(s, ["odd"])
    (tmp_path / "c.json").write_text('{"version": "1", "project_name": "n", "include": ["*.go"]}')
    config = source_files.config(spark, str(tmp_path / "c.json"))
    assert [(r.place, r.section, r.value) for r in source_files.chosen_sections(config, ["include", "version"]).collect()] == [(0, "include", '["*.go"]'), (1, "version", "1")]
    with pytest.raises(ValueError):
        source_files.chosen_sections(config, ["nothing"])


def test_graph_lookups_and_exports(spark):
    nodes = spark.createDataFrame([("p", "symbol:f::a", "symbol", "a", {"file": "f", "line": "12", "state": "active"}), ("p", "file:f", "file", "f", {"path": "f"})], "project STRING, id STRING, type STRING, label STRING, attrs MAP<STRING,STRING>")
    edges = spark.createDataFrame([("p", "CONTAINS", "file:f", "symbol:f::a", 1.0)], "project STRING, type STRING, src STRING, dst STRING, weight DOUBLE")
    assert graph.symbols_named(nodes, spark.createDataFrame([("p", "a")], "project STRING, label STRING")).count() == 1
    assert graph.symbols_in(nodes, spark.createDataFrame([("p", "f")], "project STRING, file STRING")).count() == 1
    node = {r.id: json.loads(r.json) for r in graph.json_nodes(nodes, edges).collect()}
    assert node["symbol:f::a"]["degree"] == 1 and node["symbol:f::a"]["state"] == "active" and node["file:f"]["file"] == "f"
    assert json.loads(graph.json_links(edges).head().json) == {"source": "file:f", "target": "symbol:f::a", "type": "CONTAINS", "weight": 1.0}
    text = graph.exported_nodes(nodes, edges).filter("type = 'symbol'").head().attrs
    back = spark.createDataFrame([(text,)], "t STRING").select(graph.parsed_attrs(F.col("t")).alias("a")).select("a", graph.whole_attr(F.col("a"), "line").alias("n"), graph.whole_attr(F.col("a"), "state").alias("x")).head()
    assert back.a == {"file": "f", "line": "12", "state": "active"} and back.n == 12 and back.x is None
    assert snapshots.chains_of(spark.createDataFrame([], "project STRING, hash STRING, seq INT, is_checkpoint BOOLEAN"), spark.createDataFrame([("x",)], "hash STRING")).count() == 0
