import pytest
from pyspark.sql import functions as F

from symbolarium.operators import extract
from symbolarium.sources import files as source_files

FILES = "path STRING, content STRING, language STRING"


def lined(spark, path, content):
    df = spark.createDataFrame([(path, content)], "path STRING, content STRING")
    return extract.lines(df.withColumn("language", extract.language_of(F.col("path"), F.substring_index("content", "\n", 1))))


CASES = [
    ("a.go", "func main() {\nfunc (s *T) Run(x int) {\nreturn f()\n", ["main", "Run"]),
    ("a.py", "def greet(name):\nasync def fetch_data(u):\nclass X:\nif x(1):\n", ["greet", "fetch_data"]),
    ("a.ts", "export default async function load(x) {\nconst save = async (y) => 1\nlet n = 3\n", ["load", "save"]),
    ("a.rs", "pub async fn compute<T>(x: T) {\npub struct Point {\npub const MAX: u8 = 1;\n", ["compute", "Point", "MAX"]),
    ("a.java", "public static int add(int a) {\nreturn add(1);\n", ["add"]),
    ("a.rb", "def empty?\ndef save!(x)\n", ["empty?", "save!"]),
    ("a.c", "int main(int argc) {\nreturn f(1);\n", ["main"]),
    ("a.sh", "deploy() {\nfunction build() {\n", ["deploy", "build"]),
    ("a.ex", "def run(x) do\ndefp hidden?(y)\n", ["run", "hidden?"]),
    ("a.sql", "create or replace function total(x int)\n", ["total"]),
    ("a.tf", 'resource "aws_s3" "logs" {\nmodule "net" {\n', ["logs", "net"]),
    ("a.lua", "local function go(x)\nstep = function(y)\n", ["go", "step"]),
    ("a.clj", "(defn add-all [x]\n", ["add-all"]),
    ("a.kt", "override suspend fun load(x: Int) {\n", ["load"]),
    ("a.php", "public function show($x) {\n", ["show"]),
    ("a.R", "mean2 <- function(x) {\n", ["mean2"]),
    ("a.unknown", "func main() {\n", []),
]


@pytest.mark.parametrize(("path", "content", "expected"), CASES)
def test_definitions(spark, path, content, expected):
    found = extract.definitions(lined(spark, path, content)).orderBy("line_no").collect()
    assert [r.name for r in found] == expected


@pytest.mark.parametrize(("path", "content", "expected"), [
    ("a.py", "def greet(x):\nfetch_data(process(1)) + fetch_data(2)\n# comment(1)\nif (x):\n", ["fetch_data", "process"]),
    ("a.js", "render(greet(x));\n  // skip(1)\nfunction own(y) {\n", ["greet", "render"]),
    ("a.rs", "x.to_string(); save(compute(1))\n", ["compute", "save", "to_string"]),
])
def test_calls(spark, path, content, expected):
    assert sorted(r.name for r in extract.calls(lined(spark, path, content)).collect()) == expected


def test_todos_only_in_comments(spark):
    content = '// TODO: first\nconst s = "TODO: not one";\n  // fixme: second\n* HACK:  third \n/* NOTE: fourth\nx(); // TODO: behind code\n//TODO without colon'
    found = extract.todos(lined(spark, "a.js", content)).orderBy("line_no").collect()
    assert [(r.line_no, r.type, r.text) for r in found] == [(1, "TODO", "first"), (3, "FIXME", "second"), (4, "HACK", "third"), (5, "NOTE", "fourth")]


@pytest.mark.parametrize(("path", "first", "expected"), [
    ("run", "#!/usr/bin/env python3", "python"), ("run", "#!/usr/bin/python", "python"), ("run", "#!/usr/bin/env node", "javascript"), ("run", "#!/bin/bash", "shell"),
    ("run", "#!/usr/bin/ruby -w", "ruby"), ("run", "#! /usr/bin/perl", "perl"), ("run", "print", None), ("run", "#!", None), ("A.PY", "", "python"), ("a.py", "#!/bin/sh", "python"), ("x", None, None),
])
def test_languages(spark, path, first, expected):
    df = spark.createDataFrame([(path, first)], "p STRING, f STRING")
    assert df.select(extract.language_of(F.col("p"), F.col("f")).alias("r")).head().r == expected


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc", "x"), (2, "", "x"), (3, None, "x"), (4, "y" * 200_000, "x")], "id INT, content STRING, line_no STRING").drop("line_no")
    rows = extract.lines(df).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("line")).alias("m")).collect()
    assert {r.id: (r.n, r.m) for r in rows} == {1: (4, 1), 2: (1, 0), 4: (1, 200_000)}


def test_ignore_markers(spark):
    go = "// @ignore-unused\nfunc helper(x int) {\n  if x {\n  }\n}\nvar s = \"@ignore-unused\"\nfunc other() {}\n"
    py = "# @tool-ignore-unstable\n\ndef run(x):\n    pass\n"
    df = spark.createDataFrame([("a.go", go, "go"), ("b.py", py, "python"), ("c.go", None, "go"), ("d.x", "-- @ignore-abandoned\nsub go(1)", None)], FILES)
    rows = sorted((r.path, r.line, r.name, r.ignore_type) for r in extract.ignore_markers(df).collect())
    assert rows == [("a.go", 1, "helper", "unused"), ("b.py", 1, "run", "unstable"), ("d.x", 1, "go", "abandoned")]
    assert extract.files_without_ignored(spark.createDataFrame([("a", "// @tool-ignore-file", "go"), ("b", None, "go"), ("c", " " * 250 + "@tool-ignore-file", "go")], FILES)).count() == 2


def test_go(spark):
    source = 'package a\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\nfunc (s *T) Run(f func(int) bool) error {\n\tfmt.Println("func fake() {")\n\tgo helper(`}`)\n\treturn nil\n}\n\n// func no() {}\nfunc helper(s string) {\n}\n'
    df = spark.createDataFrame([("a.go", source), ("b.go", None), ("c.go", "func broken(")], "path STRING, content STRING")
    rows = [r.asDict() for r in extract.go_symbols(df).collect()]
    of = lambda kind: sorted((r["name"], r["line"], r["end_line"]) for r in rows if r["kind"] == kind and r["path"] == "a.go")
    assert of("def") == [("Run", 8, 12), ("helper", 15, 16)]
    assert {r["name"]: r["is_interface"] for r in rows if r["kind"] == "def"} == {"Run": False, "helper": False, "broken": True}
    assert of("import") == [("fmt", 4, 4), ("net/http", 5, 5)]
    assert [n for n, *_ in of("call")] == ["Println", "helper"]
    assert [r["is_method"] for r in rows if r["name"] == "Run"] == [True]


def test_tree(spark, tmp_path):
    for name, text in {"main.go": "package a", "vendor/x.go": "", "build/out.js": "", "src/.gitignore": "gen/\n", "src/gen/a.go": "", "src/b.py": "x", ".gitignore": "# c\nvendor/\n!keep\n/build/\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    ignore = source_files.ignore_patterns(spark, str(tmp_path))
    assert sorted(ignore) == ["**/build/**", "**/vendor/**", "src/**/gen/**"]
    found = source_files.code_files(source_files.tree(spark, str(tmp_path), exclude=ignore))
    assert sorted(r.path for r in found.select("path").collect()) == ["main.go", "src/b.py"]
    assert len(source_files.with_hash(found).head().content_hash) == 64


def test_config_instructions(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": "1", "instructions": ["plain", {"rule": "r", "scope": "s"}]}')
    got = source_files.config(spark, str(tmp_path / "c.json")).head().instructions
    assert [(i.rule, i.scope) for i in got] == [("plain", ""), ("r", "s")]


MARKED = """package a
// @ignore-unused
func first(x int) {
	if x > 0 {
		first(x)
	}
}

// @tool-ignore-unstable and more
var y = 1

func second() { second() }
var text = "// no @ignore"
"""


def test_ends_of_marked_symbols(spark):
    """The end is sought from the line that names the symbol again; 10 lines on where none does."""
    df = spark.createDataFrame([("a.go", MARKED, "go"), ("b.go", "// @ignore-abandoned\nfunc alone() {\n}\n", "go"), ("c.go", "// @ignore-unused\n\nvar x\n", "go")], FILES)
    rows = sorted((r.path, r.line, r.end_line, r.name, r.ignore_type) for r in extract.ignore_markers(df).collect())
    assert rows == [("a.go", 2, 5, "first", "unused"), ("a.go", 9, 22, "second", "unstable"), ("b.go", 1, 12, "alone", "abandoned")]


def test_facts_are_routed_by_language(spark):
    files = [
        ("p", "a.go", 'package a\nimport "fmt"\n// TODO: later\nfunc (t *T) Run() {\n\thelp(1)\n}\nfunc ext(x int)\n'),
        ("p", "b.py", "# FIXME: now\ndef greet(x):\n    fetch(x)\n# @ignore-unused\ndef own():\n    pass\n"),
        ("p", "c.R", "mean2 <- function(x) {\n"),
        ("p", "run", "#!/bin/bash\nbuild() {\n"),
        ("p", "d.go", "// @tool-ignore-file\nfunc hidden() {}\n"),
        ("p", "e.txt", "func no() {}\n# @ignore-unused\nfunc yes() {}\n"),
        ("p", "f.go", None),
    ]
    rows = extract.facts(spark.createDataFrame(files, "project STRING, path STRING, content STRING"), ["project", "path"]).collect()
    found = {(r.path, r.type, r.name, r.line, r.end_line) for r in rows if r.type != "function_called" or r.path in ("a.go", "b.py")}
    assert found == {
        ("a.go", "import_found", "fmt", 2, 2), ("a.go", "todo_found", "", 3, 3), ("a.go", "function_defined", "Run", 4, 6), ("a.go", "function_called", "help", 5, 5), ("a.go", "function_defined", "ext", 7, 7),
        ("b.py", "todo_found", "", 1, 0), ("b.py", "function_defined", "greet", 2, 0), ("b.py", "function_called", "fetch", 3, 0), ("b.py", "function_defined", "own", 5, 0), ("b.py", "ignore_flag", "own", 4, 15),
        ("c.R", "function_defined", "mean2", 1, 0), ("run", "function_defined", "build", 2, 0), ("e.txt", "ignore_flag", "yes", 2, 13),
    }
    meta = {(r.path, r.type, r.name): r.metadata for r in rows}
    assert meta["a.go", "function_defined", "Run"] == {"source_tier": "ast", "is_method": "true"} and meta["a.go", "function_defined", "ext"]["is_interface"] == "true"
    assert meta["a.go", "todo_found", ""]["type"] == "TODO" and meta["b.py", "todo_found", ""]["text"] == "now" and meta["b.py", "ignore_flag", "own"]["ignore_type"] == "unused"
    assert {r.confidence for r in rows if r.path == "run"} == {0.6} and {r.confidence for r in rows if r.path == "a.go"} == {1.0}
