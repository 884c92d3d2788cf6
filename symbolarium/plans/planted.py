"""Queries over small given sources, for what the tables don't hold: ignore markers, test files, imports, tampered exports.

Their SQL is the expected result in literal rows, so that it owes nothing to the code it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.functions import paths
from symbolarium.operators import extract, graph, score
from symbolarium.plans import reference
from symbolarium.sources import delimited

SOURCES = {
    "auth/login.go": 'package auth\n\nimport (\n\t"fmt"\n\t"example.org/p/store/token"\n)\n\n// TODO: lock after five tries\nfunc Login(name string) error {\n\tif !Validate(name) {\n\t\treturn fmt.Errorf("no (such) %s{", name)\n\t}\n\treturn nil\n}\n\nfunc Validate(name string) bool {\n\treturn name != ""\n}\n',
    "auth/login_test.go": 'package auth\n\nimport "example.org/p/store/token"\n\nfunc TestLogin(t *T) {\n\tLogin("x")\n}\n',
    "store/token/token.go": 'package token\n\n// @ignore-unused\nfunc Renew(t Token) Token {\n\treturn Renew(t)\n}\n',
    "web/view.test.ts": "import { draw } from './draw';\n// @tool-ignore-unstable\n\nexport function testDraw(x) {\n  draw(x);\n}\n",
    "web/draw.ts": "export function draw(x) {\n  paint(x);\n}\n/* FIXME: slow */\n",
    "tools/spec_run.rb": "# @ignore-abandoned\ndef run!\nend\n",
    "gone.go": "// @tool-ignore-file\npackage gone\nfunc Hidden() {}\n",
}


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p", f, c) for f, c in SOURCES.items()], "project STRING, file STRING, content STRING")


def _facts(spark: SparkSession) -> DataFrame:
    return extract.facts(_files(spark), ["project", "file"])


def planted_facts(spark: SparkSession, root: str) -> DataFrame:
    """Definitions, imports and todos of given sources, by the scanner of Go and the patterns of other languages."""
    return _facts(spark).filter("type NOT IN ('function_called', 'ignore_flag')").select("file", "type", F.coalesce(F.col("metadata")["text"], F.col("name")).alias("name"), "line", "end_line")


def planted_markers(spark: SparkSession, root: str) -> DataFrame:
    return _facts(spark).filter("type = 'ignore_flag'").select("file", "name", "line", "end_line", F.col("metadata")["ignore_type"].alias("ignore_type"))


def planted_test_files(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark).select("file", paths.is_test(F.col("file")).alias("is_test"), paths.test_stem(F.col("file")).alias("stem"), paths.exported(paths.test_stem(F.col("file"))).alias("exported"))


def _symbols(spark: SparkSession) -> DataFrame:
    return _facts(spark).filter("type = 'function_defined'").select("project", "file", "name", "line", "end_line")


def _resolved(spark: SparkSession) -> DataFrame:
    more = spark.createDataFrame([("p", "web/view.test.ts", "./draw"), ("p", "web/draw.ts", "../tools/spec_run"), ("p", "web/draw.ts", "./nothing")], "project STRING, file STRING, name STRING")
    found = _facts(spark).filter("type = 'import_found'").select("project", "file", "name")
    return graph.resolved_imports(found.unionByName(more), _files(spark).select("project", "file"))


def planted_imports(spark: SparkSession, root: str) -> DataFrame:
    """Imports by folder, by path, relative ones, and those that are dependencies."""
    return _resolved(spark).select("src", "import", "dst")


def planted_tests(spark: SparkSession, root: str) -> DataFrame:
    """Which tests cover which symbols, by name or by import."""
    s = _symbols(spark)
    defined = s.select("project", "file", "name")
    e = graph.merged_edges(graph.test_part(s, defined, _resolved(spark))[1])
    ids = s.select("project", graph.symbol_id(F.col("file"), F.col("name")).alias("id"))
    return graph.coverage(e, ids).select("id", "test", "weight")


def planted_calls(spark: SparkSession, root: str) -> DataFrame:
    """Call edges with their first evidence."""
    calls = _facts(spark).filter("type = 'function_called'").select("project", "file", "line", "name", "confidence")
    return graph.merged_edges(graph.call_part(_symbols(spark), calls)).select("src", "dst", "weight", "evidence", "occurrences")


def planted_ignored(spark: SparkSession, root: str) -> DataFrame:
    """The symbol each marker is meant for."""
    markers = _facts(spark).filter("type = 'ignore_flag'").select("project", "file", F.col("line").alias("marker_id"), F.col("name").alias("mark_name"), F.col("line").alias("mark_line"), F.col("metadata")["ignore_type"].alias("ignore_type"))
    return score.ignored(_symbols(spark), markers, ["project", "file"]).select("file", "name", "line", "ignore_type")


def tampered_exports(spark: SparkSession, root: str) -> DataFrame:
    """Exports of all projects as they are, with a changed letter, and without their hash."""
    whole = delimited.context_text(reference.context_export(spark, root))
    kinds = {"as it is": F.col("text"), "changed": F.concat(F.lit("#"), F.col("text")), "cut": F.substring_index("text", "hash|", 1)}
    return delimited.verified(whole.select("project", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds.items()])).alias("x")).select("project", "x.*")).select("project", "kind", "valid")


QUERIES = {f.__name__: f for f in (planted_facts, planted_markers, planted_test_files, planted_imports, planted_tests, planted_calls, planted_ignored, tampered_exports)}
SQL = {
    "planted_facts": """SELECT * FROM (VALUES
        ('auth/login.go', 'import_found', 'fmt', 4, 4), ('auth/login.go', 'import_found', 'example.org/p/store/token', 5, 5), ('auth/login.go', 'todo_found', 'lock after five tries', 8, 8),
        ('auth/login.go', 'function_defined', 'Login', 9, 14), ('auth/login.go', 'function_defined', 'Validate', 16, 18),
        ('auth/login_test.go', 'import_found', 'example.org/p/store/token', 3, 3), ('auth/login_test.go', 'function_defined', 'TestLogin', 5, 7),
        ('store/token/token.go', 'function_defined', 'Renew', 4, 6), ('web/view.test.ts', 'function_defined', 'testDraw', 4, 0),
        ('web/draw.ts', 'function_defined', 'draw', 1, 0), ('web/draw.ts', 'todo_found', 'slow */', 4, 0), ('tools/spec_run.rb', 'function_defined', 'run!', 2, 0)) AS t(file, type, name, line, end_line)""",
    "planted_markers": """SELECT * FROM (VALUES ('store/token/token.go', 'Renew', 3, 5, 'unused'), ('web/view.test.ts', 'testDraw', 2, 14, 'unstable'), ('tools/spec_run.rb', 'run!', 1, 12, 'abandoned'))
        AS t(file, name, line, end_line, ignore_type)""",
    "planted_test_files": """SELECT * FROM (VALUES ('auth/login.go', false, 'login', 'Login'), ('auth/login_test.go', true, 'login', 'Login'), ('store/token/token.go', false, 'token', 'Token'),
        ('web/view.test.ts', true, 'view', 'View'), ('web/draw.ts', false, 'draw', 'Draw'), ('tools/spec_run.rb', true, 'run', 'Run'), ('gone.go', false, 'gone', 'Gone')) AS t(file, is_test, stem, exported)""",
    "planted_imports": """SELECT * FROM (VALUES ('auth/login.go', 'fmt', NULL), ('auth/login.go', 'example.org/p/store/token', 'store/token/token.go'), ('auth/login_test.go', 'example.org/p/store/token', 'store/token/token.go'),
        ('web/view.test.ts', './draw', 'web/draw.ts'), ('web/draw.ts', '../tools/spec_run', 'tools/spec_run.rb'), ('web/draw.ts', './nothing', NULL)) AS t(src, import, dst)""",
    "planted_tests": """SELECT id, test, weight::DOUBLE AS weight FROM (VALUES ('symbol:auth/login.go::Login', 'test:auth/login_test.go', 0.9), ('symbol:auth/login_test.go::TestLogin', 'test:auth/login_test.go', 0.9),
        ('symbol:store/token/token.go::Renew', 'test:auth/login_test.go', 0.6), ('symbol:web/view.test.ts::testDraw', 'test:web/view.test.ts', 0.9), ('symbol:web/draw.ts::draw', 'test:web/view.test.ts', 0.6),
        ('symbol:tools/spec_run.rb::run!', 'test:tools/spec_run.rb', 0.9)) AS t(id, test, weight)""",
    "planted_calls": """SELECT src, dst, weight::DOUBLE AS weight, evidence, occurrences::BIGINT AS occurrences FROM (VALUES ('symbol:auth/login.go::Login', 'symbol:auth/login.go::Validate', 1.0, 'call at line 10', 1), ('symbol:auth/login_test.go::TestLogin', 'symbol:auth/login.go::Login', 1.0, 'call at line 6', 1),
        ('symbol:store/token/token.go::Renew', 'symbol:store/token/token.go::Renew', 1.0, 'call at line 5', 1)) AS t(src, dst, weight, evidence, occurrences)""",
    "planted_ignored": """SELECT * FROM (VALUES ('store/token/token.go', 'Renew', 4, 'unused'), ('web/view.test.ts', 'testDraw', 4, 'unstable'), ('tools/spec_run.rb', 'run!', 2, 'abandoned')) AS t(file, name, line, ignore_type)""",
    "tampered_exports": f"""WITH {reference.SYMBOLS}, {reference.TODOS}, {reference.INTENTS} SELECT project, kind, kind = 'as it is' AS valid FROM (
        SELECT project FROM symbols_ WHERE state IS NOT NULL UNION SELECT project FROM todos_ WHERE NOT resolved UNION SELECT project FROM intents_ WHERE status = 'active'), (VALUES ('as it is'), ('changed'), ('cut')) AS k(kind)""",
}
