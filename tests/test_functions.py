import pytest
from pyspark.sql import functions as F

from symbolarium.functions import globs, normalise, paths, text


def one(spark, column, **values):
    kinds = {str: "STRING", int: "BIGINT", list: "ARRAY<STRING>", type(None): "STRING"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x INT"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).head().r


@pytest.mark.parametrize(("path", "pattern", "expected"), [
    ("a/b.go", "**/*.go", True), ("b.go", "**/*.go", True), ("a/b.js", "*.js", True), ("vendor/x", "vendor/**", True), ("a/vendor/x", "vendor/**", False),
    ("vendor", "vendor/**", True), ("a/node_modules/b/c", "**/node_modules/**", True), ("x/test_a.py", "**/test_*", True), ("src/a", "src*", True), ("a/src", "src*", False),
    ("a.b", "a*b", False), ("x/.env.local", "**/*.env.*", False), ("a/x/y/b", "a/**/b", True), ("a/b", "a/**/b", True), ("ab", "a/**/b", False),
])
def test_globs(spark, path, pattern, expected):
    assert one(spark, globs.any_of(F.col("p"), [pattern]), p=path) is expected


@pytest.mark.parametrize(("line", "folder", "expected"), [
    ("x", "", "**/x"), ("d/", "", "**/d/**"), ("/x", "", "**/x"), ("a/b", "", "a/b"), ("/a/b/", "", "a/b/**"), ("# c", "", ""), ("!x", "", ""), ("", "", ""), ("/", "", ""),
    ("x", "s", "s/**/x"), ("d/", "s", "s/**/d/**"), ("/x", "s", "s/x"), ("a/b", "s", "s/a/b"), ("/d/", "s", "s/d/**"),
])
def test_ignore_lines(line, folder, expected):
    assert globs.ignore_line(line, folder) == expected


@pytest.mark.parametrize(("path", "pattern", "expected"), [("a/b", "a/*", True), ("a/b/c", "a/*", False), ("a/b/c", "a/**", True), ("a", "a/**", True), ("ab", "a?", True), ("a/b", "a/[a-c]", True), ("handlers.go", "handler*.go", True)])
def test_scope(spark, path, pattern, expected):
    assert one(spark, F.col("p").rlike(globs.scope_pattern(pattern)), p=path) is expected


@pytest.mark.parametrize(("word", "expected"), [("tokens", "token"), ("caching", "cach"), ("cache", "cach"), ("refactoring", "refactor"), ("resolved", "resolv"), ("quickly", "quick"), ("classes", "class"), ("status", "status"), ("abilities", "ability"), ("run", "run"), ("tree", "tree")])
def test_stem(spark, word, expected):
    df = spark.createDataFrame([(word,)], "w STRING")
    assert text.stemmed(df, "w").head().term == expected


def test_words(spark):
    assert one(spark, text.words(F.col("s")), s="The cache; of TOKENS, a b2 é x") == ["cache", "tokens", "b2"]
    assert one(spark, text.words(F.col("s")), s=None) == []
    assert one(spark, text.candidate_text(F.col("m"), F.col("t")), m="fix", t=["a", "b"]) == "fix a a b b"


@pytest.mark.parametrize("value", ["", "a|b", "a\\nb", "a\nb", "\\", "\\|", "\\\\n|\n", "é中", "|"])
def test_escape_roundtrip(spark, value):
    assert one(spark, text.unescape(text.escape(F.col("s"))), s=value) == value


@pytest.mark.parametrize(("path", "expected"), [("a/auth_test.go", True), ("test_x.py", True), ("x.spec.tsx", True), ("x_SPEC.rb", True), ("testing.go", False), ("a/contest.py", False)])
def test_test_files(spark, path, expected):
    assert one(spark, paths.is_test(F.col("p")), p=path) is expected


def test_paths(spark):
    assert one(spark, paths.cleaned(F.col("p")), p="a/./b/../../c/../../d") == "../d"
    assert one(spark, paths.folder(F.col("p")), p="x.go") == "."
    assert one(spark, paths.test_stem(F.col("p")), p="a/test_auth.py") == "auth"
    assert one(spark, paths.tested_name(F.col("p")), p="TestLogin") == "Login"
    assert one(spark, paths.exported(F.col("p")), p="login") == "Login"
    assert one(spark, normalise.path(F.col("p")), p=".\\a\\b") == "a/b"
    assert one(spark, normalise.path(F.col("p")), p="././a") == "./a"


def test_identity_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None)], "a INT, b INT")
    assert df.select(normalise.identity(F.col("a"), F.col("b"))).distinct().count() == 3


def test_ages(spark):
    ages = {30: "just now", 60: "1 minutes ago", 7200: "2 hours ago", 86400: "1 days ago", 14 * 86400: "2 weeks ago", 90 * 86400: "3 months ago"}
    for s, expected in ages.items():
        assert one(spark, text.age_text(F.col("a"), F.col("b")), a=0, b=s) == expected


@pytest.mark.parametrize(("kind", "body", "expected"), [("hack", "", "FIX"), ("TBD", "bug", "TODO"), (None, "a bug here", "FIX"), ("x", "see info", "NOTE"), ("", None, "TODO")])
def test_todo_classes(spark, kind, body, expected):
    assert one(spark, text.todo_class(F.col("k"), F.col("b")), k=kind, b=body) == expected


def test_comment_marks(spark):
    assert one(spark, text.without_comment_marks(F.col("s")), s=" // # /* do it ") == "do it"
    assert one(spark, text.without_comment_marks(F.col("s")), s="*/ * x") == "x"
