"""Names that are reserved words only in other languages."""

import pytest

from symbolarium.operators import extract


@pytest.mark.parametrize(("path", "content", "defined", "called"), [
    ("a.rs", "fn new() {\nlet x = default(1);", {"new"}, {"default"}),
    ("a.js", "x = match(y);\nif (a) {", set(), {"match"}),
    ("a.java", "x = delete(y);", set(), {"delete"}),
    ("a.sh", "if true; then\nfi\ndone", set(), set()),
])
def test_own_reserved_words(spark, path, content, defined, called):
    lang = {"rs": "rust", "js": "javascript", "java": "java", "sh": "shell"}[path.split(".")[1]]
    lined = extract.lines(spark.createDataFrame([(path, lang, content)], "path STRING, language STRING, content STRING")).cache()
    assert {r.name for r in extract.definitions(lined).collect()} == defined
    assert {r.name for r in extract.calls(lined).collect()} - {"true"} == called
