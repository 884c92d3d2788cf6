"""Queries of this subpackage: those with SQL agree with it, the others hold what TESTDATA.md asks."""

import pytest

from symbolarium.llm import queries


@pytest.mark.parametrize("name", queries.SQL)
def test_same_as_sql(compare, name):
    ours, theirs = compare(queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs


def test_found_documents_follow_the_ids(spark, sf):
    sizes = {r.doc_id: len(r.ids) for r in queries.p6_ids(spark, sf).collect()}
    assert {r.doc_id for r in queries.p7_found(spark, sf).collect()} == {i for i, n in sizes.items() if n > 2048}
    assert {r.doc_id for r in queries.p8_found(spark, sf).collect()} == {i for i, n in sizes.items() if n > 512}
    assert all(r.documents == r.restored for r in queries.p6_roundtrip(spark, sf).collect())


def test_reports(spark, sf):
    assert queries.p1_percentiles(spark, sf).count() > 0
    fill = queries.p7_fill(spark, sf).head()
    assert fill.fullest <= 2048
    assert queries.p8_pieces(spark, sf).filter("last - first > 512").count() == 0
