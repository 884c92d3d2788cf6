"""Every query with SQL agrees with it on the smallest tables; the others run."""

import pytest

from symbolarium.plans import planted, reference, training

CHECKED = {n: (f, m.SQL[n]) for m in (training, reference, planted) for n, f in m.QUERIES.items() if n in m.SQL}
#: Queries that the smallest tables have no rows for.
EMPTY = {"ignore_markers", "test_coverage", "shortest_path_whole"}


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(compare, name):
    ours, theirs = compare(*CHECKED[name])
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in reference.QUERIES if n not in CHECKED])
def test_runs(spark, sf, name):
    assert (reference.QUERIES[name](spark, sf).count() > 0) == (name not in EMPTY)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
