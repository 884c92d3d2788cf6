import pytest

from symbolarium.llm import queries
from symbolarium.operators.current import snapshots
from symbolarium.sources import table


@pytest.mark.parametrize("by", ["project", "day"])
def test_within_the_stated_error(spark, sf, by):
    days = {r.snapshot_hash: str(r.day) for r in snapshots(table(spark, sf, "project_states")).selectExpr("snapshot_hash", "date(timestamp_seconds(at)) AS day").collect()}
    values = {}
    for r in queries._metrics(table(spark, sf, "symbols")).collect():
        key = r.project if by == "project" else days.get(r.snapshot_hash)
        if key is not None:
            values.setdefault((key, r.language, r.metric), []).append(r.value)
    got = queries.QUERIES[f"p1_percentiles_{by}"](spark, sf).collect()
    assert {(r[by], r.language, r.metric): r.n for r in got} == {k: len(v) for k, v in values.items()}
    for r in got:
        v = sorted(values[r[by], r.language, r.metric])
        if len(v) >= 200:  # as a code is an interval of values, ranks are those of values within 1 percent
            assert sum(x <= r.value * 1.01 for x in v) >= (r.q - 0.03) * len(v) and sum(x < r.value * 0.99 for x in v) <= (r.q + 0.03) * len(v)
