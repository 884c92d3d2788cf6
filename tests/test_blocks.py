"""Pairs by blocks, sizes and stored tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from symbolarium import session
from symbolarium.functions import sizing
from symbolarium.functions.blocks import block_pairs
from symbolarium.operators import cochange
from symbolarium.sources import table


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_every_pair_once(spark, block):
    groups = {"a": 30, "b": 1, "c": 5}
    rows = spark.createDataFrame([("k", g, i) for g, n in groups.items() for i in range(n)], "keep STRING, g STRING, i INT")
    found = block_pairs(rows, ["keep", "g"], ["keep", "g"], F.col("i"), block=block).filter("NOT same OR a < b").collect()
    assert all(r.keep == "k" for r in found)
    pairs = [(r.g, *sorted((r.a, r.b))) for r in found]
    assert sorted(pairs) == sorted((g, i, j) for g, n in groups.items() for j in range(n) for i in range(j))


def test_equal_hashes_of_two_groups_are_an_error(spark):
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1), (2, "z", 2)], "h INT, name STRING, i INT")
    apart = block_pairs(rows.filter("h = 2"), ["h"], ["h"], F.col("i"), F.hash("name"))
    assert apart.filter("NOT same OR a < b").count() == 1
    with pytest.raises(Exception, match="same hash"):
        block_pairs(rows, ["h"], ["h"], F.col("i"), F.hash("name")).collect()


@pytest.mark.parametrize("block", [3, 1000])
def test_co_changes_of_large_commits(spark, block):
    rng = random.Random(4)
    commits = {f"c{k}": rng.sample([f"f{i}" for i in range(20)], 15 if k % 4 == 0 else 3) for k in range(16)}
    rows = spark.createDataFrame([("p", h, f, 1) for h, fs in commits.items() for f in fs] * 2 + [("p", None, "f1", 1), ("p", "c1", None, 1)], "project STRING, hash STRING, file STRING, jaccard INT")
    found = {(r.file_a, r.file_b): (r.co_occurrences, r.commits_a, r.commits_b) for r in cochange.co_changes(rows, block=block).collect()}
    by = {f: {h for h, fs in commits.items() if f in fs} for fs in commits.values() for f in fs}
    expected = {(a, b): (len(x & y), len(x), len(y)) for a, x in by.items() for b, y in by.items() if a < b and len(x & y) >= 3 and len(x & y) / len(x | y) >= 0.3}
    assert found == expected and expected


def test_sizes(spark, sf):
    symbols = table(spark, sf, "symbols")
    size = os.path.getsize(f"{sf}/symbols.parquet")
    assert sizing.input_bytes(symbols.groupBy("file").count()) == size
    assert sizing.parts(symbols, size // 10) in (10, 11) and sizing.parts(symbols) == 4
    assert sizing.parts(symbols, 1) < size  # many partitions: they grow too
    known = table(spark, sf, "languages").select(F.col("id").alias("language"))
    for small, limit, broadcast in ((known, 1 << 20, True), (known.distinct(), 1 << 20, True), (known.distinct(), 1, False)):
        joined = sizing.attach(symbols, small, ["language"], "left_semi", limit)
        assert ("strategy=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString()) == broadcast
        assert joined.count() > 0


def test_stored_tables_go(spark):
    df = session.stored(spark.range(5))
    path = session._stored[spark.sparkContext.applicationId][-1].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path)
