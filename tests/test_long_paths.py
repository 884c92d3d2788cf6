from symbolarium.operators import graph


def test_paths_of_more_than_six_steps(spark):
    rows = [("p", f"n{k}", f"n{k + 1}") for k in range(9)] + [("p", "n9", "n0")]
    df = spark.createDataFrame(rows, "project STRING, src STRING, dst STRING")
    pairs = spark.createDataFrame([("p", "n0", "n9"), ("p", "n0", "zzz")], "project STRING, src STRING, dst STRING")
    assert [r.path for r in graph.shortest_paths(df, pairs).collect()] == [[f"n{k}" for k in range(10)]]
    assert graph.shortest_paths(df, pairs, 6).count() == 0
