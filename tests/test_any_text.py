from pyspark.sql import functions as F

from symbolarium.sources import delimited


def test_any_text_comes_back(spark):
    texts = ["a\u0001b", "\u0001", "\u0001a|\u0001b", "x" + "\\" * 101, "\\n|\n\\\\", "", "plain"]
    df = spark.createDataFrame([(t, "z") for t in texts], "a STRING, b STRING")
    got = df.select("a", delimited.fields(delimited.record("a", "b")).alias("f")).collect()
    assert [(r.a, r.f) for r in got] == [(t, [t, "z"]) for t in texts]
