"""A stored table leaves no shuffle files behind."""

from pyspark.sql import functions as F

from symbolarium.session import stored


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_no_shuffle_files_stay(spark):
    before = shuffled(spark)
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert {r.k: r.n for r in rows.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    assert shuffled(spark) <= before
