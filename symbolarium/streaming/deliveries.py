"""Structured Streaming over delivered rows: windows, repeated rows, and upserts of current rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolarium.operators.current import latest
from symbolarium.session import stored

#: Buckets of a table of current rows.
BUCKETS = 64


def stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder in the order they appear; a path of one file is a stream of that file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # Spark streams folders only
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def windowed(rows: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``keys..., start, n``: deliveries by window; rows later than the watermark are dropped, as their windows are closed."""
    timed = rows.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counted = timed.groupBy(F.window("__ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), "n")


def sessions(rows: DataFrame, ts: str, keys: list[str], gap: str = "24 hours", late: str = "7 days") -> DataFrame:
    """``keys..., start, end, n``: runs of deliveries with no pause of ``gap`` or more."""
    timed = rows.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counted = timed.groupBy(F.session_window("__ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(rows: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Rows without those of equal ``keys`` and time seen before, as far back as the watermark."""
    return rows.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([*keys, "__ts"]).drop("__ts")


def keep_current(
    rows: DataFrame, keys: list[str], by: str, target: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the current row of each key in the table ``target``: each batch is merged by the greatest ``by``.

    The table lies in ``buckets`` by a hash of the keys, and a batch reads and writes those of its own keys only.
    A bucket's new version is written beside the old one, which goes when the next batch has begun, so that a batch
    that is run again after a failure gives the same table. Read it with :func:`current_table`. ``after`` is called
    with the merged table, as a hook for snapshots.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbered = stored(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in numbered.select("bucket").distinct().collect()]  # at most as many as there are buckets
        versions = {b: [v for v in vs if v < number] for b, vs in _versions(spark, target).items()}
        old = [f"{target}/bucket={b}/batch={max(versions[b])}" for b in touched if versions.get(b)]
        both = numbered.unionByName(spark.read.option("basePath", target).parquet(*old).drop("batch").select(*numbered.columns)) if old else numbered
        merged = latest(both, ["bucket", *keys], by).withColumn("batch", F.lit(number))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for b in touched:
            for v in sorted(versions.get(b, []))[:-1]:
                gone = hadoop.Path(f"{target}/bucket={b}/batch={v}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        if after:
            after(current_table(spark, target), number)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Batches that each bucket of a table has a version of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/batch=*")
    found: dict[int, list[int]] = {}
    for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
        bucket, batch = str(status.getPath()).split("/")[-2:]
        found.setdefault(int(bucket.split("=")[1]), []).append(int(batch.split("=")[1]))
    return found


def current_table(spark: SparkSession, target: str) -> DataFrame:
    """The table that :func:`keep_current` keeps: the last version of each bucket."""
    paths = [f"{target}/bucket={b}/batch={max(v)}" for b, v in _versions(spark, target).items()]
    return spark.read.option("basePath", target).parquet(*paths).drop("bucket", "batch")
