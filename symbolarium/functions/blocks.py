"""Pairs of the items of a group by blocks, so that no group is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.sizing import attach

#: A group of more items is split into chunks of about this many.
BLOCK = 128


def block_pairs(rows: DataFrame, keep: list[str], group: list[str], item: Column, mark: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``keep..., same, a, b``: candidates for all pairs of the items of each ``group``.

    ``keep`` are columns of ``group`` that the result keeps. Where ``same`` is true a pair comes out in
    both orders and each item with itself, so the caller takes one order; else ``a`` and ``b`` are of
    different chunks and come out once. A group above ``block`` items is split into chunks by a hash of
    the item; each pair of its chunks is a row of its own, so that the products of a huge group are
    spread over all tasks. ``mark`` is a second hash of the group (32 bits): groups whose columns
    are hashes and equal, but whose marks differ, are an error and never merged.
    """
    named = rows.select(*group, item.alias("x"), *([mark.alias("__mark")] if mark is not None else []))
    marks = [F.min("__mark").alias("__low"), F.max("__mark").alias("__high")] if mark is not None else []
    sizes = named.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), *marks)
    if mark is not None:
        clash = F.raise_error(F.lit("two groups have the same hash; pass another seed"))
        sizes = sizes.withColumn("size", F.when(F.col("__low") == F.col("__high"), F.col("size")).otherwise(clash.cast("long"))).drop("__low", "__high")
    large = sizes.filter(F.col("size") > block).select(*group, F.ceil(F.col("size") / block).cast("int").alias("chunks"))
    chunked = attach(named.select(*group, "x"), large, group, "left").select(
        *group, "x", F.coalesce("chunks", F.lit(1)).alias("chunks"), F.expr("coalesce(CAST(pmod(xxhash64(x), chunks) AS INT), 0)").alias("chunk")
    )
    held = chunked.groupBy(*group, "chunks", "chunk").agg(F.collect_list("x").alias("xs"))
    ordinary = held.filter("chunks = 1 AND size(xs) > 1").select(*keep, F.col("xs").alias("left"), F.col("xs").alias("right"), F.lit(True).alias("same"))
    split = held.filter("chunks > 1")
    key = [*group, "low", "high"]
    lower = split.select(*group, F.col("chunk").alias("low"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("high"), F.col("xs").alias("left"))
    upper = split.select(*group, F.explode(F.sequence(F.lit(0), "chunk")).alias("low"), F.col("chunk").alias("high"), F.col("xs").alias("right"))
    blocks = lower.join(upper, key).select(*keep, "left", "right", (F.col("low") == F.col("high")).alias("same"))
    return ordinary.unionByName(blocks).select(*keep, "same", "right", F.explode("left").alias("a")).select(*keep, "same", "a", F.explode("right").alias("b"))
