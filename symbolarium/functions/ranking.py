"""Places of rows in a total order, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.sizing import parts
from symbolarium.session import stored


def placed(df: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row (from 1) within its ``group`` by ``order``, which should be total; nulls come first in ascending order.

    Rows are brought into ranges of group and order and stored; a row's place is that within its range and the
    number of the group's rows in the ranges before. Only ranges' numbers are summed up by group, so a
    group of any size is ordered by many tasks. Empty input gives an empty result.
    """
    keys = [F.col(c) for c in group]
    held = stored(df.repartitionByRange(parts(df), *keys, *order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range", *group).orderBy(*order)
    counts = held.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*group, "__range", (F.sum("__n").over(Window.partitionBy(*group).orderBy("__range")) - F.col("__n")).alias("__before"))
    on = F.col("a.__range") == F.col("b.__range")
    for c in group:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    numbered = held.withColumn("__at", F.row_number().over(within)).alias("a").join(before.alias("b"), on)
    return numbered.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("a.__at") + F.col("b.__before")).alias(name))


def first_overall(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows with ``more``, the number of those left out: each task sends its own first ``n``."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n")  # one row


def percentiles(df: DataFrame, group: list[str], value: str, q: Column) -> DataFrame:
    """``group..., n, percentile``: the exact percentile of each group, linear between ranks; ``q`` may depend on the group.

    Null values don't count; groups without a value have no row. Ranks are those of :func:`placed`, so that no
    state grows with a group.
    """
    kept = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    ranked = placed(kept, group, [F.col("__v")], "__place")
    n = ranked.groupBy(*group).agg(F.max("__place").alias("n"))
    on = F.lit(True)
    for c in group:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = ranked.alias("a").join(n.alias("b"), on).select(*[F.col(f"a.{c}").alias(c) for c in group], "__v", "n", "__place")
    rank = q * (F.col("n") - 1)
    near = met.withColumn("__rank", rank).filter((F.col("__place") - 1 >= F.floor("__rank")) & (F.col("__place") - 1 <= F.ceil("__rank")))
    low, high = F.min("__v"), F.max("__v")
    return near.groupBy(*group, "n").agg((low + (high - low) * (F.max("__rank") - F.floor(F.max("__rank")))).alias("percentile"))
