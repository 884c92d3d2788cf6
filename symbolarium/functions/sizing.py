"""Sizes that Spark knows without a job: numbers of partitions, and joins whose small side is broadcast only behind its size in bytes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.session import stored

#: A side is broadcast up to this size of its files; in memory it takes some times as much.
BROADCAST_BYTES = 8 << 20
#: Bytes of input (compressed columns, five to ten times as much in memory) for each partition, and the number of partitions beyond which both their number and their size grow.
PARTITION_BYTES, MANY = 4 << 20, 2000
#: Sizes above this are Spark's way to say that it doesn't know.
_UNKNOWN = 1 << 60
#: What may lie over a scan whose files tell its size.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _leaves(plan) -> list:
    found = plan.collectLeaves()
    return [found.apply(k) for k in range(found.size())]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below ``df``, as their listings tell, each once; inputs that aren't files count as nothing, as Spark can only guess their size."""
    sizes = {}
    for leaf in _leaves(df._jdf.queryExecution().optimizedPlan()):
        if leaf.nodeName() == "LogicalRelation" and (size := int(str(leaf.stats().sizeInBytes()))) < _UNKNOWN:
            sizes[leaf.relation().toString() + leaf.relation().location().rootPaths().mkString(",")] = size
    return sum(sizes.values())


def parts(df: DataFrame, unit: int = PARTITION_BYTES) -> int:
    """Number of partitions for a shuffle of ``df``: one for each ``unit`` bytes of input, at least the session's.

    Beyond 2,000 of them, number and size both grow with the square root of the input (100 TB: 224,000
    partitions of 0.45 GB), as a shuffle's blocks are the product of its two sides.
    """
    n = input_bytes(df) / unit
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n if n <= MANY else math.sqrt(n * MANY)))


def _is_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        if plan.nodeName() not in _PLAIN:
            return False
        if plan.children().isEmpty():
            return True
        plan = plan.children().head()


def as_scan(df: DataFrame) -> DataFrame:
    """``df``, stored if it is more than a scan: for what is read several times."""
    return df if _is_scan(df) else stored(df)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``small`` to ``big``: broadcast if its files have at most ``limit`` bytes, else left to the planner.

    A side that is more than a scan is stored first: it is computed once, and its size is known.
    """
    held = as_scan(small)
    return big.join(F.broadcast(held) if input_bytes(held) <= limit else held, on, how)
