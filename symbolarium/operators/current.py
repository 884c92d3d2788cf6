"""Current rows: of the rows delivered for one key, the one delivered last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions import normalise as N


def latest(df: DataFrame, keys: list[str], by: str = "delivered_at", parts: int | None = None) -> DataFrame:
    """One row for each distinct ``keys`` (nulls are equal), the one with the greatest ``by``.

    Null ``by`` is older than any time. Written with ``lead`` and not ``row_number() = 1``: the
    latter makes Spark sort before the shuffle as well, which pays only where groups are large.
    A DataFrame already partitioned by some of ``keys`` isn't shuffled again. Empty input gives
    an empty result; all columns of ``df`` are kept. ``parts``: the number of partitions, where ``df`` must be moved.
    """
    df = df.repartition(parts, *keys) if parts else df
    w = Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_first())
    return df.withColumn("__next", F.lead(F.lit(1)).over(w)).filter("__next IS NULL").drop("__next")


def snapshots(project_states: DataFrame) -> DataFrame:
    """``snapshot_hash, project, ord, n, at``: each project's snapshots in the order of ``updated_at``.

    ``ord`` counts from 0, ``n`` is the number of the project's snapshots, ``at`` seconds since
    1970. Repeated deliveries count once; equal times are ordered by hash; rows without hash,
    project or ``updated_at`` can't be ordered and are left out.
    """
    one = (
        project_states.select("project", N.hash_id("snapshot_hash").alias("snapshot_hash"), "updated_at")
        .filter("snapshot_hash IS NOT NULL AND project IS NOT NULL AND updated_at IS NOT NULL")
        .groupBy("snapshot_hash")
        .agg(F.min("project").alias("project"), F.min("updated_at").alias("updated_at"))
    )
    w = Window.partitionBy("project")
    return one.select(
        "snapshot_hash",
        "project",
        (F.row_number().over(w.orderBy("updated_at", "snapshot_hash")) - 1).alias("ord"),
        F.count(F.lit(1)).over(w).cast("int").alias("n"),
        N.seconds("updated_at").alias("at"),
    )
