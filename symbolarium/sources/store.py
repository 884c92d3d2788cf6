"""A store of snapshots by hash: full ones as checkpoints, the others as what changed, and names that refer to them.

Headers, entries and references are tables in folders of one root. Entries lie in folders by the
first two characters of their snapshot's hash, so that a chain reads those only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.functions.sizing import attach
from symbolarium.operators import snapshots
from symbolarium.session import stored

_HEADER = "project STRING, hash STRING, at LONG, seq INT, prev_hash STRING, is_checkpoint BOOLEAN"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers of all that is stored; none in a new store."""
    path = f"{root}/headers"
    return spark.read.schema(_HEADER).parquet(path) if _there(spark, path) else spark.createDataFrame([], _HEADER)


def save(new: DataFrame, rows: DataFrame, root: str, keys: list[str], compared: list[str], every: int = snapshots.CHECKPOINT_EVERY) -> int:
    """Store the snapshots of projects; what is there under its hash isn't written again. Gives the number of new ones.

    ``new`` has ``project, hash, at`` of all snapshots of the projects in question, ``rows`` their entries: ``project, ord,
    n`` (as :func:`operators.current.snapshots` numbers them), ``keys`` without the project, and values. Every
    ``every``-th snapshot is kept whole, the others as differences from the one before. Headers are written last,
    so that a snapshot whose entries were not all written isn't known.
    """
    spark = new.sparkSession
    numbered = stored(snapshots.sequence(new, every))
    fresh = stored(attach(numbered, headers(spark, root).select("hash"), ["hash"], "left_anti"))
    count = fresh.count()
    if count:
        whole = rows.filter(F.col("ord") % every == 0).select(*["project", *keys], F.col("ord").alias("seq"), F.lit("added").alias("change"), *[c for c in rows.columns if c not in ("project", "ord", "n", *keys)])
        changed = snapshots.deltas(rows, ["project", *keys], compared).filter(F.col("seq") % every != 0)
        entries = attach(whole.unionByName(changed), fresh.select("project", "seq", "hash"), ["project", "seq"])
        entries.withColumn("folder", F.substring("hash", 1, 2)).write.mode("append").partitionBy("folder").parquet(f"{root}/entries")
        fresh.select(*[F.col(name).cast(kind) for name, kind in (c.split() for c in _HEADER.split(", "))]).write.mode("append").parquet(f"{root}/headers")
    return count


def load(spark: SparkSession, root: str, hashes: DataFrame, keys: list[str]) -> DataFrame:
    """``target, keys..., values``: the snapshots of the given hashes (``hash``), rebuilt from their checkpoints and what changed since.

    One pass over the entries of all chains, however many and long they are; unknown hashes have no rows.
    """
    known = headers(spark, root)
    links = snapshots.chains_of(known, hashes).withColumn("folder", F.substring("hash", 1, 2))
    entries = spark.read.parquet(f"{root}/entries").drop("seq", "project")
    met = attach(entries, links, ["folder", "hash"]).drop("folder", "hash")
    return snapshots.chain(met, ["target", *keys])


def refer(refs: DataFrame, root: str) -> None:
    """Let names (``project, ref``, such as "latest" or a commit) refer to hashes from ``at`` on."""
    refs.select("project", "ref", "hash", F.col("at").cast("long")).write.mode("append").parquet(f"{root}/refs")


def referred(spark: SparkSession, root: str) -> DataFrame:
    """``project, ref, hash``: what each name refers to now; of equal times the greatest hash."""
    best = F.max(F.struct("at", "hash")).alias("b")
    return spark.read.parquet(f"{root}/refs").groupBy("project", "ref").agg(best).select("project", "ref", "b.hash")
