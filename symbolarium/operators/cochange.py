"""Files that change together: set similarity of the commits that touch them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.blocks import BLOCK, block_pairs
from symbolarium.session import stored


def co_changes(commit_files: DataFrame, min_commits: int = 3, min_jaccard: float = 0.3, block: int = BLOCK) -> DataFrame:
    """``project, file_a, file_b, co_occurrences, commits_a, commits_b, jaccard`` for pairs ``file_a < file_b``.

    ``commit_files`` has ``project, hash, file``. Repeated rows count once; rows with nulls are left
    out. Files of fewer than ``min_commits`` commits can't be in a pair and are dropped before pairs are
    made, pairs whose numbers of commits rule the index out before the count. Pairs are made by blocks, so
    that a commit of very many files is spread over tasks.
    """
    facts = stored(commit_files.select("project", "hash", "file").dropna().distinct())
    n = facts.groupBy("project", "file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_commits)
    used = stored(facts.join(n, ["project", "file"]).select("project", "hash", F.struct(F.col("file").alias("f"), "n").alias("item")))
    fits = F.least("a.n", "b.n") >= min_jaccard * F.greatest("a.n", "b.n")
    pairs = block_pairs(used, ["project"], ["project", "hash"], F.col("item"), block=block).filter("NOT same OR a.f < b.f").filter(fits)
    ends = {name: pick("a.f", "b.f") for name, pick in (("file_a", F.least), ("file_b", F.greatest))}
    first = F.col("a.f") < F.col("b.f")
    placed = pairs.select(
        "project", *[c.alias(k) for k, c in ends.items()], F.when(first, F.col("a.n")).otherwise(F.col("b.n")).alias("commits_a"), F.when(first, F.col("b.n")).otherwise(F.col("a.n")).alias("commits_b")
    )
    c = F.col("co_occurrences")
    counted = placed.groupBy("project", "file_a", "file_b", "commits_a", "commits_b").agg(F.count(F.lit(1)).alias("co_occurrences"))
    scored = counted.withColumn("jaccard", c / (F.col("commits_a") + F.col("commits_b") - c))
    return scored.filter((c >= min_commits) & (F.col("jaccard") >= min_jaccard))


def newest_commits(commits: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest commits of each project; equal times by hash."""
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy(F.col("committed_at").desc(), "hash")
    return commits.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def hidden(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """Pairs that no import explains, in both directions: ``project, src, dst, weight``.

    ``imports`` has ``project, src, dst``, files that import files.
    """
    linked = imports.select("project", F.least("src", "dst").alias("file_a"), F.greatest("src", "dst").alias("file_b")).distinct()
    free = pairs.join(linked, ["project", "file_a", "file_b"], "left_anti")
    one = free.select("project", F.col("file_a").alias("src"), F.col("file_b").alias("dst"), F.col("jaccard").alias("weight"))
    return one.unionByName(one.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
