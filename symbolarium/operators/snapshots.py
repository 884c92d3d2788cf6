"""Snapshots of one key space: difference, application, chains of deltas, checkpoints and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions import normalise as N

#: Every so many deltas a full checkpoint is written.
CHECKPOINT_EVERY = 10


def diff(before: DataFrame, after: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Rows of ``after`` (of ``before`` where removed) that differ, with ``change``: added, removed or changed.

    One full outer join on ``keys``, which are unique on each side; null keys are equal. ``compared`` columns are compared null-safely.
    """
    values = [c for c in after.columns if c not in keys]
    a = before.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.struct(*values).alias("__old"))
    b = after.select(*keys, F.struct(*values).alias("__new"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    same = F.lit(True)
    for c in compared:
        same = same & F.col("__old")[c].eqNullSafe(F.col("__new")[c])
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "changed")
    row = F.coalesce("__new", "__old")
    joined = a.join(b, on, "full_outer").withColumn("change", change).filter("change IS NOT NULL")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__k{i}")).alias(c) for i, c in enumerate(keys)], *[row[c].alias(c) for c in values], "change")


def apply(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` after a :func:`diff`: removed rows gone, changed ones replaced, added ones there."""
    kept = base.join(delta.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(delta.filter("change <> 'removed'").select(*base.columns))


def chain(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """State after a checkpoint and its deltas: ``rows`` has ``keys, seq, change`` and values; the last change of each key wins.

    Checkpoint rows have ``seq`` 0 and ``change`` added. One aggregation over checkpoint and chain
    instead of a fold of joins, however long the chain is.
    """
    values = [c for c in rows.columns if c not in (*keys, seq, "change")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("change", *values), F.col(seq)).alias("__r"))
    return last.filter("__r.change <> 'removed'").select(*keys, *[F.col("__r")[c].alias(c) for c in values])


def deltas(rows: DataFrame, keys: list[str], compared: list[str], seq: str = "ord", number: str = "n") -> DataFrame:
    """``keys, seq, change`` and values: the :func:`diff` of each snapshot with the one before it, the first with an empty one.

    ``rows`` has ``keys`` (with what the snapshots belong to), ``seq`` from 0 to ``number`` - 1 and values. A key's
    snapshots are neighbours in one window, so that rows partitioned by some of ``keys`` aren't moved.
    """
    values = [c for c in rows.columns if c not in (*keys, seq, number)]
    w = Window.partitionBy(*keys).orderBy(seq)
    before = F.lag(F.struct(seq, *compared)).over(w)
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col("__before")[c])
    change = F.when(F.col("__before").isNull() | (F.col("__before")[seq] < F.col(seq) - 1), "added").when(~same, "changed")
    ends = (F.coalesce("__next", number) > F.col(seq) + 1) & (F.col(seq) + 1 < F.col(number))
    own = F.struct(F.col(seq).alias("seq"), change.alias("change"))
    end = F.struct((F.col(seq) + 1).alias("seq"), F.when(ends, "removed").alias("change"))
    placed = rows.withColumn("__before", before).withColumn("__next", F.lead(seq).over(w))
    each = placed.withColumn("__d", F.explode(F.filter(F.array(own, end), lambda d: d["change"].isNotNull())))
    return each.select(*keys, "__d.seq", "__d.change", *values)


def chains_of(headers: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, hash, seq``: for each target (``hash``) the objects that make it up, from its checkpoint (0) on; none for unknown ones.

    ``headers`` has ``project, hash, seq, is_checkpoint``, the result of :func:`sequence`. Objects are
    numbered within their project, so that a chain is a range of numbers: from the last checkpoint up
    to the target. Two joins by project instead of a walk from link to link.
    """
    own = headers.join(targets.select("hash").distinct(), "hash", "left_semi").select("project", F.col("hash").alias("target"), F.col("seq").alias("__to"))
    before = headers.join(own, "project").filter("seq <= __to")
    from_ = before.filter("is_checkpoint").groupBy("project", "target").agg(F.max("seq").alias("__from"))
    return before.join(from_, ["project", "target"]).filter("seq >= __from").select("target", "hash", (F.col("seq") - F.col("__from")).alias("seq"))


def chain_of(headers: DataFrame, target: str) -> DataFrame:
    """``hash, seq``: the objects that make up one target."""
    return chains_of(headers, headers.filter(F.col("hash") == target)).select("hash", "seq")


def sequence(headers: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """``headers`` (``project, hash, at``) with ``seq``, ``prev_hash`` and ``is_checkpoint``: a delta each, a checkpoint at the first and at each ``every``-th."""
    w = Window.partitionBy("project").orderBy("at", "hash")
    out = headers.withColumn("seq", F.row_number().over(w) - 1).withColumn("prev_hash", F.lag("hash").over(w))
    return out.withColumn("is_checkpoint", F.col("seq") % every == 0)


def pruned(headers: DataFrame, keep: int) -> DataFrame:
    """Objects to drop so that each project keeps its ``keep`` newest checkpoints: older checkpoints, and the deltas that rest on them.

    ``headers`` is the result of :func:`sequence`. A delta goes with the checkpoint its chain begins
    at, so that no kept delta loses its ground.
    """
    w = Window.partitionBy("project").orderBy("seq")
    run = F.sum(F.col("is_checkpoint").cast("int")).over(w)
    last = F.sum(F.col("is_checkpoint").cast("int")).over(Window.partitionBy("project"))
    return headers.withColumn("__run", run).withColumn("__last", last).filter(F.col("__run") <= F.col("__last") - keep).drop("__run", "__last")


def resolved(hashes: DataFrame, prefix: str) -> DataFrame:
    """The first hash that begins with ``prefix``, as one row or none."""
    return hashes.filter(F.col("hash").startswith(prefix.lower())).orderBy("hash").limit(1)


def fingerprint(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``group..., rows, mixed, total``: identity of a set of rows that doesn't depend on their order.

    Number of rows, xor and sum of row hashes: equal rows don't cancel out, as they would in the xor alone.
    """
    h = N.identity(*[F.col(c) for c in columns])
    total = F.sum(F.col("__h").cast("decimal(20,0)")).cast("string").alias("total")
    return rows.select(*group, h.alias("__h")).groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("__h").alias("mixed"), total)


def content_hash(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``group..., hash``: SHA-256 of a set of rows; the same rows give the same hash in any order.

    A tree of two levels: digests are sorted and hashed in 4,096 buckets by their first digits, then the
    buckets' hashes are, so that no task sorts a whole group.
    """
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

    def joined(c: str):
        return F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)

    leaves = rows.select(*group, one.alias("__d")).groupBy(*group, F.substring("__d", 1, 3).alias("__b")).agg(joined("__d").alias("__d"))
    return leaves.groupBy(*group).agg(joined("__d").alias("hash"))


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with rows of equal keys replaced by those of ``new``, and new keys added."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*stored.columns))


def evicted(stored: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without what is no longer present."""
    return stored.join(present.select(*keys).distinct(), keys, "left_semi")


def rescan(listing: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """``listing`` with ``route``: ``reuse`` where ``mtime`` is the manifest's, ``new`` where the file isn't known, else ``extract``.

    Both have ``keys, mtime``. A file touched without a change is extracted again, as its time must fit too.
    """
    old = manifest.select(*keys, F.col("mtime").alias("__t"))
    route = F.when(F.col("__t").isNull(), "new").when(F.col("__t") == F.col("mtime"), "reuse").otherwise("extract")
    return listing.join(old, keys, "left").withColumn("route", route).drop("__t")
