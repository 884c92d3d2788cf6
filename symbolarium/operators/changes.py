"""What changed between full snapshots, by content-defined chunks of key-sorted snapshots.

Rows are brought into parts of projects that hold all snapshots of a key, sorted by snapshot and
key, and cut into chunks where the hash of a key says so: unchanged stretches of two snapshots are
cut alike, wherever rows were inserted before them. Chunks of equal digest in consecutive snapshots
are discarded unseen; only the rows of other chunks are joined by key, where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions import normalise as N
from symbolarium.functions.sizing import attach, parts
from symbolarium.operators.current import latest

#: A key starts a chunk with this probability: chunks have 4 rows on average, as a seventh of the rows change from snapshot to snapshot.
CHUNK_ROWS = 4
#: Rows of all snapshots of a project that one task shall hold; larger projects are split by key.
PART_ROWS = 250_000
#: Rows of unmatched chunks that are joined at once.
_JOINED = 50_000
#: Multiplier of the second hash in a chunk's digest.
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 divided by the golden ratio


def _digests(rows: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """For each chunk the sum of its row hashes, that of the hashes mixed once more, and its length."""
    mixed = rows * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    lengths = np.diff(np.append(starts, len(rows)))
    return list(zip(np.add.reduceat(rows, starts).tolist(), np.add.reduceat(mixed, starts).tolist(), lengths.tolist()))


class _Snapshot:
    """The rows of one snapshot within a part, and their chunks."""

    def __init__(self, table: pa.Table, chunk_rows: int):
        self.table = table
        self.project, self.ord, self.n = (table.column(c)[0].as_py() for c in ("project", "ord", "n"))
        keys = table.column("key_hash").to_numpy().view(np.uint64)
        first = keys % np.uint64(chunk_rows) == 0
        first[0] = True
        starts = np.flatnonzero(first)
        self.lengths = np.diff(np.append(starts, len(keys)))
        self.digests = _digests(table.column("row_hash").to_numpy().view(np.uint64), starts)
        self.known = set(self.digests)

    def unmatched(self, other: _Snapshot | None) -> pa.Table:
        if other is None:
            return self.table
        keep = np.fromiter((d not in other.known for d in self.digests), bool, len(self.digests))
        return self.table.filter(pa.array(np.repeat(keep, self.lengths)))


_KEY = ["project", "ord", "kind", "file", "item"]


def _classified(held: list[pa.Table]) -> pa.RecordBatch | None:
    """Rows of unmatched chunks, joined by key: those on one side only, or with another ``attr``."""
    met = pa.concat_tables(held).group_by(_KEY).aggregate([("old", "max"), ("new", "max")])
    old, new = met.column("old_max").combine_chunks(), met.column("new_max").combine_chunks()
    was, is_ = old.is_valid(), new.is_valid()
    change = pc.if_else(pc.invert(was), "added", pc.if_else(pc.invert(is_), "removed", "changed"))
    differs = pc.or_(pc.xor(was, is_), pc.fill_null(pc.not_equal(old, new), False))
    found = met.select(_KEY).append_column("change", change).filter(differs).combine_chunks()
    return found.to_batches()[0] if found.num_rows else None


def _differences(chunk_rows: int):
    def side(table: pa.Table, later: int, new: bool) -> pa.Table:
        attr, none = table.column("attr").combine_chunks(), pa.nulls(table.num_rows, pa.int64())
        columns = [table.column("project"), pa.array(np.full(table.num_rows, later, np.int32)), *(table.column(c) for c in _KEY[2:])]
        return pa.table([*columns, *((none, attr) if new else (attr, none))], [*_KEY, "old", "new"])

    def step(before: _Snapshot | None, now: _Snapshot | None) -> Iterator[pa.Table]:
        """``before`` and ``now``: successive snapshots with rows in this part, maybe of different projects."""
        follows = before is not None and now is not None and before.project == now.project and now.ord == before.ord + 1
        if before is not None and before.ord + 1 < before.n:
            yield side(before.unmatched(now if follows else None), before.ord + 1, False)
        if now is not None and now.ord > 0:
            yield side(now.unmatched(before if follows else None), now.ord, True)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Snapshot]:
        """The snapshots of a partition in turn; ``segment`` numbers differ between neighbours."""
        held: list[pa.RecordBatch] = []
        number = None
        for batch in batches:
            if batch.num_rows:
                seg = batch.column("segment").to_numpy()
                cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
                for a, b in zip(cuts, cuts[1:]):
                    if held and seg[a] != number:
                        yield _Snapshot(pa.Table.from_batches(held).combine_chunks(), chunk_rows)
                        held = []
                    number = seg[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield _Snapshot(pa.Table.from_batches(held).combine_chunks(), chunk_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Snapshot | None = None
        held: list[pa.Table] = []
        many = 0
        for now in chain(segments(batches), [None]):
            for t in step(before, now):
                if t.num_rows:
                    held.append(t)
                    many += t.num_rows
            before = now
            # both sides of a step are there, so that what is held is whole
            if held and (many >= _JOINED or now is None):
                found = _classified(held)
                if found is not None:
                    yield from (found.slice(a, _JOINED) for a in range(0, found.num_rows, _JOINED))
                held, many = [], 0

    return run


def _split(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with ``k``: into how many parts its project is split, by the number of its rows.

    One pass over the column of hashes, which are counted before they are moved.
    """
    n = rows.groupBy("snapshot_hash").agg(F.count(F.lit(1)).alias("__rows"))
    sized = attach(n, snapshots.select("snapshot_hash", "project"), ["snapshot_hash"]).groupBy("project").agg(F.sum("__rows").alias("__rows"))
    return snapshots.join(sized, "project").select("snapshot_hash", "project", "ord", "n", F.ceil(F.col("__rows") / PART_ROWS).cast("int").alias("k"))


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``snapshot_hash, kind, file, item, change``: each difference of a snapshot from the one before.

    ``rows`` has ``snapshot_hash, kind, file, item, attr, delivered_at``: key ``kind, file, item``
    within a snapshot, ``attr`` a hash of what counts as a change. Repeated keys: the row
    delivered last counts. ``snapshots`` is the result of :func:`operators.current.snapshots`; a
    snapshot without rows is empty, so that it removes all of the one before; rows of unknown
    snapshots are left out. Null keys are keys, a null ``attr`` is 0. Other columns are ignored.

    One shuffle of all rows, by project and, where a project has more than :data:`PART_ROWS` of
    them, by a hash of the key: a project or file of any size is spread over tasks, yet the snapshots
    of a key stay together. Python holds two snapshots of one part at a time.
    """
    place = attach(
        rows.select("snapshot_hash", "kind", "file", "item", F.coalesce("attr", F.lit(0)).cast("long").alias("attr"), "delivered_at"),
        _split(rows, snapshots),
        ["snapshot_hash"],
    ).drop("snapshot_hash")
    key = [F.col("kind"), F.col("file"), F.col("item")]
    keyed = place.withColumn("part", F.pmod(F.xxhash64("file", "item"), F.col("k")).cast("int")).drop("k")
    order = ["project", "part", "ord", "kind", "file", "item"]
    sorted_rows = (
        latest(keyed.repartition(parts(rows), "project", "part"), order)
        .select(
            *order,
            "n",
            "attr",
            N.identity(*key).alias("key_hash"),
            N.identity(*key, F.col("attr")).alias("row_hash"),
            F.xxhash64("project", "part", "ord").alias("segment"),
        )
        .sortWithinPartitions(*order)
    )
    found = sorted_rows.mapInArrow(_differences(chunk_rows), "project string, ord int, kind string, file string, item string, change string")
    return attach(found, snapshots.select("project", "ord", "snapshot_hash"), ["project", "ord"]).select(
        "snapshot_hash", "kind", "file", "item", "change"
    )


def symbol_and_todo_rows(symbols: DataFrame, todos: DataFrame) -> DataFrame:
    """Symbols and todos in the form :func:`snapshot_changes` takes; todos have no attributes that can change."""
    zero = F.lit(0.0)
    sym = symbols.select(
        N.hash_id("snapshot_hash").alias("snapshot_hash"),
        F.lit("symbol").alias("kind"),
        N.path("file").alias("file"),
        F.col("name").alias("item"),
        N.identity(N.label("state"), F.col("confidence") + zero, F.col("churn_count"), F.col("instability_score") + zero).alias("attr"),
        "delivered_at",
    )
    todo = todos.select(
        N.hash_id("snapshot_hash").alias("snapshot_hash"),
        F.lit("todo").alias("kind"),
        N.path("file").alias("file"),
        F.col("line").cast("string").alias("item"),
        F.lit(0).cast("long").alias("attr"),
        "delivered_at",
    )
    return sym.unionByName(todo)
