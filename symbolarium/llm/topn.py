"""Top N items of every group: sorted runs in buckets, merged by a loser tree that seeks past finished groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.sizing import parts

#: Greater than any key.
_END = (float("inf"),)
#: Rows of a run whose keys are there at once.
SLICE = 512
#: Buckets for each partition of the input.
BUCKETS = 4


class _Run:
    """A sorted run of one bucket. Keys are made of a slice of rows at a time, those that are skipped never."""

    def __init__(self, block: bytes, width: int):
        self.table = pa.ipc.open_stream(block).read_all().combine_chunks()
        self.rows = self.table.num_rows
        self.ends = np.append(np.flatnonzero(~_repeats(self.table, width))[1:], self.rows)
        self.base, self.keys = 0, []
        self.at = 0

    def key(self, at: int) -> tuple:
        if at >= self.rows:
            return _END
        if not self.base <= at < self.base + len(self.keys):
            self.base, self.keys = at, [*zip(*[c.to_pylist() for c in self.table.slice(at, SLICE).columns])]
        return self.keys[at - self.base]

    def next_group(self) -> int:
        """Where the group of the current row ends."""
        return int(self.ends[np.searchsorted(self.ends, self.at, "right")])


def _repeats(t: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    """Whether each row is of the same group as the one before: equal in the first ``width`` columns."""
    same = np.zeros(t.num_rows, bool)
    if t.num_rows > 1:
        same[1:] = True
        for c in t.columns[:width]:
            same[1:] &= pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return same


class LoserTree:
    """Merges runs: each inner node keeps the loser of its match, so that a step costs one path of comparisons."""

    def __init__(self, runs: list[_Run]):
        self.runs, self.k = runs, len(runs)
        self.heads = [r.key(0) for r in runs]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def move(self, at: int) -> None:
        """Set the winner's run to its row ``at`` and play its path anew."""
        w, heads, losers = self.winner, self.heads, self.losers
        run = self.runs[w]
        run.at = at
        heads[w] = run.key(at)
        node = (w + self.k) >> 1
        while node:
            other = losers[node]
            if heads[other] < heads[w]:
                losers[node], w = w, other
            node >>= 1
        self.winner = w

    def top(self, n: int, width: int) -> Iterator[tuple[tuple, int]]:
        """Keys of the ``n`` first rows of each group with their places, in the order of groups."""
        while (head := self.heads[self.winner]) is not _END:
            group, place = head[:width], 0
            while head[:width] == group:
                run = self.runs[self.winner]
                if place < n:
                    place += 1
                    yield head, place
                    self.move(run.at + 1)
                else:
                    self.move(run.next_group())
                head = self.heads[self.winner]


def _runs(n: int, buckets: int, width: int):
    """Cut a sorted partition into blocks by bucket, with the ``n`` first rows of each group."""

    def block(tables: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for t in tables:
                w.write_batch(t)
        return sink.getvalue().to_pybytes()

    def row(bucket: int, tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block(tables)], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None
        last, seen = None, 0  # the group of the row before, and how many rows of it came
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.flatnonzero(~_repeats(batch, width))
            rows = batch.num_rows
            rank = np.arange(rows) - np.repeat(first, np.diff(np.append(first, rows)))
            if last == [c[0].as_py() for c in batch.columns[:width]]:
                rank[: first[1] if len(first) > 1 else rows] += seen
            last, seen = [c[-1].as_py() for c in batch.columns[:width]], int(rank[-1]) + 1
            keep = np.flatnonzero(rank < n)
            kept = batch.take(pa.array(keep))
            of = _bucket(kept.column(0).to_numpy(), buckets)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and of[a] != bucket:
                        yield row(bucket, held)
                        held = []
                    bucket = int(of[a])
                    held.append(kept.slice(a, b - a))
        if held:
            yield row(bucket, held)

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a group's hash; grows with the hash, so that a partition in order of hashes is in order of buckets."""
    return ((h >> 32) + (1 << 31)) * buckets >> 32


def _merge(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Run] = []
        bucket = None
        for batch in batches:
            for own, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and own != bucket:
                    yield from merged(held)
                    held = []
                bucket = own
                held.append(_Run(block.as_py(), width))
        if held:
            yield from merged(held)

    def merged(runs: list[_Run]) -> Iterator[pa.RecordBatch]:
        keys, places = [], []
        for key, place in LoserTree(runs).top(n, width):
            keys.append(key)
            places.append(place)
            if len(keys) == 20_000:
                yield out(keys, places)
                keys, places = [], []
        if keys:
            yield out(keys, places)

    def out(keys: list[tuple], places: list[int]) -> pa.RecordBatch:
        _, *columns = zip(*keys)
        kinds = [pa.int32(), *[pa.string()] * (width - 2), pa.float64(), pa.int64(), pa.bool_(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(places, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, [*_names(width)[1:], "place"])

    return run


def _names(width: int) -> list[str]:
    """Columns of runs: hash of the group, which of its columns are null, the columns; then what orders rows."""
    return ["h", "z", *[f"g{k}" for k in range(width - 2)], "s", "l", "no_item", "i"]


def _hash(group: list[Column]) -> Column:
    return F.xxhash64(*[c.cast("string") for c in group])


def spread(df: DataFrame, group: list[str], item: Column, n: int) -> DataFrame:
    """``df`` in about ``n`` partitions for :func:`top_n`, with a column ``__place``, its partition's number.

    A partition holds a range of the groups' hashes, so that its run has blocks for few buckets, and of
    each group the items of some hashes: a group is spread over about the root of ``n`` partitions.
    """
    salts = max(1, round(n**0.5))
    ranges = -(-n // salts)
    at = F.expr(f"CAST(shiftrightunsigned(__h, 32) * {ranges} DIV {1 << 32} AS INT)")
    # with the sign bit turned over hashes are ordered as the buckets are
    placed = df.withColumn("__h", _hash([F.col(c) for c in group]).bitwiseXOR(F.expr("shiftleft(1L, 63)")))
    placed = placed.withColumn("__place", at * salts + F.pmod(F.xxhash64(item), F.lit(salts)).cast("int")).drop("__h")
    return placed.repartitionById(ranges * salts, F.col("__place"))


def top_n(df: DataFrame, group: list[str], score: Column, second: Column, item: Column, n: int, buckets: int | None = None) -> DataFrame:
    """``group..., item, score, second, place``: the ``n`` rows of each group with the highest score.

    Equal scores: lower ``second`` (a whole number, null last), then lower ``item`` (byte order, null
    last), so that the same rows come out however the input is split; rows equal in all of these are
    as many rows. Rows with a null or NaN score are left out. ``group`` columns are strings, null
    ones too. Other columns are ignored.

    Every partition of ``df`` becomes one sorted run, from which each group's first ``n`` rows are
    stored in blocks by bucket of the group's hash: a group of any size leaves each task as ``n``
    rows. The blocks go straight to the partition of their bucket's range and are merged, one
    bucket at a time. ``buckets``: by default 4 for each partition that the bytes of the input ask
    for (:func:`functions.sizing.parts`). :func:`spread` is how ``df`` is best partitioned.
    """
    tasks = parts(df)
    buckets = buckets or BUCKETS * tasks
    width = len(group) + 2
    strings = [F.col(c).cast("string") for c in group]
    nulls = sum((F.when(c.isNull(), 1 << k).otherwise(0) for k, c in enumerate(strings)), F.lit(0))
    rows = df.select(
        _hash(strings).alias("h"),
        nulls.cast("int").alias("z"),
        *[F.coalesce(c, F.lit("")).alias(f"g{k}") for k, c in enumerate(strings)],
        (-score.cast("double")).alias("s"),
        F.coalesce(second.cast("long"), F.lit(2**62)).alias("l"),
        item.isNull().alias("no_item"),
        F.coalesce(item.cast("string"), F.lit("")).alias("i"),
    ).filter("s IS NOT NULL AND NOT isnan(s)")
    names = _names(width)
    stored = rows.sortWithinPartitions(*names).select(*names).mapInArrow(_runs(n, buckets, width), "bucket int, block binary")
    kinds = ["int", *["string"] * len(group), "double", "long", "boolean", "string"]
    schema = ", ".join(f"{c} {k}" for c, k in zip([*names[1:], "place"], [*kinds, "int"]))
    placed = stored.repartitionById(tasks, F.expr(f"CAST(CAST(bucket AS LONG) * {tasks} DIV {buckets} AS INT)"))
    merged = placed.sortWithinPartitions("bucket").mapInArrow(_merge(n, width), schema)
    return merged.select(
        *[F.when(F.expr(f"(z & {1 << k}) = 0"), F.col(f"g{k}")).alias(c) for k, c in enumerate(group)],
        F.when(~F.col("no_item"), F.col("i")).alias("item"),
        (-F.col("s")).alias("score"),
        F.when(F.col("l") < 2**62, F.col("l")).alias("second"),
        "place",
    )
