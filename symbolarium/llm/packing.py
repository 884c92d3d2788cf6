"""Filling containers of fixed capacity: bounded-space best fit over a bitset of free space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.sizing import input_bytes

CAPACITY = 2048
#: Containers that each lane keeps open.
OPEN = 64
#: Bytes of texts' files for each lane; beyond :data:`MANY` lanes both their number and their size grow.
LANE_BYTES, MANY = 8 << 20, 2000
#: Containers of a lane are numbered from here on times its number.
LANE = 1 << 40


class OpenBins:
    """At most ``limit`` open containers, found by their free space.

    Bit ``f`` of ``bits`` is set while a container with ``f`` free units is open; the lowest bit
    at or above a size is the best fit, the lowest of all the fullest container.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.at[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def _keep(self, number: int, free: int) -> None:
        if free:  # a full one is closed
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.at[free].append(number)
            self.bits |= 1 << free
            self.open += 1

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        """The container and the place in it of an item of at most the capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.new()
        self._keep(number, free - size)
        return number, self.capacity - free


def lanes(texts: DataFrame) -> int:
    """Number of lanes for texts, by the bytes of their files alone: some thousand containers each."""
    n = input_bytes(texts) / LANE_BYTES
    return max(1, math.ceil(n if n <= MANY else math.sqrt(n * MANY)))


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, open_bins: int = OPEN, lanes: int = 1) -> DataFrame:
    """``<id_col>, part, first, last, container BIGINT, place, lane INT, lanes INT``: each item's place in a container.

    An item above ``capacity`` is cut into full containers of its own and a rest that is placed
    like any item; no other item is cut (``part`` 0 alone). ``first`` and ``last`` (exclusive) are
    the item's units in that part. Empty items take a place and no space; a null size counts as 0,
    repeated ids are items of their own.

    Items are spread over ``lanes`` by a hash of their id and packed in the order of that hash, so
    that the result depends on the items and ``lanes`` (which it names) and on nothing else. A lane
    is a task of its own. Only ids and sizes are shuffled; a lane loses at most ``open_bins``
    containers' free space to being on its own. The memory of a lane is its open containers.
    """
    kind = dict(sizes.dtypes)[id_col]
    items = sizes.select(F.col(id_col), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("__size"), F.xxhash64(id_col).alias("__hash"))
    # The hash's upper part chooses the lane, so that equal ids meet and lanes are even.
    laned = items.withColumn("__lane", F.expr(f"CAST(pmod(shiftrightunsigned(__hash, 20), {lanes}L) AS INT)"))
    spread = laned.repartitionById(lanes, F.col("__lane")).sortWithinPartitions("__hash", "__size", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, bins = None, OpenBins(capacity, open_bins)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, int]] = []
            for i, (size, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                lane = own  # the same in all of a partition
                base, part, at = lane * LANE, 0, 0
                while size - at > capacity:
                    rows.append((i, part, at, at + capacity, base + bins.new(), 0))
                    part, at = part + 1, at + capacity
                number, place = bins.place(size - at)
                rows.append((i, part, at, size, base + number, place))
            if rows:
                t = np.array(rows, np.int64).T
                numbers = [pa.array(np.full(len(rows), x, np.int32)) for x in (lane, lanes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t[0])), *(pa.array(c) for c in t[1:]), *numbers], [id_col, "part", "first", "last", "container", "place", "lane", "lanes"]
                )

    return spread.select(id_col, "__size", "__hash", "__lane").mapInArrow(
        run, f"`{id_col}` {kind}, part long, first long, last long, container long, place long, lane int, lanes int"
    )
