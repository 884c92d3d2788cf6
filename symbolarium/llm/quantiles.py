"""Percentiles by dyadic count sketches: one signed sketch for each binary resolution of the encoded values.

A value becomes a whole number of 19 bits that grows with it: 96 steps for each power of two, so
that a step is 0.73 % wide. For each of the 5 finest resolutions a count sketch of 7 rows of 4,096
signed counters estimates how many values a dyadic interval holds; the resolution of 16,384
intervals has fewer of them than a sketch has counters and is counted. Sketches of equal keys are
merged by adding counters, values are removed by negative counts, and a rank is inverted by walking
down the resolutions.

Stated error: between a result and the exact percentile lies at most a share :data:`RANK_ERROR` of
the values, but for a step's width; for each percentile with a probability of
``1 - failure(RANK_ERROR)``, which is above 0.9995, over the choice of hash functions and whatever the
values are. The bound is that of :func:`failure`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 19
STEPS = 96  # for each power of two
ZERO = 1 << (BITS - 1)
#: Fine resolutions that are sketched; the next coarser one is counted.
FINE = 5
COUNTED = 1 << (BITS - FINE)
ROWS, WIDTH = 7, 4096
CELLS = COUNTED + FINE * ROWS * WIDTH
#: Share of the values that may lie between a result and the exact percentile.
RANK_ERROR = 0.02
#: Codes up to which a sketch is kept as the list of its updates.
FEW = CELLS // 8
#: Sketches that are read at once, and bytes of sketches that wait for being merged.
OPEN, WAITING = 64, 64 << 20

_rng = np.random.default_rng(20_011)
_MULTIPLY = _rng.integers(1, 2**63, (FINE, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, (FINE, ROWS), np.uint64)
_SHIFT = np.uint64(64 - (WIDTH - 1).bit_length())
#: A sketch's bytes are records: first one that tells what follows, with the number of values, then codes or cells with their counts.
_RECORD = np.dtype([("at", "<i4"), ("n", "<i8")])
_UPDATES, _COUNTERS = -1, -2


def failure(rank_error: float) -> float:
    """A bound on the probability that more than ``rank_error`` of the values lie between a result and the percentile.

    The walk adds or compares one estimate for each sketched resolution, so it goes wrong only if one
    of them is off by more than ``t = rank_error / FINE`` of the n values. In one row, take the k most
    frequent other intervals. The row puts one of them into the same counter with probability at
    most ``k / WIDTH``. The squares of the others' counts add up to at most ``n^2 / (4 k)``, so that by Chebyshev
    they are off by more with at most ``1 / (4 k WIDTH t^2)``. Signs are symmetric, so each side has half of it,
    and the median of the rows is off only if most rows are off to one side. The least bound over k is taken.
    """
    t = rank_error / FINE
    best = 1.0
    for k in range(1, WIDTH // 2):
        q = min(1.0, k / WIDTH + 1 / (4 * k * WIDTH * t * t)) / 2
        most = sum(math.comb(ROWS, i) * q**i * (1 - q) ** (ROWS - i) for i in range(ROWS // 2 + 1, ROWS + 1))
        best = min(best, 2 * FINE * most)
    return best


def code(value: Column) -> Column:
    """The encoded value; null for null, NaN and infinite values, which aren't counted."""
    v = value.cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1075) * STEPS).cast("int")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.when(v > 0, F.lit(ZERO + 1) + size).when(v < 0, F.lit(ZERO - 1) - size).otherwise(F.lit(ZERO)))


def edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each code."""
    size = np.abs(codes - ZERO) - 1
    low, high = np.exp2(size / STEPS - 1075), np.exp2((size + 1) / STEPS - 1075)
    negative = codes < ZERO
    low, high = np.where(negative, -high, low), np.where(negative, -low, high)
    return np.where(codes == ZERO, 0.0, low), np.where(codes == ZERO, 0.0, high)


def _hashed(node: np.ndarray, j: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of intervals of the ``j``-th finest resolution in row ``i``."""
    h = node.astype(np.uint64) * _MULTIPLY[j, i] + _ADD[j, i]
    h ^= h >> np.uint64(31)
    h *= _MULTIPLY[j, (i + 1) % ROWS]
    cell = COUNTED + (j * ROWS + i) * WIDTH + (h >> _SHIFT).astype(np.int64)
    return cell, 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def counters(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All counters of one sketch after the given updates."""
    out = np.zeros(CELLS, np.int64)
    np.add.at(out, codes >> FINE, counts)
    for j in range(FINE):
        for i in range(ROWS):
            cell, sign = _hashed(codes >> j, j, i)
            np.add.at(out, cell, sign * counts)
    return out


def _packed(kind: int, at: np.ndarray, n: np.ndarray, total: int) -> bytes:
    out = np.empty(len(at) + 1, _RECORD)
    out["at"][0], out["n"][0] = kind, total
    out["at"][1:], out["n"][1:] = at, n
    return out.tobytes()


def _pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    if len(codes) <= FEW:
        return _packed(_UPDATES, codes, counts, int(counts.sum()))
    return _pack_counters(counters(codes, counts))


def _pack_counters(cells: np.ndarray) -> bytes:
    at = np.flatnonzero(cells)
    return _packed(_COUNTERS, at, cells[at], int(cells[:COUNTED].sum()))


def _added(sketches: list[bytes]) -> bytes:
    """The sum of sketches: of their updates while these are few, else of their counters."""
    parts = [np.frombuffer(s, _RECORD) for s in sketches]
    lists = [p[1:] for p in parts if p["at"][0] == _UPDATES]
    dense = [p[1:] for p in parts if p["at"][0] == _COUNTERS]
    both = np.concatenate(lists) if lists else np.empty(0, _RECORD)
    codes, place = np.unique(both["at"].astype(np.int64), return_inverse=True)
    counts = np.zeros(len(codes), np.int64)
    np.add.at(counts, place, both["n"])
    codes, counts = codes[counts != 0], counts[counts != 0]
    if not dense:
        return _pack(codes, counts)
    total = counters(codes, counts)
    for d in dense:
        total[d["at"]] += d["n"]
    return _pack_counters(total)


class _Sketches:
    """Some sketches that are read together: updates as one list with their owners, counters as rows."""

    def __init__(self, sketches: list[bytes]):
        parts = [np.frombuffer(s, _RECORD) for s in sketches]
        self.n = len(parts)
        self.dense = {o: p for o, p in enumerate(parts) if p["at"][0] == _COUNTERS}
        lists = [p[1:] for p in parts if p["at"][0] == _UPDATES]
        owners = [o for o, p in enumerate(parts) if p["at"][0] == _UPDATES]
        both = np.concatenate(lists) if lists else np.empty(0, _RECORD)
        self.owner = np.repeat(np.array(owners, np.int64), [len(x) for x in lists])
        self.codes, self.counts = both["at"].astype(np.int64), both["n"]
        self.cells = [[_hashed(self.codes >> j, j, i) for i in range(ROWS)] for j in range(FINE)]
        self.rows = {}
        for o, p in self.dense.items():
            row = np.zeros(CELLS, np.int64)
            row[p["at"][1:]] = p["n"][1:]
            self.rows[o] = row
        # the counted resolution: pairs of owner and interval in order, with how many values come before and within
        coarse = [self.owner * COUNTED + (self.codes >> FINE), *(o * COUNTED + np.flatnonzero(r[:COUNTED]) for o, r in self.rows.items())]
        held = [self.counts, *(r[:COUNTED][r[:COUNTED] != 0] for r in self.rows.values())]
        self.coarse, place = np.unique(np.concatenate(coarse), return_inverse=True)
        self.held = np.zeros(len(self.coarse), np.int64)
        np.add.at(self.held, place, np.concatenate(held))
        self.first = np.searchsorted(self.coarse, np.arange(self.n + 1) * COUNTED)

    def estimate(self, node: np.ndarray, j: int) -> np.ndarray:
        """For each sketch the median over its rows of how many values the interval ``node`` holds."""
        guesses = np.empty((ROWS, self.n))
        for i in range(ROWS):
            cell, sign = _hashed(node, j, i)
            own, signs = self.cells[j][i]
            met = own == cell[self.owner]
            guesses[i] = sign * np.bincount(self.owner[met], signs[met] * self.counts[met], self.n)
            for o, row in self.rows.items():
                guesses[i, o] = sign[o] * row[cell[o]]
        return np.median(guesses, axis=0)

    def inverted(self, ranks: np.ndarray) -> np.ndarray:
        """Code at each sketch's rank (from 0): the interval of the counted resolution, then child by child. 0 for sketches that hold nothing."""
        upto = np.cumsum(self.held)
        base = np.concatenate([[0], upto])[self.first[:-1]]
        owner = self.coarse // COUNTED
        passed = np.bincount(owner, (upto - base[owner]) <= ranks[owner], self.n).astype(np.int64) if len(owner) else np.zeros(self.n, np.int64)
        some = self.first[1:] > self.first[:-1]
        at = np.minimum(self.first[:-1] + passed, np.maximum(self.first[1:] - 1, 0))
        at = np.where(some, at, 0)
        if not len(self.coarse):
            return np.zeros(self.n, np.int64)
        held = self.held[at].astype(np.float64)
        node = self.coarse[at] % COUNTED
        rank = ranks - (upto[at] - base - held)
        for j in range(FINE - 1, -1, -1):
            left = node * 2
            guess = np.clip(self.estimate(left, j), 0, np.maximum(held, 0))  # a child holds no more than the counted interval
            right = rank >= guess
            rank, node = np.where(right, rank - guess, rank), left + right
        return np.where(some, node, 0)


def frequencies(df: DataFrame, keys: list[str], value: Column, count: Column | None = None, bounds: bool = False) -> DataFrame:
    """``keys..., code, n[, low, high]``: how often each code occurs, with ``bounds`` also its least and greatest value.

    ``count`` is 1 for each row, or a column that is negative for rows to be removed. Partial
    aggregates collapse a key of any number of rows to at most 2**19 rows before the shuffle.
    """
    rows = df.select(*keys, value.cast("double").alias("__v"), (F.lit(1) if count is None else count).cast("long").alias("__n"))
    coded = rows.withColumn("code", code(F.col("__v"))).filter("code IS NOT NULL")
    more = [F.min("__v").alias("low"), F.max("__v").alias("high")] if bounds else []
    return coded.groupBy(*keys, "code").agg(F.sum("__n").alias("n"), *more)


def _fields(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _begins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Whether each row's key (the first ``width`` columns; nulls are equal) differs from that of the row before; true for the first."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for c in batch.columns[:width]:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def _lists(codes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Sketches as update lists for segments that begin at ``starts``, all in one buffer; and the segments' numbers of values."""
    many, segments = len(codes), len(starts)
    total = np.add.reduceat(counts, starts)
    out = np.empty(many + segments, _RECORD)
    heads = starts + np.arange(segments)
    body = np.ones(len(out), bool)
    body[heads] = False
    out["at"][heads], out["n"][heads] = _UPDATES, total
    out["at"][body], out["n"][body] = codes, counts
    offsets = (np.append(heads, len(out)) * _RECORD.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), segments, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]), total


def build(frequencies_: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """``keys..., n, sketch BINARY`` from :func:`frequencies`: a sketch of each key, with ``partial`` of each key and partition.

    ``partial`` saves the shuffle by key: what tasks hold is sketched where it is, and :func:`merge` adds it up.
    A sketch of up to :data:`FEW` codes is kept as the list of its updates, which takes less room
    than the counters they add to. That is a matter of form: sketches are linear, and the list is
    hashed into the same counters whenever it is read or meets a sketch in the other form.
    """
    rows = frequencies_ if partial else frequencies_.repartition(*keys)
    # bounds aren't needed here; with them the shuffle is the same as that of a check by the codes' bounds, and Spark runs it once
    more = [c for c in ("low", "high") if c in frequencies_.columns and c not in keys]
    rows = rows.select(*keys, "code", "n", *more).sortWithinPartitions(*keys, "code")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last key, which may go on

        def out(of: pa.RecordBatch, at: np.ndarray, n: np.ndarray, sketches: pa.Array) -> pa.RecordBatch:
            columns = [c.take(pa.array(at)) for c in of.columns[:width]]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), sketches], [*keys, "n", "sketch"])

        def one() -> pa.RecordBatch:
            codes = np.concatenate([b.column(width).to_numpy() for b in held]).astype(np.int64)
            counts = np.concatenate([b.column(width + 1).to_numpy() for b in held])
            return out(held[0], np.array([0]), np.array([counts.sum()]), pa.array([_pack(codes, counts)], pa.binary()))

        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.flatnonzero(_begins(batch, width))
            if held:
                last = held[-1].slice(held[-1].num_rows - 1, 1)
                both = pa.Table.from_batches([last, batch.slice(0, 1)]).combine_chunks().to_batches()[0]
                if not _begins(both, width)[1]:  # the key goes on
                    upto = int(begins[1]) if len(begins) > 1 else batch.num_rows
                    held.append(batch.slice(0, upto))
                    if upto == batch.num_rows:
                        continue
                    begins = begins[1:]
                yield one()
            a, b = int(begins[0]), int(begins[-1])
            if b > a:  # all keys but the last are whole
                codes, counts = (batch.column(width + k).to_numpy()[a:b] for k in (0, 1))
                sketches, n = _lists(codes, counts, begins[:-1] - a)
                yield out(batch, begins[:-1], n, sketches)
            held = [batch.slice(b)]
        if held:
            yield one()

    return rows.mapInArrow(run, f"{_fields(frequencies_, keys)}, n long, sketch binary")


def negated(sketches: DataFrame) -> DataFrame:
    """Sketches that remove their values from what they are merged with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(batch.schema.get_field_index("sketch")).to_pylist():
                records = np.frombuffer(s, _RECORD).copy()
                records["n"] *= -1
                out.append(records.tobytes())
            n = pc.negate(batch.column(batch.schema.get_field_index("n")))
            keys = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("n", "sketch")]
            yield pa.RecordBatch.from_arrays([*keys, n, pa.array(out, pa.binary())], [*(x for x in batch.schema.names if x not in ("n", "sketch")), "n", "sketch"])

    keys = [c for c in sketches.columns if c not in ("n", "sketch")]
    return sketches.select(*keys, "n", "sketch").mapInArrow(run, f"{_fields(sketches, keys)}, n long, sketch binary" if keys else "n long, sketch binary")


def _batch_maker(df: DataFrame, keys: list[str], more: list[tuple[str, pa.DataType]]):
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(k, to_arrow_type(df.schema[k].dataType)) for k in keys] + more

    def make(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return make


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., n, sketch``: the sum of the sketches of equal ``keys``.

    Each task first adds up what it holds, so that about one sketch for each key leaves it; what
    meets afterwards comes in the order of keys and is added key by key.
    """
    make = _batch_maker(sketches, keys, [("n", pa.int64()), ("sketch", pa.binary())])

    def added(in_order: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: dict[tuple, list] = {}  # number of values, sketches, their bytes
            waiting = 0

            def closed() -> pa.RecordBatch:
                done = [(*key, n, _added(held) if len(held) > 1 else held[0]) for key, (n, held, _) in open_.items()]
                open_.clear()
                return make(done)

            for batch in batches:
                for *own, n, sketch in zip(*[c.to_pylist() for c in batch.columns]):
                    key = tuple(own)
                    if key not in open_:
                        if open_ and (waiting > WAITING or (in_order and len(open_) >= 500)):
                            yield closed()  # in order: all of these are whole; else: what follows of them is added later
                            waiting = 0
                        open_[key] = [0, [], 0]
                    entry = open_[key]
                    entry[0] += n
                    entry[1].append(sketch)
                    entry[2] += len(sketch)
                    waiting += len(sketch)
                    if entry[2] > WAITING // 4:  # of a hot key
                        waiting -= entry[2]
                        entry[1] = [_added(entry[1])]
                        entry[2] = 0
            if open_:
                yield closed()

        return run

    schema = f"{_fields(sketches, keys)}, n long, sketch binary"
    near = sketches.select(*keys, "n", "sketch").mapInArrow(added(False), schema)
    met = near.repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(added(True), schema)


def bounds(sketches: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """``keys..., n, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>``: for each sketch the bounds of its percentiles, by rank ``q * (n - 1)``."""
    width = len(keys)
    several = pa.list_(pa.float64())
    make = _batch_maker(sketches, keys, [("n", pa.int64()), ("low", several), ("high", several)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, OPEN):
                columns = [c.to_pylist() for c in batch.slice(a, OPEN).columns]
                size = np.array(columns[width], np.int64)
                held = _Sketches(columns[width + 1])
                low, high = zip(*[edges(held.inverted(q * (size - 1))) for q in probabilities])
                rows = [(*k, n, x, y) for *k, n, x, y in zip(*columns[:width], columns[width], np.stack(low, 1).tolist(), np.stack(high, 1).tolist()) if n > 0]
                if rows:
                    yield make(rows)

    schema = f"{_fields(sketches, keys)}, n long, low array<double>, high array<double>"
    return sketches.select(*keys, "n", "sketch").mapInArrow(run, schema)


def quantiles(sketches: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """``keys..., n, q, low, high``: for each sketch and probability ``q`` the value's bounds, by rank ``q * (n - 1)``.

    The value lies between ``low`` and ``high``, 0.73 % apart, up to the stated rank error. Sketches
    that hold nothing have no rows.
    """
    each = F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in probabilities]).alias("q"), "low", "high")).alias("x")
    return bounds(sketches, keys, probabilities).select(*keys, "n", each).select(*keys, "n", F.col("x")["q"].alias("q"), F.col("x")["low"].alias("low"), F.col("x")["high"].alias("high"))
