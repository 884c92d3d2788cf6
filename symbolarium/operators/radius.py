"""Blast radii without moving what they reach: each project's graph is packed once and searched in memory, seed by seed.

Steps go along all edges, and back along those of given types. What a seed reaches may be as large as its project,
so that all seeds together reach the square of it; none of these rows is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.sizing import parts
from symbolarium.session import stored

#: Edges and nodes of a project above which it isn't packed: about 1 GB in the task that packs or searches it.
LARGEST = 10_000_000
#: Seeds of a project that one task searches, and the number of tasks (so of copies of its packed graph) beyond which they get more seeds each.
SEEDS, CUTS = 128, 32
#: Rows of a batch of results.
ROWS = 1 << 16


def packable(edge_rows: DataFrame, node_files: DataFrame | None = None) -> DataFrame:
    """``project, packable``: false for projects that are too large, or where an edge lacks its type or weight."""
    rows = edge_rows.select("project", F.expr("type IS NULL OR weight IS NULL").alias("bad"))
    if node_files is not None:
        rows = rows.unionByName(node_files.select("project", F.lit(False).alias("bad")))
    return rows.groupBy("project").agg(((F.count(F.lit(1)) <= LARGEST) & ~F.max("bad")).alias("packable"))


def packed(edge_rows: DataFrame, backwards: list[str], node_files: DataFrame | None = None) -> DataFrame:
    """``project, graph BINARY``: the steps of each project by their origin, then direction, type and neighbour, and the file of each node.

    Nodes are numbered in the order of their ids. ``node_files`` has ``project, id, file``.
    """
    rows = edge_rows.filter("src IS NOT NULL AND dst IS NOT NULL").select("project", "type", "src", "dst", "weight", F.lit(True).alias("step"))
    if node_files is not None:
        files = node_files.filter("file IS NOT NULL").select("project", F.lit("").alias("type"), F.col("id").alias("src"), F.col("file").alias("dst"), F.lit(0.0).alias("weight"), F.lit(False).alias("step"))
        rows = rows.unionByName(files)

    def pack(t: pa.Table) -> pa.Table:
        return _pack(t, backwards)

    return rows.groupBy("project").applyInArrow(pack, "project string, graph binary")


def _ranks(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct texts in the order of their bytes, and the place of each row's."""
    coded = pa.chunked_array(column.chunks, column.type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _pack(t: pa.Table, backwards: list[str]) -> pa.Table:
    named, t = t.filter(pc.invert(t["step"])), t.filter(t["step"])
    ids, ends = _ranks(pa.chunked_array([*t["src"].chunks, *t["dst"].chunks], pa.string()))
    src, dst = ends[: len(t)], ends[len(t) :]
    kinds, kind = _ranks(t["type"])
    back = np.isin(kind, np.flatnonzero(np.isin(kinds.to_pylist(), backwards)))
    at, to = np.concatenate([src, dst[back]]), np.concatenate([dst, src[back]])
    way = np.concatenate([kind, kind[back] + len(kinds)])
    w = t["weight"].to_numpy()
    by = np.lexsort((to, way, at))
    file = np.full(len(ids), -1, np.int32)
    if len(named):
        node = pc.index_in(named["src"], value_set=ids).to_numpy(zero_copy_only=False)
        known = ~np.isnan(node)
        file[node[known].astype(np.int64)] = _ranks(named["dst"])[1][known]
    columns = {"ids": ids, "count": np.bincount(at, minlength=len(ids)).astype(np.int32), "to": to[by], "w": np.concatenate([w, w[back]])[by], "file": file}
    one = pa.table({k: _listed(v if isinstance(v, pa.Array) else pa.array(v)) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(one)
    project = (t if len(t) else named)["project"][0].as_py()
    return pa.table({"project": pa.array([project], pa.string()), "graph": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Graph:
    """A packed graph under search."""

    def __init__(self, graph: bytes) -> None:
        one = pa.ipc.open_stream(graph).read_all().combine_chunks()
        held = {c: one[c].combine_chunks().flatten() for c in one.column_names}
        self.ids = held["ids"]
        self.count, self.to, self.w, self.file = (held[c].to_numpy() for c in ("count", "to", "w", "file"))
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count
        n = len(self.ids)
        # of the current seed: sums, depths (-1 for the seed), and a place for each node to find its first occurrence
        self.score, self.far, self.place = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int64)

    def reached(self, seed: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes in the order of their ids, their scores and depths."""
        self.far[seed] = -1
        frontier, first, found = np.array([seed]), np.ones(1), [np.empty(0, self.to.dtype)]
        for level in range(1, depth + 1):
            n = self.count[frontier].astype(np.int64)
            total = int(n.sum())
            steps = np.repeat(self.start[frontier] - (np.cumsum(n) - n), n) + np.arange(total)
            to, part = self.to[steps], np.repeat(first, n) * self.w[steps]
            np.add.at(self.score, to, part)
            new = self.far[to] == 0
            to, part = to[new], part[new]
            order = np.arange(len(to))
            self.place[to[::-1]] = order[::-1]  # of equal nodes the first one stays
            once = self.place[to] == order
            frontier, first = to[once], part[once]
            self.far[frontier] = level
            found.append(frontier)
            if not len(frontier):
                break
        nodes = np.sort(np.concatenate(found))
        result = nodes, self.score[nodes], self.far[nodes]
        self.score[nodes], self.far[nodes], self.score[seed], self.far[seed] = 0, 0, 0, 0
        return result


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL's ``round``: halves of the shortest decimal form away from zero; ``x`` isn't negative."""
    y = x * 10.0**digits
    r = np.floor(y + 0.5)
    with np.errstate(invalid="ignore"):  # infinite ones are left as they are
        near = np.flatnonzero(~(np.abs(y - np.floor(y) - 0.5) > 1e-3) | (y > 1e12))
    if not len(near):
        return r / 10.0**digits
    values, where = np.unique(x[near], return_inverse=True)
    unit = Decimal(1).scaleb(-digits)
    exact = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) if np.isfinite(v) else v for v in values])
    r = r / 10.0**digits
    r[near] = exact[where]
    return r


def _scores(g: Graph, seed: int, depth: int, digits: int | None) -> dict[str, pa.Array]:
    nodes, score, far = g.reached(seed, depth)
    return {"id": g.ids.take(pa.array(nodes)), "score": pa.array(score if digits is None else rounded(score, digits)), "depth": pa.array(far)}


def _places(g: Graph, seed: int, depth: int, digits: int) -> dict[str, pa.Array]:
    nodes, score, _ = g.reached(seed, depth)
    return {"id": g.ids.take(pa.array(nodes[np.argsort(-rounded(score, digits), kind="stable")])), "place": pa.array(np.arange(1, len(nodes) + 1))}


def _affected(g: Graph, seed: int, depth: int, _: None) -> dict[str, pa.Array]:
    nodes = g.reached(seed, depth)[0]
    files = np.unique(g.file[nodes])
    n = len(nodes)
    return {"files": pa.array([np.count_nonzero(files >= 0)] * (n > 0), pa.int64()), "nodes": pa.array([n] * (n > 0), pa.int64())}


#: What is told of a seed, with the result's columns.
TOLD: dict[str, tuple[Callable, str]] = {
    "scores": (_scores, "project string, seed string, id string, score double, depth int"),
    "places": (_places, "project string, seed string, id string, place bigint"),
    "affected": (_affected, "project string, seed string, files bigint, nodes bigint"),
}


def searched(graphs: DataFrame, seeds: DataFrame, depth: int, told: str, digits: int | None, n: int) -> DataFrame:
    """What :data:`TOLD` names of each seed (``project, seed``) in the graphs of :func:`packed`, by ``n`` tasks."""
    numbers = seeds.groupBy("project").agg(F.least(F.ceil(F.countDistinct("seed") / SEEDS), F.lit(CUTS)).cast("int").alias("cuts"))
    own = seeds.distinct().join(numbers, "project").select("project", F.pmod(F.xxhash64("seed"), "cuts").cast("int").alias("cut"), "seed")
    held = own.groupBy("project", "cut").agg(F.sort_array(F.collect_list("seed")).alias("seeds"))
    copies = graphs.join(numbers, "project").select("project", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "graph")
    work = copies.repartition(n, "project", "cut").join(held, ["project", "cut"]).select("project", "seeds", "graph")
    tell, schema = TOLD[told]
    return work.mapInArrow(functools.partial(_search, tell=tell, depth=depth, digits=digits), schema)


def _search(batches: Iterator[pa.RecordBatch], tell: Callable, depth: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []
    for batch in batches:
        for k in range(batch.num_rows):
            g = Graph(batch["graph"][k].as_py())
            project, seeds = batch["project"][k], batch["seeds"][k].values
            for seed, node in zip(seeds, pc.index_in(seeds, value_set=g.ids).to_pylist(), strict=True):
                if node is None:
                    continue
                found = tell(g, node, depth, digits)
                n = len(next(iter(found.values())))
                waiting.append(pa.table({"project": pa.repeat(project, n), "seed": pa.repeat(seed, n), **found}))
                if sum(map(len, waiting)) >= ROWS or len(waiting) >= 1024:
                    yield from pa.concat_tables(waiting).combine_chunks().to_batches(ROWS)
                    waiting = []
    if waiting:
        yield from pa.concat_tables(waiting).combine_chunks().to_batches(ROWS)


def split(edge_rows: DataFrame, seeds: DataFrame, backwards: list[str], depth: int, told: str, digits: int | None = None, node_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What ``told`` names of the seeds of all projects that can be packed, and ``project`` of the others; None without any."""
    known = stored(packable(edge_rows, node_files))
    others = known.filter("NOT packable").select("project")
    none = others.isEmpty()
    if not none:
        edge_rows, seeds = edge_rows.join(others, "project", "left_anti"), seeds.join(others, "project", "left_anti")
        node_files = None if node_files is None else node_files.join(others, "project", "left_anti")
    graphs = stored(packed(edge_rows, backwards, node_files))
    return searched(graphs, seeds, depth, told, digits, 4 * parts(edge_rows)), None if none else others
