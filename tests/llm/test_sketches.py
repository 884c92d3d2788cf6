import numpy as np
import pytest
from pyspark.sql import functions as F

from symbolarium.llm import pairs, quantiles, topn

VALUES = "g STRING, day INT, v DOUBLE, n INT, code STRING, sketch STRING"


def sketches(spark, rows, keys, count=None):
    df = spark.createDataFrame([(g, d, v, n, "x", "y") for g, d, v, n in rows], VALUES)
    return quantiles.build(quantiles.frequencies(df, keys, F.col("v"), count), keys)


def estimates(frame, keys, qs):
    return {(*[r[k] for k in keys], r.q): (r.n, r.low, r.high) for r in quantiles.quantiles(frame, keys, qs).collect()}


def off(values, q, low, high):
    """Share of the number of values by which the rank of the result is off."""
    v = np.sort(values)
    first, last, rank = np.searchsorted(v, low, "left"), np.searchsorted(v, high, "right"), q * (len(v) - 1)
    return max(0, first - rank, rank - last) / len(v)


QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["normal", "log", "few", "one", "signed"])
def test_rank_error(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(100, 5, 20_000), "log": rng.lognormal(0, 3, 20_000), "few": rng.choice([1.0, 2.0, 1000.0], 5000), "one": np.full(300, 7.0), "signed": rng.normal(0, 1, 20_000) * 10.0 ** rng.integers(-5, 6, 20_000)
    }[kind]
    found = estimates(sketches(spark, [("a", 1, float(v), 1) for v in values], ["g"]), ["g"], QS)
    for q in QS:
        n, low, high = found["a", q]
        assert n == len(values) and off(values, q, low, high) <= quantiles.RANK_ERROR


def test_bound_is_derived():
    assert quantiles.failure(quantiles.RANK_ERROR) < 5e-4
    assert quantiles.failure(0.005) > quantiles.failure(0.02) > quantiles.failure(0.1)
    assert quantiles.COUNTED <= quantiles.ROWS * quantiles.WIDTH  # the counted resolution isn't larger than a sketch


@pytest.mark.parametrize("form", ["updates", "counters"])
@pytest.mark.parametrize(("least", "most", "apart"), [(2, 5, 40), (20, 60, 1), (20, 60, 7), (200, 201, 3), (1500, 2000, 2)])
def test_equally_frequent_codes_stay_within_the_bound(form, least, most, apart):
    """Few codes of equal counts: each collision counts in full."""
    rng = np.random.default_rng([least, apart])
    for _ in range(6):
        groups = []
        for _ in range(32):
            m = int(rng.integers(least, most))
            low = quantiles.ZERO + 100_000 + int(rng.integers(0, 5000))
            groups.append((np.sort(rng.choice(np.arange(low, low + m * apart), m, replace=False)), np.full(m, 100)))
        pack = quantiles._pack if form == "updates" else lambda c, n: quantiles._pack_counters(quantiles.counters(c, n))
        held = quantiles._Sketches([pack(*g) for g in groups])
        size = np.array([n.sum() for _, n in groups])
        for q in QS:
            ranks = q * (size - 1)
            for (codes, counts), code, rank in zip(groups, held.inverted(ranks).tolist(), ranks):
                before, upto = counts[codes < code].sum(), counts[codes <= code].sum()
                assert max(0, before - rank, rank - upto) <= quantiles.RANK_ERROR * counts.sum()


def test_both_forms_are_the_same_sketch():
    rng = np.random.default_rng(9)
    codes = np.sort(rng.choice(1 << quantiles.BITS, 3000, replace=False))
    counts = rng.integers(1, 50, 3000)
    dense = quantiles._pack_counters(quantiles.counters(codes, counts))
    half = [quantiles._pack(codes[::2], counts[::2]), quantiles._pack_counters(quantiles.counters(codes[1::2], counts[1::2]))]
    assert quantiles._added(half) == dense == quantiles._added([dense])
    ranks = np.array([0.3 * counts.sum()] * 2)
    assert len(set(quantiles._Sketches([dense, quantiles._pack(codes, counts)]).inverted(ranks).tolist())) == 1


def test_many_codes_are_kept_as_counters(spark):
    rng = np.random.default_rng(8)
    values = np.exp(rng.uniform(-600, 600, 120_000))
    found = estimates(sketches(spark, [("a", k % 3, float(v), 1) for k, v in enumerate(values)], ["g", "day"]), ["g", "day"], [0.5])
    merged = quantiles.merge(sketches(spark, [("a", k % 3, float(v), 1) for k, v in enumerate(values)], ["g", "day"]), ["g"])
    n, low, high = estimates(merged, ["g"], [0.5])["a", 0.5]
    assert len(found) == 3 and n == len(values) and off(values, 0.5, low, high) <= quantiles.RANK_ERROR


def test_keys_over_several_batches(spark):
    rows = [(g, 1, float(v), 1) for g in ("a", None, "b") for v in range(1, 15_000)] + [(f"k{i}", 1, 2.0, 1) for i in range(3000)]
    found = estimates(sketches(spark, rows, ["g"]), ["g"], [0.5])
    assert len(found) == 3003 and all(found[g, 0.5][0] == 14_999 for g in ("a", None, "b"))
    partial = quantiles.build(quantiles.frequencies(spark.createDataFrame([(*r, "x", "y") for r in [(g, d, v, n) for g, d, v, n in rows]], VALUES), ["g"], F.col("v")), ["g"], partial=True)
    assert estimates(quantiles.merge(partial, ["g"]), ["g"], [0.5]) == found


def test_days_combine_into_all(spark):
    rng = np.random.default_rng(4)
    rows = [(g, d, float(v), 1) for g in "ab" for d in range(5) for v in rng.lognormal(d, 1, 3000)]
    merged = quantiles.merge(sketches(spark, rows, ["g", "day"]), ["g"])
    whole = sketches(spark, rows, ["g"])
    assert merged.count() == 2
    assert estimates(merged, ["g"], QS) == estimates(whole, ["g"], QS)  # addition loses nothing


def test_deletions(spark):
    rng = np.random.default_rng(5)
    keep, gone = rng.lognormal(0, 1, 4000), rng.lognormal(5, 1, 4000)
    rows = [("a", 1, float(v), 1) for v in [*keep, *gone]] + [("a", 2, float(v), -1) for v in gone]
    left = quantiles.merge(sketches(spark, rows, ["g", "day"], F.col("n")), ["g"])
    both = sketches(spark, [r for r in rows if r[1] == 1], ["g"]).unionByName(quantiles.negated(sketches(spark, [("b", 1, 3.0, 1), *[("a", 1, float(v), 1) for v in gone]], ["g"])))
    assert {k: v for k, v in estimates(quantiles.merge(both, ["g"]), ["g"], QS).items() if k[0] == "a"} == estimates(left, ["g"], QS)
    assert estimates(left, ["g"], QS) == estimates(sketches(spark, [("a", 1, float(v), 1) for v in keep], ["g"]), ["g"], QS)


def test_null_nan_infinite_empty(spark):
    assert sketches(spark, [], ["g"]).count() == 0
    rows = [("a", 1, v, 1) for v in (None, float("nan"), float("inf"), -float("inf"))] + [(None, 1, 2.0, 1), (None, 1, 2.0, 1), ("b", 1, 0.0, 1)]
    found = estimates(sketches(spark, rows, ["g"]), ["g"], [0.5])
    assert set(found) == {(None, 0.5), ("b", 0.5)} and found[None, 0.5][0] == 2
    assert found["b", 0.5][1:] == (0.0, 0.0) and found[None, 0.5][1] <= 2.0 <= found[None, 0.5][2]
    assert estimates(quantiles.merge(sketches(spark, rows, ["g"]), ["g"]), ["g"], [0.5]) == found


def test_codes_grow_with_values(spark):
    values = sorted([0.0, -0.0, 5e-324, 1e-300, 1.0, 1.5, 2.0, 1e300, 1.7e308, -1.0, -1e-300, -1e300])
    codes = [r.c for r in spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(quantiles.code(F.col("v")).alias("c")).collect()]
    assert codes == sorted(codes) and 0 <= min(codes) and max(codes) < 1 << quantiles.BITS
    low, high = quantiles.edges(np.array(codes[:-1]))
    assert all(a <= v * (1 + 1e-9 * (v > 0)) or a <= v + 1e-12 for a, v in zip(low, values))


# ---- pairs ----

FILES = "project STRING, hash STRING, file STRING, g STRING, together INT"


def brute_pairs(rows):
    facts = {r for r in rows if None not in r}
    by, items, totals = {}, {}, {}
    for g, k, i in facts:
        by.setdefault((g, k), []).append(i)
        items[g, i] = items.get((g, i), 0) + 1
        totals.setdefault(g, set()).add(k)
    out = {}
    for (g, _), xs in by.items():
        for a in xs:
            for b in xs:
                if a < b:
                    out[g, a, b] = out.get((g, a, b), 0) + 1
    return {k: (c, items[k[0], k[1]], items[k[0], k[2]], len(totals[k[0]])) for k, c in out.items()}


@pytest.mark.parametrize("block", [3, 8, 1000])
@pytest.mark.parametrize(("least", "jaccard"), [(1, 0.0), (2, 0.3)])
def test_pairs_same_as_loops(spark, block, least, jaccard):
    rng = np.random.default_rng(6)
    rows = [("pq"[k % 2], f"c{k}", f"f{i}") for k in range(30) for i in rng.integers(0, 25, 3 if k % 7 else 40)]
    rows += rows[:20] + [(None, "c", "f"), ("p", None, "f"), ("p", "c", None), ("p", "lonely", "f1")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], FILES)
    found = {(r.project, r.item_a, r.item_b): (r.together, r.n_a, r.n_b, r.n) for r in pairs.together(df, min_together=least, min_jaccard=jaccard, block=block).collect()}
    expected = {k: v for k, v in brute_pairs(rows).items() if v[0] >= least and v[0] / (v[1] + v[2] - v[0]) >= jaccard}
    assert found == expected


def test_items_of_equal_hash_stay_apart(spark, monkeypatch):
    real, calls = F.xxhash64, []

    def weak(*columns):
        if len(columns) == 2 and columns[1] == "i":
            calls.append(1)
            return F.lit(1).cast("long") if len(calls) == 1 else real(*columns)  # the first hash of items is the same for all
        return real(*columns)

    monkeypatch.setattr(pairs.F, "xxhash64", weak)
    rows = [("p", f"c{k}", f"f{i}") for k in range(3) for i in range(3)]
    found = pairs.together(spark.createDataFrame([(*r, "x", 1) for r in rows], FILES)).collect()
    assert len(calls) == 2 and {(r.item_a, r.item_b): r.together for r in found} == {k[1:]: v[0] for k, v in brute_pairs(rows).items()}


def test_pairs_empty(spark):
    assert pairs.together(spark.createDataFrame([], FILES)).count() == 0


# ---- top N ----

ITEMS = "a STRING, b STRING, name STRING, line INT, x DOUBLE, place STRING, item STRING"


def top(spark, rows, n, parts=3, **more):
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], ITEMS).repartition(parts)
    out = topn.top_n(df, ["a", "b"], F.col("x"), F.col("line"), F.col("name"), n, **more)
    return sorted(((r.a, r.b, r.place, r.item, r.score, r.second) for r in out.collect()), key=str)


def brute_top(rows, n):
    groups = {}
    for a, b, name, line, x in rows:
        if x is not None and x == x:
            groups.setdefault((a, b), []).append((-x, line if line is not None else 2**62, name is None, name or "", name, line))
    out = [(*g, k + 1, r[4], -r[0], r[5]) for g, rs in groups.items() for k, r in enumerate(sorted(rs, key=lambda r: r[:4])[:n])]
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("buckets", [1, 5, None])
def test_top_same_as_sort(spark, parts, buckets):
    rng = np.random.default_rng(7)
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [(pick(["g", "h", "", None]), pick(["1", "2", None]), pick(["x", "y", "é", "", None]), pick([1, 2, None]), pick([1.0, 2.0, -1.0, None, float("nan")])) for _ in range(400)]
    assert top(spark, rows, 5, parts, buckets=buckets) == brute_top(rows, 5)


def test_top_edges(spark):
    assert top(spark, [], 5) == []
    rows = [("g", "h", "x", 1, 1.0)] * 9  # repeated rows are as many rows
    assert top(spark, rows, 3) == brute_top(rows, 3)
    big = [("g", str(k % 2), f"n{k}", k, float(k * 7919 % 1000)) for k in range(25_000)]  # a group over several Arrow batches
    assert top(spark, big, 4, 2) == brute_top(big, 4)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_spread_groups_are_whole_again(spark, parts):
    rng = np.random.default_rng(11)
    rows = [("hot" if k % 3 == 0 else f"g{k % 50}", None, f"n{k}", int(rng.integers(9)), float(rng.integers(100))) for k in range(3000)]
    df = topn.spread(spark.createDataFrame([(*r, "c", "d") for r in rows], ITEMS), ["a", "b"], F.col("name"), parts)
    held = df.select("a", F.spark_partition_id().alias("task")).groupBy("a").agg(F.countDistinct("task").alias("n")).collect()
    assert parts == 1 or max(r.n for r in held) > 1  # also the hot group isn't in one partition
    out = topn.top_n(df, ["a", "b"], F.col("x"), F.col("line"), F.col("name"), 4)
    assert sorted(((r.a, r.b, r.place, r.item, r.score, r.second) for r in out.collect()), key=str) == brute_top(rows, 4)


def test_runs_make_keys_of_slices_only(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(topn, "SLICE", 3)
    t = pa.table({"h": [1] * 10 + [2] * 2, "z": [0] * 12, "s": [float(k) for k in range(12)], "l": [0] * 12, "no_item": [False] * 12, "i": ["x"] * 12})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    run = topn._Run(sink.getvalue().to_pybytes(), 2)
    assert run.key(0)[2] == 0.0 and len(run.keys) == 3 and run.next_group() == 10
    run.at = 10
    assert run.key(10)[0] == 2 and run.next_group() == 12 and run.key(12) is topn._END


def test_loser_tree_of_any_width():
    import pyarrow as pa

    for k in (1, 2, 3, 5, 8):
        runs = []
        for j in range(k):
            rows = sorted((g, 0, float(-((g * 7 + j * 3 + i) % 11)), i, False, f"{j}") for g in range(6) for i in range(4) if (g + j) % 4)
            t = pa.table([pa.array(c) for c in zip(*rows)], names=["h", "z", "s", "l", "no_item", "i"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            runs.append((topn._Run(sink.getvalue().to_pybytes(), 2), rows))
        got = list(topn.LoserTree([r for r, _ in runs]).top(3, 2))
        every = sorted(x for _, rows in runs for x in rows)
        expected = [(x, p + 1) for g in sorted({x[0] for x in every}) for p, x in enumerate([x for x in every if x[0] == g][:3])]
        assert got == expected
