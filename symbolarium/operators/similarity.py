"""Related texts: cosine similarity of weighted terms above a threshold, the top K for each text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.sizing import parts
from symbolarium.functions.text import terms
from symbolarium.session import stored

#: Texts of a group that one task compares with as many others, and terms that it does at once.
BLOCK, TERMS = 2500, 1024


def weights(texts: DataFrame, group: str, idf: bool = True) -> DataFrame:
    """``group, id, term, df, w``: unit vectors of texts; ``texts`` has ``group, id, text``.

    The weight is the term's number in the text, times ``ln(1 + N / df)`` with ``idf``; N and df
    count the texts of the group. Texts without words have no rows.
    """
    tf = terms(texts, "text", group, "id").groupBy(group, "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.groupBy(group).agg(F.countDistinct("id").alias("n"))
    raw = F.col("tf") * F.log(1 + F.col("n") / F.col("df")) if idf else F.col("tf").cast("double")
    v = tf.join(df, [group, "term"]).join(n, group).select(group, "id", "term", "df", raw.alias("w"))
    norm = v.groupBy(group, "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.join(norm, [group, "id"]).select(group, "id", "term", "df", (F.col("w") / F.col("norm")).alias("w"))


def related(texts: DataFrame, group: str, threshold: float, top: int, idf: bool = True) -> DataFrame:
    """``group, id, other, similarity``: for each text the ``top`` others of its group that are most similar, at ``threshold`` or more.

    Equal similarities by ``other``. Candidates are pairs that share a term of both texts'
    prefixes: terms from the rarest on, until those left have too small a norm to reach the
    threshold alone. The rarest common term of a pair above the threshold lies in both prefixes, so
    no pair is lost, and the most frequent terms, whose posting lists are the longest, hardly ever
    take part in a join. Candidates are then scored over all terms.
    """
    v = stored(weights(texts, group, idf))  # read four times below
    w = Window.partitionBy(group, "id").orderBy(F.col("df").desc(), F.col("term").desc())
    rest = F.sum(F.col("w") * F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a term is in the prefix if those more frequent than it, together with it, could reach the threshold
    prefix = v.withColumn("__rest", rest).filter(F.col("__rest") >= threshold * threshold - 1e-9).select(group, "id", "term")
    a, b = prefix.alias("a"), prefix.withColumnRenamed("id", "other").alias("b")
    candidates = a.join(b, [group, "term"]).filter("id < other").select(group, "id", "other").distinct()
    left = v.select(group, "id", "term", F.col("w").alias("wa"))
    right = v.select(group, F.col("id").alias("other"), "term", F.col("w").alias("wb"))
    scored = candidates.join(left, [group, "id"]).join(right, [group, "other", "term"]).groupBy(group, "id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    kept = scored.filter(F.col("similarity") >= threshold)
    both = kept.unionByName(kept.select(group, F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))
    rank = F.row_number().over(Window.partitionBy(group, "id").orderBy(F.round("similarity", 9).desc(), "other"))
    return both.withColumn("__r", rank).filter(F.col("__r") <= top).drop("__r")


def related_by_blocks(texts: DataFrame, group: str, threshold: float, top: int, block: int = BLOCK) -> DataFrame:
    """The same as :func:`related`, without pairs of texts in a shuffle.

    Texts of a group that have the same words are compared once, as one class under its least id. A group's classes are
    cut into blocks, and each pair of blocks is one product of matrices in a task: no pair is shuffled but the ``top``
    classes of each class and block. Of a class, its ``top + 1`` least ids are all that can be among a text's ``top`` others.
    """
    bag = F.array_join(F.array_sort(F.collect_list("term")), " ").alias("bag")
    held = stored(terms(texts, "text", group, "id").groupBy(group, "id").agg(bag))
    place = F.row_number().over(Window.partitionBy(group, "bag").orderBy("id"))
    firsts = held.withColumn("__r", place).filter(F.col("__r") <= top + 1).groupBy(group, "bag").agg(F.array_sort(F.collect_list("id")).alias("firsts"))
    sizes = held.groupBy(group, "bag").agg(F.count(F.lit(1)).alias("size"))
    classes = stored(firsts.join(sizes, [group, "bag"]).withColumn("id", F.col("firsts")[0]).withColumn("number", F.monotonically_increasing_id()))
    n = texts.groupBy(group).agg(F.countDistinct("id").alias("n"))
    counted = F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).alias("tf")))
    tf = classes.select(group, "number", "size", F.split("bag", " ").alias("words")).select(group, "number", "size", F.inline(counted))
    df = tf.groupBy(group, "term").agg(F.sum("size").alias("df"), F.count(F.lit(1)).alias("classes"))
    v = tf.drop("size").join(df, [group, "term"]).join(n, group).select(group, "number", "term", "classes", (F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("w"))
    shared = F.col("classes") > 1  # terms of a single class only count in its norm
    lists = [F.collect_list(F.when(shared, F.col(c))).alias(name) for c, name in (("term", "terms"), ("w", "ws"))]
    weighed = v.groupBy(group, "number").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *lists).filter(F.size("terms") > 0)
    one = weighed.join(classes.select(group, "number", "id"), [group, "number"])
    one = stored(one.select(group, "id", "terms", F.transform("ws", lambda w: w / F.col("norm")).alias("ws")))
    number = one.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__n"))
    own = F.pmod(F.xxhash64("id"), F.col("__n")).cast("int")
    sent = one.join(number, group).withColumn("__k", own).withColumn("__m", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    sent = sent.select(group, F.least("__k", "__m").alias("i"), F.greatest("__k", "__m").alias("j"), (F.col("__k") <= F.col("__m")).alias("first"), "id", "terms", "ws")

    def compared(pair: pa.Table) -> pa.Table:
        return _most_similar(pair, group, threshold, top)

    # spread by number: few bytes may be much work, which would come into one task where small partitions are joined
    found = sent.repartition(4 * parts(texts), group, "i", "j").groupBy(group, "i", "j").applyInArrow(compared, f"{group} string, id string, other string, similarity double")
    own_class = classes.filter("size > 1").select(group, "id", F.col("id").alias("other"), F.lit(1.0).alias("similarity")).filter(F.col("similarity") >= threshold)
    others = found.unionByName(own_class).join(classes.select(group, F.col("id").alias("other"), "firsts"), [group, "other"])
    best = others.select(group, "id", F.explode("firsts").alias("other"), "similarity").groupBy(group, "id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.round("similarity", 9)).alias("o"), "other", "similarity"))), 1, top + 1).alias("best")
    )
    by_bag = classes.select(group, "bag", "id").join(best, [group, "id"]).select(group, "bag", "best")
    kept = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, top)
    return held.join(by_bag, [group, "bag"]).select(group, "id", F.explode(kept).alias("x")).select(group, "id", "x.other", "x.similarity")


def _most_similar(pair: pa.Table, group: str, threshold: float, top: int) -> pa.Table:
    """For each text of two blocks the ``top`` of the other block; of a block with itself where there is only one."""
    pair = pair.combine_chunks()
    ids = np.array(pair["id"].to_pylist(), dtype=object)
    order = np.argsort(ids)  # code points: Spark's order of strings
    first = pair["first"].to_numpy()
    terms, ws = pair["terms"].combine_chunks(), pair["ws"].combine_chunks().flatten().to_numpy()
    codes = terms.flatten().dictionary_encode()
    many, codes = len(codes.dictionary), codes.indices.to_numpy()
    rows = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
    diagonal = bool(pair["i"][0].as_py() == pair["j"][0].as_py())
    a = order[first[order]]
    b = a if diagonal else order[~first[order]]
    place_a, place_b = np.full(len(ids), -1), np.full(len(ids), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    sims = np.zeros((len(a), len(b)))
    by_code = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[by_code], np.arange(0, many + TERMS, TERMS))
    for k in range(len(ends) - 1):
        held = by_code[ends[k] : ends[k + 1]]
        sides = []
        for place, n in ((place_a, len(a)), (place_b, len(b))):
            own = held[place[rows[held]] >= 0]
            dense = np.zeros((n, min(TERMS, many - k * TERMS)))
            dense[place[rows[own]], codes[own] - k * TERMS] = ws[own]
            sides.append(dense)
        sims += sides[0] @ sides[1].T
    if diagonal:
        np.fill_diagonal(sims, -1)
    left, right, values = [], [], []
    for x, y, s in ((a, b, sims), (b, a, sims.T))[: 1 if diagonal else 2]:
        if not s.size:
            continue
        rounded = np.round(s, 9)
        least = -np.partition(-rounded, top - 1, axis=1)[:, top - 1] if s.shape[1] > top else np.full(len(x), -np.inf)
        r, c = np.nonzero((rounded >= least[:, None]) & (s >= threshold))
        best = np.lexsort((c, -rounded[r, c], r))
        r, c = r[best], c[best]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < top
        r, c = r[kept], c[kept]
        left.append(ids[x[r]]), right.append(ids[y[c]]), values.append(s[r, c])
    id_, other, sim = (np.concatenate(z) if z else np.array([], kind) for z, kind in ((left, object), (right, object), (values, float)))
    name = pair[group][0].as_py()
    return pa.table({group: pa.array([name] * len(id_), pa.string()), "id": pa.array(id_, pa.string()), "other": pa.array(other, pa.string()), "similarity": pa.array(sim, pa.float64())})


def cosine(texts: DataFrame, group: str, threshold: float) -> DataFrame:
    """``group, id, other, similarity`` (``id < other``): plain cosine of term counts, all pairs at the threshold or more."""
    return related(texts, group, threshold, 2**31 - 1, idf=False).filter("id < other")
