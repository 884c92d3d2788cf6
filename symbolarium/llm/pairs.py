"""Items that appear together: pairs of a basket's items by blocks, so that no basket is one task's work."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.blocks import BLOCK, block_pairs
from symbolarium.functions.sizing import attach
from symbolarium.session import stored


def together(
    df: DataFrame,
    group: str = "project",
    basket: str = "hash",
    item: str = "file",
    min_together: int = 1,
    min_jaccard: float = 0.0,
    block: int = BLOCK,
) -> DataFrame:
    """``<group>, item_a, item_b, together, n_a, n_b, n, jaccard, lift`` for each pair ``item_a < item_b``.

    ``together`` baskets hold both items, ``n_a`` and ``n_b`` each, ``n`` is the number of the
    group's baskets, ``lift`` is ``together * n / (n_a * n_b)``, how much more often than chance.
    Repeated rows count once; rows with a null group, basket or item are left out; other columns
    are ignored. Only pairs of ``min_together`` and ``min_jaccard`` come out; both also save work
    without losing a pair: an item in fewer baskets has no such pair, nor have two items whose
    numbers of baskets differ by more than the index allows.

    A basket above ``block`` items is split into chunks by a hash of the item; each pair of its
    chunks is a row of its own, so that the products of a huge basket are spread over all tasks.
    Groups, baskets and items are 64-bit hashes until the pairs are counted. Items or groups with equal
    hashes are looked for before that, and other hashes taken if there are any; baskets carry a second hash,
    and two that differ in it alone are an error, so that none are ever merged.

    Facts, items and their numbers are stored as tables when this is called, as each is read several times.
    """
    facts = df.select(F.col(group).alias("g"), F.col(basket).alias("k"), F.col(item).alias("i")).dropna().distinct()
    for seed in itertools.count():
        salt = F.lit(seed)
        keyed = [F.xxhash64(salt, "g").alias("gid"), F.xxhash64(salt, "g", "k").alias("bid"), F.xxhash64(salt, "i").alias("id"), F.hash(salt, "k", "g").alias("mark")]
        rows = stored(facts.select("g", "i", *keyed))
        items = stored(rows.groupBy("g", "i", "gid", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_together))
        if items.groupBy("gid", "id").count().filter("count > 1").isEmpty():
            break
    totals = rows.select("g", "gid", "bid").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n_all"))

    # Spark broadcasts the items only if their stored size is small, else it shuffles both sides
    used = stored(rows.select("gid", "bid", "id", "mark").join(items.select("gid", "id", "n"), ["gid", "id"]).select("gid", "bid", "mark", F.struct("id", "n").alias("x")))
    fits = f"least(a.n, b.n) >= {float(min_jaccard)!r}D * greatest(a.n, b.n)"
    pairs = (
        block_pairs(used, ["gid"], ["gid", "bid"], F.col("x"), F.col("mark"), block)
        .filter(f"(NOT same OR a.id < b.id) AND {fits}")
        .select("gid", F.least("a.id", "b.id").alias("p"), F.greatest("a.id", "b.id").alias("q"), F.expr("CASE WHEN a.id < b.id THEN a.n ELSE b.n END").alias("n_p"), F.expr("CASE WHEN a.id < b.id THEN b.n ELSE a.n END").alias("n_q"))
    )
    counted = pairs.groupBy("gid", "p", "q").agg(F.count(F.lit(1)).alias("together"), F.max("n_p").alias("n_p"), F.max("n_q").alias("n_q"))
    jaccard = F.col("together") / (F.col("n_p") + F.col("n_q") - F.col("together"))
    kept = counted.filter(F.col("together") >= min_together).withColumn("jaccard", jaccard).filter(F.col("jaccard") >= min_jaccard)

    named = items.select("gid", "id", "g", "i")
    first = named.select("gid", F.col("id").alias("p"), "g", F.col("i").alias("ip"))
    second = named.select("gid", F.col("id").alias("q"), F.col("i").alias("iq"))
    full = attach(kept.join(first, ["gid", "p"]).join(second, ["gid", "q"]), totals, ["g"])
    swapped = F.col("iq") < F.col("ip")
    return full.select(
        F.col("g").alias(group),
        F.least("ip", "iq").alias("item_a"),
        F.greatest("ip", "iq").alias("item_b"),
        "together",
        F.when(swapped, F.col("n_q")).otherwise(F.col("n_p")).alias("n_a"),
        F.when(swapped, F.col("n_p")).otherwise(F.col("n_q")).alias("n_b"),
        F.col("n_all").alias("n"),
        "jaccard",
        (F.col("together") * F.col("n_all") / (F.col("n_p") * F.col("n_q"))).alias("lift"),
    )
