"""Queries of the operators in this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolarium.functions import normalise as N
from symbolarium.functions.sizing import attach, parts
from symbolarium.llm import encoding, packing, pairs, quantiles, splitting, topn
from symbolarium.operators.current import latest, snapshots
from symbolarium.plans import sql
from symbolarium.session import checkpoint_dir, stored
from symbolarium.sources import table

#: A case of p1_found has at least this many values, and its 90th percentile above so many medians.
P1_LEAST, P1_TIMES = 200, 5
_P1 = ["project", "language", "metric"]


def _metrics(symbols: DataFrame) -> DataFrame:
    """``project, snapshot_hash, language, metric, value``: the valid values of the current symbol rows."""
    rows = symbols.select(
        "project",
        N.hash_id("snapshot_hash").alias("snapshot_hash"),
        N.path("file").alias("file"),
        "name",
        N.label("language").alias("language"),
        "instability_score",
        "churn_count",
        "delivered_at",
    )
    score, churn = F.col("instability_score"), F.col("churn_count")
    valid = (score > 0) & ~F.isnan(score) & (score < float("inf"))
    return (
        latest(rows, ["snapshot_hash", "file", "name"], parts=parts(symbols))
        .select(
            "project",
            "snapshot_hash",
            "language",
            F.explode(
                F.array(
                    F.struct(F.lit("instability_score").alias("metric"), F.when(valid, score).alias("value")),
                    F.struct(F.lit("churn_count").alias("metric"), F.when(churn > 0, churn.cast("double")).alias("value")),
                )
            ).alias("x"),
        )
        .select("project", "snapshot_hash", "language", "x.metric", "x.value")
        .filter("value IS NOT NULL")
    )


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Skewed metrics, by percentiles of merged sketches with the stated error; what that leaves open is checked exactly.

    Sketches of what each task holds are merged into one for each case, as those of single snapshots
    would be. Where both percentiles are far enough from the limit, by the stated rank error and the
    rank that interpolation adds, they decide. The check of the others finds the codes that hold the
    ranks from the codes' counts and decides by the least and greatest value of these codes; only
    where that leaves it open are values read again.
    """
    checkpoint_dir(spark)
    symbols = table(spark, root, "symbols")
    counted = quantiles.frequencies(_metrics(symbols).filter("project IS NOT NULL AND language IS NOT NULL"), _P1, F.col("value"), bounds=True)
    margin = quantiles.RANK_ERROR + 1 / P1_LEAST
    sketches = quantiles.merge(quantiles.build(counted, _P1, partial=True), _P1).filter(F.col("n") >= P1_LEAST)
    ends = quantiles.bounds(sketches, _P1, [0.5 - margin, 0.5 + margin, 0.9 - margin, 0.9 + margin])
    low, high = F.col("low"), F.col("high")
    decided = ends.withColumn("sure", low[2] > P1_TIMES * high[1]).filter(F.col("sure") | (high[3] > P1_TIMES * low[0])).select(*_P1, F.col("n").alias("total"), "sure")
    upto = F.sum("n").over(Window.partitionBy(*_P1).orderBy("code"))
    # ranks as whole numbers, and what is left over in tenths; sure cases keep the row of their first code, as rank -1
    ranks = "array((total - 1) DIV 2, total DIV 2, (9 * (total - 1)) DIV 10, least((9 * (total - 1)) DIV 10 + 1, total - 1))"
    first = "filter(array(named_struct('r', -1L, 'k', -1)), x -> upto = n)"
    held = (
        counted.repartition(*_P1)
        .withColumn("upto", upto)
        .join(decided, _P1)
        .withColumn("r", F.expr(f"CASE WHEN sure THEN {first} ELSE filter(transform({ranks}, (r, k) -> struct(r, k)), x -> x.r < upto AND x.r >= upto - n) END"))
        .filter("size(r) > 0")
        .select(*_P1, "total", "code", "low", "high", (F.col("upto") - F.col("n")).alias("before"), F.explode("r").alias("x"))
        .select(*_P1, "total", "code", "low", "high", "before", F.col("x.r").alias("rank"), F.col("x.k").alias("k"))
        .checkpoint()
    )
    near = held.filter("k >= 0")
    ends = near.groupBy(*_P1).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in ("low", "high")])
    least, most = _exceeds("low2", "low3", "high0", "high1"), _exceeds("high2", "high3", "low0", "low1")
    sure = held.filter("k < 0").select(*_P1).unionByName(ends.filter(least).select(*_P1))
    open_ = ends.filter(most & ~least).select(*_P1)
    if open_.isEmpty():
        return sure
    codes = near.join(open_, _P1).select(*_P1, "code", "before", "total").distinct()
    projects = open_.select("project").distinct()
    values = _metrics(attach(symbols, projects, ["project"], "left_semi")).withColumn("code", quantiles.code(F.col("value")))
    within = Window.partitionBy(*_P1, "code").orderBy("value")
    placed = attach(values, codes, [*_P1, "code"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    wanted = near.join(open_, _P1).select(*_P1, "total", "code", "rank", "k")
    exact = attach(placed.select(*_P1, "code", "rank", "value"), wanted, [*_P1, "code", "rank"])
    resolved = exact.groupBy(*_P1).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(4)])
    return sure.unionByName(resolved.filter(_exceeds("v2", "v3", "v0", "v1")).select(*_P1))


def _exceeds(top0: str, top1: str, middle0: str, middle1: str) -> Column:
    """Whether the 90th percentile between two values is above so many times the median between two others."""
    share = (9 * (F.col("total") - 1)) % 10 / 10
    top = F.col(top0) + share * (F.col(top1) - F.col(top0))
    return top > P1_TIMES * (F.col(middle0) + F.col(middle1)) / 2


def p1_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each language and metric, from the merged sketches of single snapshots."""
    keys = ["snapshot", "language", "metric"]
    # a snapshot's hash as a number: where two were the same their sketches would be added here already
    values = _metrics(table(spark, root, "symbols")).withColumn("snapshot", F.xxhash64("snapshot_hash"))
    counted = quantiles.frequencies(values, keys, F.col("value"))
    merged = quantiles.merge(quantiles.build(counted, keys), ["language", "metric"])
    found = quantiles.quantiles(merged, ["language", "metric"], [0.25, 0.5, 0.75, 0.9, 0.99])
    return found.select("language", "metric", "n", "q", ((F.col("low") + F.col("high")) / 2).alias("value"))


def _percentiles_by(spark: SparkSession, root: str, by: str) -> DataFrame:
    """Percentiles by ``project`` or ``day`` (of the snapshot), language and metric, from the merged sketches of single snapshots."""
    keys, to = ["project", "snapshot", "language", "metric"], [by, "language", "metric"]
    values = _metrics(table(spark, root, "symbols")).withColumn("snapshot", F.xxhash64("snapshot_hash"))
    sketches = quantiles.build(quantiles.frequencies(values, keys, F.col("value")), keys)
    if by == "day":
        days = snapshots(table(spark, root, "project_states")).select(F.xxhash64("snapshot_hash").alias("snapshot"), F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd").alias("day"))
        sketches = attach(sketches, days, ["snapshot"])
    found = quantiles.quantiles(quantiles.merge(sketches, to), to, [0.25, 0.5, 0.75, 0.9, 0.99])
    return found.select(*to, "n", "q", ((F.col("low") + F.col("high")) / 2).alias("value"))


def p1_percentiles_project(spark: SparkSession, root: str) -> DataFrame:
    return _percentiles_by(spark, root, "project")


def p1_percentiles_day(spark: SparkSession, root: str) -> DataFrame:
    return _percentiles_by(spark, root, "day")


def p1_percentiles_later(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of each language and metric without each project's first snapshot: its sketches are removed from those of all."""
    keys, to = ["snapshot", "language", "metric"], ["language", "metric"]
    values = _metrics(table(spark, root, "symbols")).withColumn("snapshot", F.xxhash64("snapshot_hash"))
    kept = stored(quantiles.build(quantiles.frequencies(values, keys, F.col("value")), keys))
    first = snapshots(table(spark, root, "project_states")).filter("ord = 0").select(F.xxhash64("snapshot_hash").alias("snapshot"))
    gone = quantiles.negated(attach(kept, first, ["snapshot"], "left_semi"))
    found = quantiles.quantiles(quantiles.merge(kept.unionByName(gone), to), to, [0.25, 0.5, 0.75, 0.9, 0.99])
    return found.select(*to, "n", "q", ((F.col("low") + F.col("high")) / 2).alias("value"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    files = _commit_files(spark, root)
    found = pairs.together(files, min_together=4, min_jaccard=0.3)
    return found.filter("together * n >= 2 * n_a * n_b").select("project", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of files of a project that a commit touched together."""
    return pairs.together(_commit_files(spark, root)).select(
        "project",
        F.col("item_a").alias("file_a"),
        F.col("item_b").alias("file_b"),
        F.col("together").alias("co_occurrences"),
        F.col("n_a").alias("commits_a"),
        F.col("n_b").alias("commits_b"),
        F.round("jaccard", 6).alias("jaccard"),
        F.round("lift", 6).alias("lift"),
    )


def _commit_files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "commit_files").select("project", N.hash_id("hash").alias("hash"), N.path("file").alias("file"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _top(spark, root).select("snapshot_hash", "file", F.col("item").alias("name"), "place")


def _top(spark: SparkSession, root: str) -> DataFrame:
    symbols = table(spark, root, "symbols")
    rows = symbols.select(N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), "name", "line", "instability_score", "delivered_at")
    placed = topn.spread(rows, ["snapshot_hash", "file"], F.col("name"), parts(symbols))
    score = F.col("instability_score")
    valid = latest(placed, ["__place", "snapshot_hash", "file", "name"]).filter((score > 0) & ~F.isnan(score) & (score < float("inf")))
    return topn.top_n(valid, ["snapshot_hash", "file"], score, F.col("line"), F.col("name"), 5)


def p4_scores(spark: SparkSession, root: str) -> DataFrame:
    """The same with scores and lines, for reports."""
    return _top(spark, root).select("snapshot_hash", "file", F.col("item").alias("name"), F.col("second").cast("int").alias("line"), "score", "place")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode(table(spark, root, "documents"))


def p6_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Documents of each source, their tokens, and how many decode to their text again (null and empty texts to an empty one)."""
    docs = table(spark, root, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    back = encoding.decode(encoding.encode(docs)).select("doc_id", F.xxhash64("text").alias("back"))
    sizes = encoding.token_counts(docs)
    return (
        docs.select("doc_id", "source", F.xxhash64("text").alias("own"))
        .join(back, "doc_id")
        .join(sizes, "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("own") == F.col("back")).alias("restored"))
    )


def _packed(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return packing.pack(encoding.token_counts(docs), lanes=packing.lanes(docs))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the packing had to cut: their second part exists."""
    return _packed(spark, root).filter("part = 1").select("doc_id")


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root)


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers by how many tokens they hold, and the share of all containers' space that is used."""
    used = _packed(spark, root).groupBy("container").agg(F.sum(F.col("last") - F.col("first")).alias("used"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * packing.CAPACITY), 6).alias("fill"),
    )


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents of more than one piece."""
    pieces = splitting.split(table(spark, root, "documents"), with_text=False)
    return pieces.filter("piece = 1").select("doc_id")


def p8_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split(table(spark, root, "documents"))


_FACTS = f"""facts AS (SELECT DISTINCT project, lower(hash) AS hash, {sql.path('file')} AS file FROM commit_files),
items AS (SELECT project, file, count(*) AS n FROM facts GROUP BY ALL),
totals AS (SELECT project, count(DISTINCT hash) AS n FROM facts GROUP BY ALL),
together AS (SELECT a.project, a.file AS file_a, b.file AS file_b, count(*) AS c
  FROM facts a JOIN facts b ON a.project = b.project AND a.hash = b.hash AND a.file < b.file GROUP BY ALL),
scored AS (SELECT t.*, a.n AS na, b.n AS nb, totals.n AS n, c / (a.n + b.n - c) AS jaccard
  FROM together t JOIN items a ON a.project = t.project AND a.file = t.file_a
  JOIN items b ON b.project = t.project AND b.file = t.file_b JOIN totals ON totals.project = t.project)"""
_VALID = "instability_score > 0 AND NOT isnan(instability_score) AND NOT isinf(instability_score)"
_TOP = f"""WITH {sql.CURRENT}
SELECT snapshot_hash, file, name, line, instability_score AS score,
       (row_number() OVER (PARTITION BY snapshot_hash, file ORDER BY instability_score DESC, line, name))::INT AS place
FROM current_symbols WHERE {_VALID} QUALIFY place <= 5"""

QUERIES = {
    "p1_found": p1_found,
    "p1_percentiles": p1_percentiles,
    "p1_percentiles_project": p1_percentiles_project,
    "p1_percentiles_day": p1_percentiles_day,
    "p1_percentiles_later": p1_percentiles_later,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
}
#: Encoding, packing and cutting can't be said in SQL; the percentiles of p1_percentiles are estimates.
SQL = {
    "p1_found": f"""WITH {sql.CURRENT},
        metrics AS (
          SELECT project, language, 'instability_score' AS metric, instability_score AS value FROM current_symbols WHERE {_VALID}
          UNION ALL SELECT project, language, 'churn_count', churn_count FROM current_symbols WHERE churn_count > 0)
        SELECT project, language, metric FROM metrics WHERE language IS NOT NULL GROUP BY ALL
        HAVING count(*) >= {P1_LEAST} AND quantile_cont(value, 0.9) > {P1_TIMES} * quantile_cont(value, 0.5)""",
    "p3_found": f"WITH {_FACTS} SELECT project, file_a, file_b FROM scored WHERE c >= 4 AND jaccard >= 0.3 AND c * n >= 2 * na * nb",
    "p3_pairs": f"""WITH {_FACTS} SELECT project, file_a, file_b, c AS co_occurrences, na AS commits_a, nb AS commits_b,
        round(jaccard, 6) AS jaccard, round(c * n / (na * nb), 6) AS lift FROM scored""",
    "p4_found": f"SELECT snapshot_hash, file, name, place FROM ({_TOP})",
    "p4_scores": _TOP,
}
