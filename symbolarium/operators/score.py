"""Classification of symbols: calls, todos, change scores with decay, percentile thresholds, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.ranking import percentiles

# Days of the decay, newest commits that count, hours of an activity window.
TAU, NEWEST, WINDOW_HOURS = 30.0, 50, 24
#: Lines of a bucket of the finest level in range joins, the factor between levels, and how many there are: the coarsest has a billion lines.
LINES, COARSER, LEVELS = 64, 16, 7


def range_keys(first: str, last: str) -> Column:
    """Keys of a range's buckets: at the finest level at which there are at most 17, however far the range goes."""
    span = f"CAST(`{last}` AS LONG) - `{first}`"
    level = "CASE " + " ".join(f"WHEN {span} < {LINES * COARSER ** (k + 1)}L THEN {k}" for k in range(LEVELS - 1)) + f" ELSE {LEVELS - 1} END"
    width = f"shiftleft({LINES}L, {COARSER.bit_length() - 1} * ({level}))"
    return F.expr(f"transform(sequence(`{first}` DIV {width}, `{last}` DIV {width}), b -> b + shiftleft(CAST({level} AS LONG), 40))")


def point_keys(line: str) -> Column:
    """Keys of the buckets that a line lies in, one for each level."""
    return F.array(*[F.expr(f"`{line}` DIV {LINES * COARSER**k}L + {k << 40}L") for k in range(LEVELS)])


def called(symbols: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """``symbols`` with ``is_called``: some row of ``calls`` has the same ``keys`` (project and name, in any file).

    The calls are reduced to distinct keys first, so that a name called a billion times is one
    row. Null keys aren't called.
    """
    return _flag(symbols, calls.select(*keys).distinct(), keys, "is_called")


def _flag(left: DataFrame, distinct_right: DataFrame, keys: list[str], name: str) -> DataFrame:
    right = distinct_right.withColumn("__hit", F.lit(True))
    return left.drop(name).join(right, keys, "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Points within a range of equal ``keys``, with the smallest range around each as ``owner`` and its ``span``.

    ``points`` has ``keys``, ``point_id`` and ``line``; ``ranges`` has ``keys``, ``owner``, ``first``
    and ``last``. Equal spans: lower ``first``, then ``owner``. A range without an end (``last`` 0 or null)
    holds nothing. Ranges are cut into buckets of lines, which makes the join an equality: a
    point meets the ranges of its own buckets only, however many a file has.
    """
    usable = ranges.filter("last >= first AND first > 0")
    cut = usable.select(*keys, "owner", "first", "last", F.explode(range_keys("first", "last")).alias("__bucket"))
    placed = points.withColumn("__bucket", F.explode(point_keys(line)))
    met = placed.join(cut, [*keys, "__bucket"]).filter(F.col(line).between(F.col("first"), F.col("last")))
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "first", "owner")).alias("__best")
    return met.groupBy(*keys, "point_id", line).agg(best).select(*keys, "point_id", line, F.col("__best.owner").alias("owner"), F.col("__best.span").alias("span"))


def has_todo(symbols: DataFrame, todos: DataFrame, keys: list[str]) -> DataFrame:
    """``symbols`` with ``has_todo``: a todo of equal ``keys`` lies within ``line`` and ``end_line``.

    By the same buckets as :func:`innermost`; a symbol of unknown end has none.
    """
    ranged = symbols.filter("end_line >= line AND line > 0").select(*keys, "name", "line", "end_line", F.explode(range_keys("line", "end_line")).alias("__bucket"))
    points = todos.select(*keys, F.col("line").alias("__at")).distinct().withColumn("__bucket", F.explode(point_keys("__at")))
    hit = ranged.join(points, [*keys, "__bucket"]).filter("__at BETWEEN line AND end_line").select(*keys, "name", "line").distinct()
    return _flag(symbols, hit, [*keys, "name", "line"], "has_todo")


def activity(events: DataFrame, keys: list[str], as_of: Column, ts: str = "ts", size: str = "size", newest: int = NEWEST, tau: float = TAU) -> DataFrame:
    """``keys..., score, events, last``: change score of each key from its ``newest`` changes.

    Changes less than 24 hours older than the newest of their group count as of that one's time:
    a fold in order, as a group's start depends on the group before. Each counts its size, halved
    about every 21 days (``exp(-days / tau)``); where the last change is older than ``tau`` days the
    score fades once more. Times are seconds since 1970; equal times in order of size.
    Each key's changes are cut to the ``newest`` on the map side already, so that arrays are bounded.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(size).desc())
    kept = events.select(*keys, F.col(ts).cast("long").alias("ts"), F.col(size).cast("double").alias("size")).filter("ts IS NOT NULL AND size IS NOT NULL")
    kept = kept.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= newest)
    listed = kept.groupBy(*keys).agg(F.expr("sort_array(collect_list(struct(ts, size)), false)").alias("xs"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    day, span = 86400.0, WINDOW_HOURS * 3600
    now = F.unix_timestamp(as_of) if dict(listed.select(as_of.alias("t")).dtypes)["t"].startswith("timestamp") else as_of.cast("long")

    def fade(t: Column) -> Column:
        return F.exp(-(now - t) / day / tau)

    def step(acc: Column, x: Column) -> Column:
        joins = acc["anchor"].isNotNull() & (acc["anchor"] - x["ts"] < span)
        anchor = F.when(joins, acc["anchor"]).otherwise(x["ts"])
        return F.struct(anchor.alias("anchor"), (acc["total"] + x["size"] * fade(anchor)).alias("total"))

    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.lit(0.0).alias("total"))
    folded = listed.withColumn("__score", F.aggregate("xs", start, step)["total"])
    age = (now - F.col("last")) / day
    silent = F.when(age > tau, F.exp(-(age - tau) / tau)).otherwise(1.0)
    return folded.select(*keys, (F.col("__score") * silent).alias("score"), "events", "last")


def churn(events: DataFrame, keys: list[str], ts: str = "ts", most: int = NEWEST) -> DataFrame:
    """``keys..., churn_count, last_touched``: number of changes, at most ``most``, and the time of the last."""
    return events.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("churn_count"), F.max(ts).alias("last_touched"))


def change_size(hunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., change_size``: changed lines within a symbol's range for each commit, from 1 to 20; a new file counts its span, at most 10.

    ``hunks`` has ``first, last`` (the symbol), ``start, length, changed`` (the hunk) and ``is_new``.
    """
    overlaps = (F.col("start") <= F.col("last")) & (F.col("start") + F.col("length") - 1 >= F.col("first"))
    grown = F.least(F.lit(10), F.max("last") - F.max("first") + 1)
    edited = F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce(F.sum(F.when(overlaps, F.col("changed"))), F.lit(0))))
    return hunks.groupBy(*keys).agg(F.when(F.max("is_new"), grown).otherwise(edited).cast("int").alias("change_size"))


def symbol_commits(symbols: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., name, line, hash, ts, size``: the commits that changed lines of a symbol, with how much they changed of it.

    ``symbols`` has ``keys`` (project and file), ``name, line, end_line``; ``hunks`` has ``keys, hash, ts, start, length, changed,
    is_new``. A hunk and a symbol overlap if either begins within the other, which makes two joins by buckets of
    lines. Removals (length 0) count at the line they follow. Symbols of unknown ends have no commits.
    """
    s = symbols.filter("end_line >= line AND line > 0").select(*keys, "name", "line", "end_line")
    h = hunks.filter("start IS NOT NULL").select(*keys, "hash", "ts", "changed", "is_new", F.greatest("start", F.lit(1)).alias("start"), F.greatest("length", F.lit(1)).alias("length"))
    h = h.withColumn("stop", F.col("start") + F.col("length") - 1)
    within = s.withColumn("__b", F.explode(range_keys("line", "end_line"))).join(h.withColumn("__b", F.explode(point_keys("start"))), [*keys, "__b"]).filter("start BETWEEN line AND end_line")
    around = h.withColumn("__b", F.explode(range_keys("start", "stop"))).join(s.withColumn("__b", F.explode(point_keys("line"))), [*keys, "__b"]).filter("line > start AND line <= stop")
    met = within.drop("__b").unionByName(around.drop("__b")).withColumnsRenamed({"line": "first", "end_line": "last"})
    own = [*keys, "name", "first", "hash", "ts"]
    return change_size(met, own).withColumnsRenamed({"first": "line", "change_size": "size"})


def hunk(header: Column) -> Column:
    """Start and length of a hunk's new side; a missing length is 1."""
    at = r"@@ -\d+,?\d* \+(\d+),?(\d*) @@"
    n = F.regexp_extract(header, at, 2)
    return F.struct(F.try_to_number(F.regexp_extract(header, at, 1), F.lit("999999999")).cast("int").alias("start"), F.when(n == "", 1).otherwise(n.try_cast("int")).alias("length"))


def intent_weight(symbols: DataFrame, intents: DataFrame, keys: list[str], as_of: Column, tau: float = TAU) -> DataFrame:
    """``symbols`` with ``intent_weight``: 1, plus for each active intent whose scope is the symbol's file its severity and recency.

    ``intents`` has ``keys`` (project and file, as the scope names it), ``severity`` and ``updated``
    (seconds since 1970). Weights are summed for each scope before the join.
    """
    recent = F.exp(-(as_of - F.col("updated")) / 86400.0 / tau)
    summed = intents.groupBy(*keys).agg(F.sum(F.col("severity") / 3.0 * recent).alias("__w"))
    return symbols.join(summed, keys, "left").withColumn("intent_weight", 1 + F.coalesce("__w", F.lit(0.0))).drop("__w")


def thresholds(symbols: DataFrame, group: list[str], as_of: Column) -> DataFrame:
    """``group..., score_p90, age_p75``: exact percentiles of positive scores, and of the ages in days of
    symbols that aren't called and have neither mark nor todo. Null where there is no value.

    By ranks over ranges, so that no task holds a group's values."""
    score = F.col("instability_score")
    idle = ~F.col("is_called") & (F.coalesce("intent_marker", F.lit("")) == "") & ~F.col("has_todo")
    age = (as_of - F.col("touched")) / 86400.0
    good = (score > 0) & ~F.isnan(score) & (score < float("inf"))
    both = F.explode(F.array(F.struct(F.lit("score").alias("kind"), F.when(good, score).alias("v")), F.struct(F.lit("age").alias("kind"), F.when(idle, age.cast("double")).alias("v")))).alias("x")
    found = percentiles(symbols.select(*group, both).select(*group, "x.kind", "x.v"), [*group, "kind"], "v", F.when(F.col("kind") == "score", 0.9).otherwise(0.75))
    one = {k: F.max(F.when(F.col("kind") == k, F.col("percentile"))) for k in ("score", "age")}
    limits = found.groupBy(*group).agg(one["score"].alias("score_p90"), one["age"].alias("age_p75"))
    return symbols.select(*group).distinct().join(limits, group, "left")


def classify(symbols: DataFrame, limits: DataFrame, group: list[str], as_of: Column) -> DataFrame:
    """``symbols`` with ``found_state`` and ``found_confidence``: the first that holds of ignored, planned
    (has a todo), unstable (score at the 90th percentile), abandoned (not called, age at the 75th),
    unused (not called), active.

    ``limits`` is the result of :func:`thresholds`, a row for each group.
    """
    age = (as_of - F.col("touched")) / 86400.0
    source = F.col("signal_source")

    def by_source(ast: float, lexical: float, regex: float, other: float) -> Column:
        return F.when(source == "ast", ast).when(source == "lexical", lexical).when(source == "regex", regex).otherwise(other)

    mark = F.coalesce("intent_marker", F.lit(""))
    score = F.col("instability_score")
    good = (score > 0) & ~F.isnan(score) & (score < float("inf"))
    idle = ~F.col("is_called")
    cases = [
        (mark != "", F.lit("ignored"), F.lit(1.0)),
        (F.col("has_todo"), F.lit("planned"), F.lit(0.7)),
        (good & (F.col("score_p90") > 0) & (score >= F.col("score_p90")), F.lit("unstable"), F.lit(0.8)),
        (idle & (F.col("age_p75") > 0) & (age >= F.col("age_p75")), F.lit("abandoned"), by_source(0.85, 0.6, 0.35, 0.7)),
        (idle, F.lit("unused"), by_source(0.9, 0.65, 0.4, 0.6)),
        (F.lit(True), F.lit("active"), F.lit(0.9)),
    ]
    state = sure = None
    for when, value, confidence in cases:
        state = F.when(when, value) if state is None else state.when(when, value)
        sure = F.when(when, confidence) if sure is None else sure.when(when, confidence)
    return symbols.join(limits, group, "left").withColumn("found_state", state).withColumn("found_confidence", sure)


def carried(symbols: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """``symbols`` with the earlier ``instability_score`` as ``base_score`` where a symbol of equal ``keys`` lies at the same lines."""
    at = [*keys, "line", "end_line"]
    old = before.select(*at, F.col("instability_score").alias("__old")).groupBy(*at).agg(F.max("__old").alias("__old"))
    return symbols.join(old, at, "left").withColumn("base_score", F.coalesce("__old", "instability_score")).drop("__old")


def ignored(symbols: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., marker_id, name, line, ignore_type``: the symbol each marker is meant for, by its name or by its line.

    ``markers`` has ``keys, marker_id, mark_name, mark_line, ignore_type``. Of several symbols the
    first by line, then name. The two ways are two equality joins, united.
    """
    named = symbols.select(*keys, F.col("name").alias("mark_name"), "line")
    by_name = markers.join(named, [*keys, "mark_name"]).select(*keys, "marker_id", "ignore_type", F.col("mark_name").alias("name"), "line")
    points = markers.select(*keys, F.col("marker_id").alias("point_id"), F.col("mark_line").alias("at"), "ignore_type")
    ranges = symbols.filter("end_line >= line AND line > 0").select(*keys, "name", "line", "end_line", F.explode(range_keys("line", "end_line")).alias("__b"))
    by_line = points.withColumn("__b", F.explode(point_keys("at"))).join(ranges, [*keys, "__b"]).filter("at BETWEEN line AND end_line")
    both = by_name.unionByName(by_line.select(*keys, F.col("point_id").alias("marker_id"), "ignore_type", "name", "line"))
    first = F.min(F.struct("line", "name")).alias("__f")
    return both.groupBy(*keys, "marker_id", "ignore_type").agg(first).select(*keys, "marker_id", "ignore_type", F.col("__f.name").alias("name"), F.col("__f.line").alias("line"))
