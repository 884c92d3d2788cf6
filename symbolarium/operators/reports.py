"""Reports: filters, counts, first N with a remainder, rankings and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.ranking import placed
from symbolarium.functions.text import escape

# Order in which states suggest a next action, and in which context exports list them.
NEXT_ORDER = ["planned", "unstable", "unused", "abandoned"]
EXPORT_ORDER = ["unstable", "unused", "abandoned", "planned", "active"]
#: States of symbols.
STATES = ["active", "planned", "unstable", "unused", "abandoned", "ignored"]
#: What is to be done in a state.
NEXT_WORDS = {"planned": "finish", "unstable": "stabilise", "unused": "use or remove", "abandoned": "revive or remove"}
#: Order of intent types.
TYPE_ORDER = ["fixme", "todo", "question", "refactor", "hack", "temporary"]


def by_state(symbols: DataFrame, group: list[str]) -> DataFrame:
    return symbols.groupBy(*group, "state").agg(F.count(F.lit(1)).alias("symbols"))


def summary(symbols: DataFrame, todos: DataFrame, group: list[str]) -> DataFrame:
    """Symbols, files, active symbols and unresolved todos of each group; groups with either have a row."""
    s = symbols.groupBy(*group).agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files"), F.count_if(F.col("state") == "active").alias("active"))
    t = todos.groupBy(*group).agg(F.count_if(~F.coalesce("resolved", F.lit(False))).alias("open_todos"))
    return s.join(t, group, "full_outer").fillna(0, ["symbols", "files", "active", "open_todos"])


def health(summarised: DataFrame) -> DataFrame:
    """``score``: whole percent of active symbols; ``band`` by 80 and 60; a bar of 20 cells. No symbols: score 0."""
    score = F.when(F.col("symbols") > 0, F.floor(100.0 * F.col("active") / F.col("symbols"))).otherwise(0).cast("int")
    band = F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor")
    cells = F.floor(F.col("score") / 5).cast("int")
    return summarised.withColumn("score", score).withColumn("band", band).withColumn("bar", F.concat(F.repeat(F.lit("#"), cells), F.repeat(F.lit("-"), F.lit(20) - cells)))


def intent_summary(intents: DataFrame, group: list[str]) -> DataFrame:
    """``group..., facet, key, n``: intents in all, by type, by status, and the severe ones (3 and above), in one pass."""
    facets = F.explode(
        F.array(
            F.struct(F.lit("all").alias("facet"), F.lit("").alias("key")),
            F.struct(F.lit("type").alias("facet"), F.coalesce("type", F.lit("")).alias("key")),
            F.struct(F.lit("status").alias("facet"), F.coalesce("status", F.lit("")).alias("key")),
            F.struct(F.when(F.col("severity") >= 3, "severe").alias("facet"), F.lit("").alias("key")),
        )
    ).alias("x")
    return intents.select(*group, facets).select(*group, "x.facet", "x.key").filter("facet IS NOT NULL").groupBy(*group, "facet", "key").agg(F.count(F.lit(1)).alias("n"))


def first_with_remainder(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with ``place`` and ``more``, the number of those left out.

    The count is an aggregate of its own: the window is then cut to ``n`` rows before the shuffle.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    top = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n)
    return top.join(sizes, group).withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n")


def next_action(symbols: DataFrame, group: list[str]) -> DataFrame:
    """The first symbol (by file and name) of the first state that needs something."""
    order = F.array_position(F.array(*map(F.lit, NEXT_ORDER)), F.col("state"))
    best = F.min(F.struct(order.alias("o"), "file", "name", "state")).alias("b")
    return symbols.filter(F.col("state").isin(*NEXT_ORDER)).groupBy(*group).agg(best).select(*group, "b.state", "b.file", "b.name")


def next_action_text(state: Column, name: Column, file: Column) -> Column:
    """What a next action asks for, in words."""
    verb = F.create_map(*[F.lit(x) for pair in NEXT_WORDS.items() for x in pair])[state]
    return F.concat(verb, F.lit(" "), name, F.lit(" in "), file)


def first_definitions(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the definitions of equal ``keys`` (file and name, with what they belong to) the first by ``order``; null keys are keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def files_by_size(symbols: DataFrame, group: list[str]) -> DataFrame:
    """``group..., file, symbols, place``: files by their number of symbols, most first, then by name."""
    n = symbols.groupBy(*group, "file").agg(F.count(F.lit(1)).alias("symbols"))
    return placed(n, group, [F.col("symbols").desc(), F.col("file")])


def without_states(symbols: DataFrame, states: list[str]) -> DataFrame:
    """Symbols but those of the given states; symbols without a state stay."""
    return symbols.filter(~F.coalesce(F.col("state"), F.lit("")).isin(*states)) if states else symbols


def log_view(symbols: DataFrame, states: list[str]) -> DataFrame:
    """Symbols of the given states, all for none; an unknown state is an error."""
    unknown = sorted({s.strip().lower() for s in states} - set(STATES))
    if unknown:
        raise ValueError(f"unknown states: {', '.join(unknown)}; known are {', '.join(STATES)}")
    return symbols.filter(F.col("state").isin(*[s.strip().lower() for s in states])) if states else symbols


#: Columns of the dumps of symbols, todos and intents.
DUMPS = {"symbols": ["file", "name", "type", "churn_count"], "todos": ["file", "line", "type", "text"], "intents": ["id", "type", "severity", "status", "message"]}


def dump(df: DataFrame, kind: str, group: list[str]) -> DataFrame:
    """``group..., line``: rows as records of the dump's columns, escaped; nulls are empty."""
    return df.select(*group, F.concat_ws("|", *[escape(F.col(c)) for c in DUMPS[kind]]).alias("line"))


def contains_any(columns: list[str], query: str) -> Column:
    """Whether one of the columns contains the text, in any case; an empty text is in all rows."""
    found = F.lit(query == "")
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())), F.lit(False))
    return found


def symbol_view(symbols: DataFrame, state: str | None = None, query: str = "") -> DataFrame:
    """Symbols of a state, or all but active ones, that contain a text."""
    chosen = F.col("state") == state if state else F.coalesce(F.col("state"), F.lit("")) != "active"
    return symbols.filter(chosen & contains_any(["name", "file", "type"], query))


def intent_view(intents: DataFrame, status: str | None = None, severities: list[int] | None = None, types: list[str] | None = None, query: str = "") -> DataFrame:
    """Intents by status ("open" is active or none), severities and types; an empty list of either matches nothing."""
    keep = contains_any(["message", "scope"], query)
    if status == "open":
        keep = keep & F.coalesce(F.col("status"), F.lit("")).isin("active", "")
    elif status:
        keep = keep & (F.col("status") == status)
    for name, values in (("severity", severities), ("type", types)):
        if values is not None:
            keep = keep & (F.col(name).isin(*values) if values else F.lit(False))
    return intents.filter(keep)


def type_rank(c: Column) -> Column:
    """Place of an intent type in its order; unknown types last."""
    at = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), c)
    return F.when(at > 0, at).otherwise(len(TYPE_ORDER) + 1)


def actions(counts: DataFrame, group: list[str], counters: list[str]) -> DataFrame:
    """A row for each counter that isn't zero: columns into rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("n")) for c in counters])).alias("x")
    return counts.select(*group, pairs).select(*group, "x.counter", "x.n").filter("n > 0")


def medians(runs: DataFrame, group: list[str], condition: str, metric: str, base: str) -> DataFrame:
    """Median of each condition and its percent above that of the condition ``base``."""
    m = runs.groupBy(*group, condition).agg(F.median(metric).alias("median"), F.count(F.lit(1)).alias("runs"))
    b = m.filter(F.col(condition) == base).select(*group, F.col("median").alias("__b"))
    return m.join(b, group, "left").withColumn("delta", F.try_divide((F.col("median") - F.col("__b")) * 100, F.col("__b"))).drop("__b")


def cumulative(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``total``: running sum of ``value`` within each group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(value).over(w))


def next_steps_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EXPORT_ORDER)), c)
