"""History of changing attributes by presence bitmaps: a bit for each snapshot in which an entity has a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions import normalise as N
from symbolarium.functions.sizing import attach, parts
from symbolarium.operators.current import latest

#: Bits of a bitmap's word.
WORD = 64
#: Seconds of an intent's updates that are put in order together.
SLICE = 30 * 86_400


def _below(p: str) -> str:
    """Mask of the bits below bit ``p``."""
    return f"~shiftleft(-1L, {p})"


def _lowest(x: str) -> str:
    """Place of the lowest bit that is set; the sign bit alone has no number below it."""
    return f"coalesce(bit_count(~{x} & try_subtract({x}, 1L)), {WORD - 1})"


def presence_runs(seen: DataFrame, entity: list[str], attr: str, ord_: str, n: str, times: tuple[str, str] | None = None) -> DataFrame:
    """``entity..., attr, first, last``: longest runs of consecutive ordinals with one value of ``attr``.

    ``seen`` has a row (or several) for each entity and ordinal; ``n`` is above the entity's
    greatest ordinal. For each entity and value a bitmap of ordinals is built by ``bit_or``, in
    words of 64 bits. Runs start at the bits of ``w & ~(w << 1 | carry)`` and end at those of
    ``w & ~(w >> 1 | carry)``, the carries being the neighbouring words' outer bits; a run that
    goes on beyond its word ends at the first end of the words behind it. An ordinal without a row is
    a gap and ends runs. Work and memory grow with the words, one window row each.

    ``times`` names two columns of ``seen`` that depend on entity and ordinal: ``valid_from`` is the
    first of them at the run's first ordinal, ``valid_to`` the second at its last. They go along
    with the word, at most 64 of them.

    Partial aggregates are a word each, so repeated rows cost nothing after the first stage; a
    DataFrame partitioned by ``entity`` isn't shuffled.
    """
    kept = []
    if times:
        timed = F.struct(F.col(ord_).cast("long").alias("o"), *[F.col(t).cast("long").alias(f"t{k}") for k, t in enumerate(times)])
        kept = [F.sort_array(F.collect_set(timed)).alias("__at")]
    words = seen.groupBy(*entity, attr, F.expr(f"CAST(`{ord_}` DIV {WORD} AS LONG)").alias("__word")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST(`{ord_}` % {WORD} AS INT)))").alias("__w"), F.max(n).cast("long").alias("__n"), *kept
    )

    def time(p: str, k: int) -> str:
        return f"element_at(__at, CAST(bit_count(__w & {_below(p)}) + 1 AS INT)).t{k}"

    def end(p: str) -> str:
        return f"named_struct('last', __word * {WORD} + {p}{f', {chr(39)}until{chr(39)}, {time(p, 1)}' if times else ''})"

    # from the highest word down, so that the words behind a word precede its row
    down = Window.partitionBy(*entity, attr).orderBy(F.col("__word").desc())
    above = F.when(F.lag("__word").over(down) == F.col("__word") + 1, F.lag("__w").over(down)).otherwise(0)
    below = F.when(F.lead("__word").over(down) == F.col("__word") - 1, F.lead("__w").over(down)).otherwise(0)
    edges = words.withColumn("__above", above).withColumn("__below", below).withColumns(
        {"__starts": F.expr("__w & ~(shiftleft(__w, 1) | shiftrightunsigned(__below, 63))"), "__ends": F.expr("__w & ~(shiftrightunsigned(__w, 1) | shiftleft(__above, 63))")}
    )
    ended = edges.withColumn("__p", F.expr(_lowest("__ends"))).withColumn("__end", F.expr(f"CASE WHEN __ends <> 0 THEN {end('__p')} END"))
    behind = F.last("__end", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    bits = F.expr(f"sequence(0, CAST(least({WORD - 1}L, __n - 1 - __word * {WORD}) AS INT))")
    begun = ended.withColumn("__behind", behind).filter("__starts <> 0").withColumn("__s", F.explode(bits)).filter("(shiftrightunsigned(__starts, __s) & 1L) = 1L")
    left = begun.withColumn("__left", F.expr(f"__ends & ~{_below('__s')}")).withColumn("__q", F.expr(_lowest("__left")))
    runs = left.withColumn("__e", F.expr(f"CASE WHEN __left <> 0 THEN {end('__q')} ELSE __behind END"))
    out = [F.expr(f"CAST(__word * {WORD} + __s AS INT)").alias("first"), F.col("__e")["last"].cast("int").alias("last")]
    if times:
        out += [F.expr(time("__s", 0)).alias("valid_from"), F.col("__e")["until"].alias("valid_to")]
    return runs.select(*entity, attr, *out)


def symbol_versions(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``kind, project, item, valid_from, valid_to``: versions of symbols by ``state`` and ``last_touched``.

    Rows delivered wrong first and right later count as delivered last. A version lasts from the
    time of its first snapshot to that of the snapshot after its last one, or -1 while it is in the
    project's last snapshot. Null attributes are values, a null file or name reads as empty in ``item``.
    Rows of unknown snapshots are left out.
    """
    seen = attach(
        symbols.select(
            N.hash_id("snapshot_hash").alias("snapshot_hash"),
            N.path("file").alias("file"),
            "name",
            N.identity(N.label("state"), F.col("last_touched")).alias("attr"),
            "delivered_at",
        ),
        snapshots.select("snapshot_hash", "project", "ord", "n"),
        ["snapshot_hash"],
    ).drop("snapshot_hash")
    entity = ["project", "file", "name"]
    current = latest(seen.repartition(parts(symbols), *entity), [*entity, "ord"])
    runs = presence_runs(current, entity, "attr", "ord", "n")
    times = snapshots.select("project", "ord", "at")
    began = attach(runs, times.select("project", F.col("ord").alias("first"), F.col("at").alias("valid_from")), ["project", "first"])
    ended = attach(
        began.withColumn("after", F.col("last") + 1), times.select("project", F.col("ord").alias("after"), F.col("at").alias("valid_to")), ["project", "after"], "left"
    )
    return ended.select(
        F.lit("symbol").alias("kind"), "project", F.concat(F.coalesce("file", F.lit("")), F.lit("#"), F.coalesce("name", F.lit(""))).alias("item"), "valid_from", F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to")
    )


def intent_versions(updates: DataFrame) -> DataFrame:
    """``kind, project, item, valid_from, valid_to``: versions of intents by ``status``.

    The ordinals are those of the intent's own update times. Updates without a status (null or
    blank), time, project or id are left out; of updates of equal time the one delivered last counts, then the
    greatest status. An update that repeats the status continues the version.

    An intent's updates are numbered within slices of :data:`SLICE` seconds, from the number of
    those in the slices before, so that no task orders all updates of one intent.
    """
    entity = ["project", "id"]
    rows = updates.select(*entity, N.seconds("updated_at").alias("at"), N.label("status").alias("status"), "delivered_at")
    rows = rows.filter("status <> '' AND at IS NOT NULL AND project IS NOT NULL AND id IS NOT NULL")
    one = rows.groupBy(*entity, F.expr(f"at DIV {SLICE}").alias("slice"), "at").agg(F.max(F.struct("delivered_at", "status"))["status"].alias("status"))
    sliced = one.repartition(parts(updates), *entity, "slice")
    order = Window.partitionBy(*entity).orderBy("slice")
    slices = sliced.groupBy(*entity, "slice").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("least")).select(
        *entity,
        "slice",
        (F.sum("here").over(order) - F.col("here")).alias("before"),
        F.sum("here").over(Window.partitionBy(*entity)).alias("n"),
        F.coalesce(F.lead("least").over(order), F.lit(-1)).alias("next"),
    )
    within = Window.partitionBy(*entity, "slice").orderBy("at")
    seen = sliced.join(slices, [*entity, "slice"]).select(
        *entity,
        "at",
        F.xxhash64("status").alias("attr"),
        (F.col("before") + F.row_number().over(within) - 1).alias("ord"),
        "n",
        F.coalesce(F.lead("at").over(within), "next").alias("until"),
    )
    runs = presence_runs(seen, entity, "attr", "ord", "n", ("at", "until"))
    return runs.select(F.lit("intent").alias("kind"), "project", F.col("id").alias("item"), "valid_from", "valid_to")
