"""Intents as rows: adding, resolving, closing, and their delimited form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolarium.sources.delimited import record

_RESOLUTION = "struct<method:string,description:string,resolved_at:timestamp_ntz,resolved_by:string>"


def added(intents: DataFrame, new: DataFrame) -> DataFrame:
    """``intents`` and the new ones; columns that one side lacks are null there."""
    return intents.unionByName(new, allowMissingColumns=True)


def ended(intents: DataFrame, id_: str, status: str, resolution: dict[str, str], at: Column) -> DataFrame:
    """``intents`` with the one of the given id set to ``resolved`` or ``closed``, with its resolution and time.

    Raises ``LookupError`` if there is no such intent; the test reads ids only until one is found.
    """
    if intents.filter(F.col("id") == id_).isEmpty():
        raise LookupError(f"there is no intent {id_}")
    mine = F.col("id") == id_
    made = F.struct(F.lit(resolution.get("method")), F.lit(resolution.get("description")), at.cast("timestamp_ntz"), F.lit(resolution.get("by"))).cast(_RESOLUTION)
    values = {"status": F.lit(status), "resolution": made, "updated_at": at.cast("timestamp_ntz")}
    return intents.select(*[F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in intents.columns])


def packed_resolution(c: Column) -> Column:
    """A resolution as ``method:description:seconds:by``; empty without one."""
    seconds = F.unix_timestamp(c["resolved_at"].cast("timestamp")).cast("string")
    return F.when(c.isNull(), "").otherwise(F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in (c["method"], c["description"], seconds, c["resolved_by"])]))


def unpacked_resolution(c: Column) -> Column:
    """The struct of a packed resolution; colons of the description are lost to the fields behind it, as the form doesn't escape them. Null for fewer than four fields."""
    p = F.split(c, ":", 4)
    made = F.struct(p[0].alias("method"), p[1].alias("description"), F.try_element_at(p, F.lit(3)).try_cast("bigint").alias("seconds"), F.try_element_at(p, F.lit(4)).alias("resolved_by"))
    return F.when(F.size(p) == 4, made)


def records(intents: DataFrame) -> DataFrame:
    """``project, line``: intents in the delimited form; tags are joined by commas."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",")
    return intents.select("project", record("id", "type", "severity", "status", "scope", "message", tags, packed_resolution(F.col("resolution"))).alias("line"))


def appended(items: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` and those of ``new`` whose keys aren't there yet; null keys are equal. Of equal new ones the least row stays."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    fresh = new.dropDuplicates(keys).alias("a").join(items.select(*keys).alias("b"), on, "left_anti")
    return items.unionByName(fresh)
