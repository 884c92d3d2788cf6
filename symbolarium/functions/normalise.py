"""Column builders that bring paths, hashes and enums into their canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(c: Column | str) -> Column:
    """Slashes for backslashes, then without one leading ``./``. Null stays null."""
    p = F.translate(F.col(c) if isinstance(c, str) else c, "\\", "/")
    return F.when(p.startswith("./"), F.substring(p, 3, 2**31 - 1)).otherwise(p)


def hash_id(c: Column | str) -> Column:
    """Hashes in lower case."""
    return F.lower(F.col(c) if isinstance(c, str) else c)


def label(c: Column | str) -> Column:
    """Languages, states and statuses: lower case, without outer spaces and tabs."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t")))


def seconds(c: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's time zone is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def identity(*cols: Column) -> Column:
    """64-bit hash in which null, NaN and -0.0 are values like others: null equals null only.

    ``xxhash64`` skips nulls, so that (null, 1) and (1, null) would be the same; each column is
    therefore hashed together with a flag.
    """
    parts = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)
