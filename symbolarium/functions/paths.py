"""Path functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends and beginnings of test files' lower-case base names.
TEST_ENDS = (
    "_test.go _test.py _test.rb _spec.rb _test.rs _spec.rs .test.ts .test.tsx .test.js .test.jsx .spec.ts .spec.tsx .spec.js .spec.jsx .test.go"
).split()
TEST_BEGINNINGS = "test_ spec_ test-".split()


def base(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def folder(p: Column) -> Column:
    """What precedes the last slash; "." without one."""
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def extension(p: Column) -> Column:
    """Lower-case extension with its dot; "" without one."""
    return F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1))


def without_extension(p: Column) -> Column:
    return F.regexp_replace(p, r"\.[^./]*$", "")


def cleaned(p: Column) -> Column:
    """Without ``.`` segments, and without ``..`` together with the segment before it."""
    steps = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(back, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(steps, none, step), "/")


def is_test(p: Column) -> Column:
    """Test files, by name."""
    name = F.lower(base(p))
    found = F.lit(False)
    for e in TEST_ENDS:
        found = found | name.endswith(e)
    for b in TEST_BEGINNINGS:
        found = found | name.startswith(b)
    return found


def exported(s: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def test_stem(p: Column) -> Column:
    """Base name of a test file without extension and without what marks it as a test."""
    s = F.regexp_replace(without_extension(base(p)), r"\.test$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\.spec$", ""), "^test_", "")
    s = F.regexp_replace(F.regexp_replace(s, "^spec_", ""), "_test$", "")
    return F.regexp_replace(s, "_spec$", "")


def tested_name(fn: Column) -> Column:
    """The name a test function's name points to, or null: the first of its marks that fits."""
    low, n = F.lower(fn), F.length(fn)
    return (
        F.when(low.startswith("test_") & (n > 5), F.substring(fn, 6, 2**31 - 1))
        .when(fn.startswith("Test") & (n > 4), F.substring(fn, 5, 2**31 - 1))
        .when(low.endswith("_test") & (n > 5), F.regexp_replace(fn, "_test$", ""))
        .when(fn.endswith("Test") & (n > 4), F.regexp_replace(fn, "Test$", ""))
    )
