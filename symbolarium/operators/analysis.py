"""Repeated analysis of a source tree: what is known of unchanged files is kept, only the rest is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.operators import extract, snapshots

#: Version of extracted facts; a manifest of another version counts as none.
VERSION = "2"
MANIFEST = "path STRING, content_hash STRING, mtime TIMESTAMP, version STRING"


def current_manifest(manifest: DataFrame, version: str = VERSION) -> DataFrame:
    """Entries of this version."""
    return manifest.filter(F.col("version") == version)


def analysed(listing: DataFrame, manifest: DataFrame, cached: DataFrame, keys: list[str], version: str = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``facts, manifest, changed``: all facts of the listed files, the new manifest, and the files that were read.

    ``listing`` has ``keys`` (the last the path), ``mtime`` and ``content``, ``manifest`` has ``keys, mtime, content_hash,
    version``, ``cached`` the facts of the last analysis. A file keeps its facts if its time is the manifest's; else it is
    read, as a file touched without a change is. Facts of files that are gone aren't kept. Facts come as
    :func:`operators.extract.facts` gives them.
    """
    routed = snapshots.rescan(listing, current_manifest(manifest, version), keys)
    read = routed.filter("route <> 'reuse'")
    fresh = extract.facts(read, keys)
    kept = cached.join(routed.filter("route = 'reuse'").select(*keys), keys, "left_semi").select(*fresh.columns)
    hashed = read.select(*keys, "mtime", F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256).alias("content_hash"), F.lit(version).alias("version"))
    old = manifest.join(routed.filter("route = 'reuse'").select(*keys), keys, "left_semi").select(*hashed.columns)
    return kept.unionByName(fresh), old.unionByName(hashed), read.select(*keys)


def symbols_of(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols from facts: the first definition of each name of a file, with its range, language and tier."""
    first = F.min(F.struct("line", "end_line", "language", F.col("metadata")["source_tier"].alias("tier"))).alias("f")
    found = facts.filter("type = 'function_defined'").groupBy(*keys, "name").agg(first)
    tier = F.coalesce("f.tier", F.when(F.col("f.language") == "go", "ast").otherwise("regex"))
    return found.select(*keys, "name", "f.line", "f.end_line", F.lit("function").alias("type"), "f.language", tier.alias("signal_source"))


def with_history(symbols: DataFrame, before: DataFrame, changed: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``symbols`` with ``churn_count`` and ``last_touched``: those of the last state where the file is unchanged and the symbol was there, else fresh ones.

    ``before`` has ``keys, name, churn_count, last_touched``, ``changed`` the ``keys`` of files that were read, ``fresh`` what
    the commits tell by ``keys, name``; without either a symbol has 0 and null.
    """
    old = before.join(changed.select(*keys).distinct(), keys, "left_anti").select(*keys, "name", F.struct("churn_count", "last_touched").alias("__old"))
    new = fresh.select(*keys, "name", F.struct("churn_count", "last_touched").alias("__new"))
    met = symbols.join(old, [*keys, "name"], "left").join(new, [*keys, "name"], "left")
    use = F.coalesce("__old", "__new")
    return met.withColumn("churn_count", F.coalesce(use["churn_count"], F.lit(0))).withColumn("last_touched", use["last_touched"]).drop("__old", "__new")


def same_facts(facts: DataFrame, known: DataFrame, group: list[str]) -> DataFrame:
    """``group...`` whose facts are the ones of the last analysis, so that nothing needs to be scored again.

    ``known`` is the last :func:`operators.snapshots.fingerprint` of the facts by ``group``.
    """
    return fingerprint_of(facts, group).join(known, [*group, "rows", "mixed", "total"], "left_semi").select(*group)


def fingerprint_of(facts: DataFrame, group: list[str]) -> DataFrame:
    plain = facts.withColumn("metadata", F.to_json(F.array_sort(F.map_entries("metadata"))))
    return snapshots.fingerprint(plain, group, [c for c in plain.columns if c not in group])
