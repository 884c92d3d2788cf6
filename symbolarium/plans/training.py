"""Queries of the general training-data operators: changes between snapshots, and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.operators import changes, current, history
from symbolarium.plans import sql
from symbolarium.session import stored
from symbolarium.sources import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    snaps = stored(current.snapshots(table(spark, root, "project_states")))
    rows = changes.symbol_and_todo_rows(table(spark, root, "symbols"), table(spark, root, "todos"))
    return changes.snapshot_changes(rows, snaps)


def p2_summary(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of changes by kind of each snapshot; snapshots without changes have no row."""
    return p2_found(spark, root).groupBy("snapshot_hash", "kind", "change").agg(F.count(F.lit(1)).alias("n"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    snaps = stored(current.snapshots(table(spark, root, "project_states")))
    symbols = history.symbol_versions(table(spark, root, "symbols"), snaps)
    return symbols.unionByName(history.intent_versions(table(spark, root, "intent_updates")))


def p5_durations(spark: SparkSession, root: str) -> DataFrame:
    """Number of versions of each kind and project, how many are still valid, and the mean days of the ended ones."""
    ended = F.col("valid_to") >= 0
    return (
        p5_found(spark, root)
        .groupBy("kind", "project")
        .agg(
            F.count(F.lit(1)).alias("versions"),
            F.count_if(~ended).alias("open_versions"),
            F.round(F.avg(F.when(ended, F.col("valid_to") - F.col("valid_from"))) / 86400, 4).alias("mean_days"),
        )
    )


#: One pass over each key's snapshots in order: a gap before a row is an addition, one behind it a removal.
P2_SQL = f"""
WITH {sql.CURRENT}, {sql.SNAPSHOTS},
rows_ AS (
  SELECT snapshot_hash, 'symbol' AS kind, file, name AS item, state, confidence, churn_count, instability_score
  FROM current_symbols
  UNION ALL
  SELECT DISTINCT lower(snapshot_hash), 'todo', {sql.path('file')}, line::VARCHAR, NULL, NULL::DOUBLE, NULL::INT, NULL::DOUBLE
  FROM todos),
placed AS (SELECT s.project, s.ord, s.prev_hash, s.next_hash, r.* FROM rows_ r JOIN snaps s USING (snapshot_hash)),
met AS (
  SELECT snapshot_hash, next_hash, prev_hash, kind, file, item, lag(ord) OVER k AS before, ord, lead(ord) OVER k AS behind,
         state IS DISTINCT FROM lag(state) OVER k OR confidence IS DISTINCT FROM lag(confidence) OVER k
           OR churn_count IS DISTINCT FROM lag(churn_count) OVER k OR instability_score IS DISTINCT FROM lag(instability_score) OVER k AS differs
  FROM placed WINDOW k AS (PARTITION BY project, kind, file, item ORDER BY ord))
SELECT snapshot_hash, kind, file, item, CASE WHEN before IS DISTINCT FROM ord - 1 THEN 'added' ELSE 'changed' END AS change
FROM met WHERE prev_hash IS NOT NULL AND (before IS DISTINCT FROM ord - 1 OR differs)
UNION ALL
SELECT next_hash, kind, file, item, 'removed' FROM met WHERE next_hash IS NOT NULL AND behind IS DISTINCT FROM ord + 1"""

P5_SQL = f"""
WITH {sql.CURRENT}, {sql.SNAPSHOTS},
seen AS (
  SELECT s.project, c.file || '#' || c.name AS item, s.ord, s.moment, s.next_moment,
         coalesce(c.state, chr(0)) || chr(1) || coalesce(c.last_touched::VARCHAR, chr(0)) AS attr
  FROM current_symbols c JOIN snaps s USING (snapshot_hash)),
runs AS (
  SELECT *, ord - row_number() OVER (PARTITION BY project, item, attr ORDER BY ord) AS island FROM seen),
symbol_versions AS (
  SELECT 'symbol' AS kind, project, item, min(moment) AS valid_from, coalesce(arg_max(coalesce(next_moment, -1), ord), -1) AS valid_to
  FROM runs GROUP BY project, item, attr, island),
updates AS (
  SELECT * FROM (
    SELECT project, id AS item, epoch(updated_at)::BIGINT AS moment, {sql.label('status')} AS status, delivered_at FROM intent_updates)
  WHERE status <> ''
  QUALIFY row_number() OVER (PARTITION BY project, item, moment ORDER BY delivered_at DESC, status DESC) = 1),
turns AS (
  SELECT * FROM (
    SELECT *, lag(status) OVER (PARTITION BY project, item ORDER BY moment) AS before FROM updates)
  WHERE before IS DISTINCT FROM status)
SELECT * FROM symbol_versions
UNION ALL
SELECT 'intent', project, item, moment, coalesce(lead(moment) OVER (PARTITION BY project, item ORDER BY moment), -1) FROM turns"""

QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary, "p5_found": p5_found, "p5_durations": p5_durations}
SQL = {
    "p2_found": P2_SQL,
    "p2_summary": f"SELECT snapshot_hash, kind, change, count(*) AS n FROM ({P2_SQL}) GROUP BY ALL",
    "p5_found": P5_SQL,
    "p5_durations": f"""SELECT kind, project, count(*) AS versions, count(*) FILTER (valid_to < 0) AS open_versions,
        round(avg(valid_to - valid_from) FILTER (valid_to >= 0) / 86400, 4) AS mean_days FROM ({P5_SQL}) GROUP BY ALL""",
}
