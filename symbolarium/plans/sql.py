"""Fragments for the SQL that DuckDB runs beside the Spark queries."""


def path(c: str) -> str:
    slashed = rf"replace({c}, '\', '/')"
    return f"CASE WHEN starts_with({slashed}, './') THEN substr({slashed}, 3) ELSE {slashed} END"


def label(c: str) -> str:
    return f"lower(trim({c}, ' ' || chr(9)))"


#: Current symbol rows with canonical spellings.
CURRENT = f"""current_symbols AS (
  SELECT * FROM (
    SELECT project, lower(snapshot_hash) AS snapshot_hash, {path('file')} AS file, name, line,
           {label('language')} AS language, {label('state')} AS state, confidence, churn_count,
           instability_score, last_touched, delivered_at
    FROM symbols)
  QUALIFY row_number() OVER (PARTITION BY snapshot_hash, file, name ORDER BY delivered_at DESC) = 1)"""

#: Each project's snapshots in order.
SNAPSHOTS = """snaps AS (
  SELECT snapshot_hash, project, updated_at, epoch(updated_at)::BIGINT AS moment,
         row_number() OVER w AS ord,
         lead(snapshot_hash) OVER w AS next_hash,
         lag(snapshot_hash) OVER w AS prev_hash,
         lead(epoch(updated_at)::BIGINT) OVER w AS next_moment
  FROM (SELECT lower(snapshot_hash) AS snapshot_hash, min(project) AS project, min(updated_at) AS updated_at
        FROM project_states GROUP BY 1)
  WINDOW w AS (PARTITION BY project ORDER BY updated_at, snapshot_hash))"""
