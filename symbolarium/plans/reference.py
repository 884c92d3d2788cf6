"""Queries over whole tables for the engine's own operators, each with the SQL that checks it.

Project states come as tables of all full snapshots, so most queries begin with the current rows of
each project's last snapshot. Clocks are a parameter: everything counts as of :data:`AS_OF`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.functions import globs, paths, ranking, text
from symbolarium.functions import normalise as N
from symbolarium.functions.sizing import attach
from symbolarium.operators import cochange, current, extract, graph, reports, score, similarity, snapshots
from symbolarium.plans import sql
from symbolarium.session import built, checkpoint_dir, stored
from symbolarium.sources import delimited, state_of, states, store, table
from symbolarium.sources.languages import CONFIDENCE, LANGUAGES
from symbolarium.streaming import deliveries

#: 2026-01-01 00:00:00 UTC.
AS_OF = 1_767_225_600

# ---- inputs ----


def _snaps(spark: SparkSession, root: str) -> DataFrame:
    return current.snapshots(table(spark, root, "project_states"))


def symbols(spark: SparkSession, root: str) -> DataFrame:
    """Current symbol rows of each project's last snapshot; other snapshots' rows are dropped before the shuffle."""
    last = _snaps(spark, root).filter("ord = n - 1").select("snapshot_hash")
    rows = table(spark, root, "symbols").select(
        "project", N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), "name", "line", "end_line", "type",
        N.label("language").alias("language"), N.label("state").alias("state"), "confidence", "is_called", "has_todo", "last_touched",
        F.coalesce(N.seconds("last_touched"), F.lit(None)).alias("touched"), "churn_count", "instability_score", "intent_marker", "signal_source", "delivered_at",
    )
    return current.latest(attach(rows, last, ["snapshot_hash"], "left_semi"), ["snapshot_hash", "file", "name"]).drop("delivered_at", "snapshot_hash")


def todos(spark: SparkSession, root: str) -> DataFrame:
    """Todos of each project's last snapshot, the row delivered last of each file and line; then the greatest by text, type and being resolved."""
    last = _snaps(spark, root).filter("ord = n - 1").select("snapshot_hash")
    rows = table(spark, root, "todos").select(
        "project", N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), "line", "text", F.upper(F.btrim("type", F.lit(" \t"))).alias("type"),
        F.coalesce("resolved", F.lit(False)).alias("resolved"), "delivered_at",
    )
    best = F.max(F.struct("delivered_at", "text", "type", "resolved")).alias("b")
    kept = attach(rows, last, ["snapshot_hash"], "left_semi").groupBy("project", "file", "line").agg(best)
    return kept.select("project", "file", "line", "b.text", "b.type", "b.resolved")


def intents(spark: SparkSession, root: str) -> DataFrame:
    """The last update of each intent: by time, then delivery, then status."""
    rows = table(spark, root, "intent_updates").select(
        "project", "id", F.lower("type").alias("type"), "message", "scope", N.seconds("updated_at").alias("updated"), "severity", N.label("status").alias("status"), "tags", "delivered_at"
    )
    best = F.max(F.struct("updated", "delivered_at", "status", "type", "severity", "scope", "message", "tags")).alias("b")
    return rows.groupBy("project", "id").agg(best).select("project", "id", "b.updated", "b.status", "b.type", "b.severity", "b.scope", "b.message", "b.tags")


def commit_files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "commit_files").select("project", N.hash_id("hash").alias("hash"), N.path("file").alias("file")).distinct()


def changes(spark: SparkSession, root: str) -> DataFrame:
    """``project, file, ts, size``: each commit that touched a file."""
    commits = table(spark, root, "commits").select("project", N.hash_id("hash").alias("hash"), N.seconds("committed_at").alias("ts"), "change_size")
    one = commits.groupBy("project", "hash").agg(F.max("ts").alias("ts"), F.max("change_size").alias("size")).filter("ts IS NOT NULL")
    return commit_files(spark, root).join(one, ["project", "hash"]).select("project", "file", "ts", F.coalesce("size", F.lit(1)).alias("size"))


def sources(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a file's source: ``doc_id, project, path, language, content``."""
    docs = table(spark, root, "documents").filter("source = 'source_file' AND project IS NOT NULL AND file IS NOT NULL AND text IS NOT NULL")
    rows = docs.select("doc_id", "project", N.path("file").alias("path"), F.col("text").alias("content"))
    return rows.withColumn("language", extract.language_of(F.col("path"), F.substring_index("content", "\n", 1)))


def lined(spark: SparkSession, root: str) -> DataFrame:
    return extract.lines(extract.files_without_ignored(sources(spark, root)))


SYMBOLS = f"""{sql.SNAPSHOTS},
symbols_ AS (
  SELECT * FROM (
    SELECT project, lower(snapshot_hash) AS snapshot_hash, {sql.path('file')} AS file, name, line, end_line, type, {sql.label('language')} AS language,
      {sql.label('state')} AS state, confidence, is_called, has_todo, last_touched, epoch(last_touched)::BIGINT AS touched, churn_count, instability_score, intent_marker, signal_source, delivered_at
    FROM symbols)
  WHERE snapshot_hash IN (SELECT snapshot_hash FROM snaps WHERE next_hash IS NULL)
  QUALIFY row_number() OVER (PARTITION BY snapshot_hash, file, name ORDER BY delivered_at DESC) = 1)"""
TODOS = f"""todos_ AS (
  SELECT project, {sql.path('file')} AS file, line, text, upper(trim(type, ' ' || chr(9))) AS type, coalesce(resolved, false) AS resolved
  FROM todos WHERE lower(snapshot_hash) IN (SELECT snapshot_hash FROM snaps WHERE next_hash IS NULL)
  QUALIFY row_number() OVER (PARTITION BY project, {sql.path('file')}, line ORDER BY delivered_at DESC, text DESC NULLS LAST, upper(trim(type, ' ' || chr(9))) DESC NULLS LAST, coalesce(resolved, false) DESC) = 1)"""
INTENTS = f"""intents_ AS (
  SELECT project, id, epoch(updated_at)::BIGINT AS updated, {sql.label('status')} AS status, lower(type) AS type, severity, scope, message, tags
  FROM intent_updates QUALIFY row_number() OVER (PARTITION BY project, id
    ORDER BY updated_at DESC, delivered_at DESC, {sql.label('status')} DESC NULLS LAST, lower(type) DESC NULLS LAST, severity DESC NULLS LAST, scope DESC NULLS LAST, message DESC NULLS LAST, tags DESC NULLS LAST) = 1)"""
FACTS = f"facts AS (SELECT DISTINCT project, lower(hash) AS hash, {sql.path('file')} AS file FROM commit_files)"
CHANGES = f"""{FACTS},
changes_ AS (
  SELECT f.project, f.file, c.ts, coalesce(c.size, 1) AS size FROM facts f JOIN (
    SELECT project, lower(hash) AS hash, max(epoch(committed_at)::BIGINT) AS ts, max(change_size) AS size FROM commits GROUP BY 1, 2) c USING (project, hash)
  WHERE c.ts IS NOT NULL)"""


def _language_sql(path: str, first: str) -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))"
    by_ext = " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in x.extensions)}) THEN '{x.id}'" for x in LANGUAGES)
    words = f"string_split_regex(trim(regexp_extract({first}, '^#!(.*)$', 1)), '\\s+')"
    name = f"(CASE WHEN regexp_extract({words}[1], '[^/]*$') = 'env' AND len({words}) > 1 THEN {words}[2] ELSE regexp_extract({words}[1], '[^/]*$') END)"
    by_mark = " ".join(f"WHEN starts_with({name}, '{m}') THEN '{x.id}'" for x in LANGUAGES for m in x.shebangs)
    return f"coalesce(CASE {by_ext} END, CASE {by_mark} END)"


SOURCES = f"""sources_ AS (
  SELECT doc_id, project, {sql.path('file')} AS path, text AS content, {_language_sql(sql.path('file').join('()'), "string_split(text, chr(10))[1]")} AS language
  FROM documents WHERE source = 'source_file' AND project IS NOT NULL AND file IS NOT NULL AND text IS NOT NULL),
lines_ AS (
  SELECT doc_id, project, path, language, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line
  FROM (SELECT *, regexp_split_to_array(content, '\\r?\\n') AS a FROM sources_ WHERE NOT regexp_matches(substr(content, 1, 200), '{extract.IGNORE_FILE}')))"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _definition_sql(line: str = "line") -> str:
    cases = []
    for x in LANGUAGES:
        names = [f"regexp_extract({line}, {_quoted(p)}, 1)" for p in (*x.functions, *x.types)]
        words = ", ".join(map(_quoted, x.keywords))
        cases.append(f"WHEN language = '{x.id}' THEN coalesce({', '.join(f'CASE WHEN {n} NOT IN ({words}, {_quoted('')}) THEN {n} END' for n in names)})")
    return f"CASE {' '.join(cases)} END"


def _calls_sql() -> str:
    cases = []
    white = "' ' || chr(9) || chr(13) || chr(10)"
    for x in LANGUAGES:
        if x.calls:
            found = " || ".join(f"regexp_extract_all(line, {_quoted(p)}, 1)" for p in x.calls)
            comment = " OR ".join(f"starts_with(trim(line, {white}), {_quoted(m)})" for m in x.line_comments) or "false"
            words = ", ".join(map(_quoted, x.keywords))
            cases.append(f"WHEN language = '{x.id}' AND NOT ({comment}) THEN list_filter(list_distinct({found}), lambda n: n NOT IN ({words}, ''))")
    return f"CASE {' '.join(cases)} END"


def _todo_sql(group: int) -> str:
    return "CASE " + " ".join(f"WHEN language = '{x.id}' THEN regexp_extract(line, {_quoted(extract.todo_pattern(x).replace('(?id)', '(?i)'))}, {group})" for x in LANGUAGES) + " END"


DEFINITIONS = f"definitions_ AS (SELECT *, {_definition_sql()} AS name FROM lines_)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(check: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if check:
            SQL[f.__name__] = check
        return f

    return register


# ---- reports ----


@_query(f"WITH {SYMBOLS} SELECT project, state, count(*) AS symbols FROM symbols_ GROUP BY ALL")
def state_summary(spark: SparkSession, root: str) -> DataFrame:
    return reports.by_state(symbols(spark, root), ["project"])


_SUMMARY = f"""WITH {SYMBOLS}, {TODOS},
s AS (SELECT project, count(*) AS symbols, count(DISTINCT file) AS files, count(*) FILTER (state = 'active') AS active FROM symbols_ GROUP BY 1),
t AS (SELECT project, count(*) FILTER (NOT resolved) AS open_todos FROM todos_ GROUP BY 1),
summary_ AS (SELECT coalesce(s.project, t.project) AS project, coalesce(symbols, 0) AS symbols, coalesce(files, 0) AS files, coalesce(active, 0) AS active, coalesce(open_todos, 0) AS open_todos
  FROM s FULL JOIN t USING (project)),
scored AS (SELECT *, CASE WHEN symbols > 0 THEN floor(100.0 * active / symbols) ELSE 0 END::INT AS score FROM summary_)"""


@_query(
    f"""{_SUMMARY} SELECT *, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band,
    repeat('#', score // 5) || repeat('-', 20 - score // 5) AS bar FROM scored"""
)
def health_score(spark: SparkSession, root: str) -> DataFrame:
    return reports.health(reports.summary(symbols(spark, root), todos(spark, root), ["project"]))


@_query(
    f"""{_SUMMARY} SELECT project, u.counter, u.n FROM (
    SELECT project, unnest([{{'counter': 'symbols', 'n': symbols}}, {{'counter': 'files', 'n': files}}, {{'counter': 'open_todos', 'n': open_todos}}]) AS u FROM scored) WHERE u.n > 0"""
)
def action_counters(spark: SparkSession, root: str) -> DataFrame:
    return reports.actions(reports.summary(symbols(spark, root), todos(spark, root), ["project"]), ["project"], ["symbols", "files", "open_todos"])


@_query(
    f"""WITH {SYMBOLS}, n AS (SELECT project, file, count(*) AS n FROM symbols_ WHERE state <> 'active' GROUP BY ALL)
    SELECT project, file, name, state, place, greatest(n - 3, 0) AS more FROM (
      SELECT project, file, name, state, row_number() OVER (PARTITION BY project, file ORDER BY line, name)::INT AS place FROM symbols_ WHERE state <> 'active')
    JOIN n USING (project, file) WHERE place <= 3"""
)
def group_by_file_topn(spark: SparkSession, root: str) -> DataFrame:
    rows = symbols(spark, root).filter("state <> 'active'").select("project", "file", "name", "state", "line")
    return reports.first_with_remainder(rows, ["project", "file"], [F.col("line"), F.col("name")], 3).drop("line")


@_query(
    f"""WITH {SYMBOLS} SELECT project, state, file, name FROM symbols_ WHERE state IN ('planned', 'unstable', 'unused', 'abandoned')
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY list_position(['planned', 'unstable', 'unused', 'abandoned'], state), file, name) = 1"""
)
def next_action(spark: SparkSession, root: str) -> DataFrame:
    return reports.next_action(symbols(spark, root), ["project"])


@_query(
    f"""WITH {INTENTS}, f AS (
      SELECT project, 'all' AS facet, '' AS key FROM intents_ UNION ALL SELECT project, 'type', coalesce(type, '') FROM intents_
      UNION ALL SELECT project, 'status', coalesce(status, '') FROM intents_ UNION ALL SELECT project, 'severe', '' FROM intents_ WHERE severity >= 3)
    SELECT project, facet, key, count(*) AS n FROM f GROUP BY ALL"""
)
def intent_summary(spark: SparkSession, root: str) -> DataFrame:
    return reports.intent_summary(intents(spark, root), ["project"])


@_query(f"""WITH {INTENTS} SELECT project, id, type, severity FROM intents_ WHERE coalesce(status, '') IN ('active', '') AND severity IN (2, 3) AND (contains(lower(message), 'cache') OR contains(lower(scope), 'cache'))""")
def intent_list(spark: SparkSession, root: str) -> DataFrame:
    return reports.intent_view(intents(spark, root), "open", [2, 3], None, "Cache").select("project", "id", "type", "severity")


@_query(f"""WITH {SYMBOLS} SELECT project, file, name, state FROM symbols_ WHERE coalesce(state, '') <> 'active' AND (contains(lower(name), 'parse') OR contains(lower(file), 'parse') OR contains(lower(type), 'parse'))""")
def symbol_search(spark: SparkSession, root: str) -> DataFrame:
    return reports.symbol_view(symbols(spark, root), None, "Parse").select("project", "file", "name", "state")


@_query(
    """WITH d AS (SELECT project, strftime(committed_at, '%Y-%m-%d') AS day, count(DISTINCT lower(hash)) AS commits FROM commits WHERE committed_at IS NOT NULL GROUP BY ALL)
    SELECT project, day, commits, (sum(commits) OVER (PARTITION BY project ORDER BY day))::BIGINT AS total FROM d"""
)
def commits_cumulative(spark: SparkSession, root: str) -> DataFrame:
    days = table(spark, root, "commits").filter("committed_at IS NOT NULL").groupBy("project", F.date_format("committed_at", "yyyy-MM-dd").alias("day")).agg(F.countDistinct(F.lower("hash")).alias("commits"))
    return reports.cumulative(days, ["project"], ["day"], "commits")


@_query(
    """WITH m AS (SELECT source, lang, median(n_chars) AS median, count(*) AS runs FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
    SELECT m.source, m.lang, m.median, m.runs, round((m.median - b.median) * 100 / nullif(b.median, 0), 4) AS delta FROM m LEFT JOIN m b ON b.source = m.source AND b.lang = 'en'"""
)
def median_report(spark: SparkSession, root: str) -> DataFrame:
    out = reports.medians(table(spark, root, "documents").filter("lang IS NOT NULL").select("source", "lang", "n_chars"), ["source"], "lang", "n_chars", "en")
    return out.withColumn("delta", F.round("delta", 4))


@_query(f"WITH {TODOS.replace('todos_ AS', sql.SNAPSHOTS + ', todos_ AS')} SELECT project, file, count(*) AS todos, count(*) FILTER (type = 'FIXME') AS fixmes FROM todos_ WHERE NOT resolved GROUP BY ALL")
def todos_by_file(spark: SparkSession, root: str) -> DataFrame:
    return todos(spark, root).filter("NOT resolved").groupBy("project", "file").agg(F.count(F.lit(1)).alias("todos"), F.count_if(F.col("type") == "FIXME").alias("fixmes"))


# ---- scores ----


@_query(f"WITH {CHANGES} SELECT project, file, least(count(*), 50)::INT AS churn_count, max(ts) AS last_touched FROM changes_ GROUP BY ALL")
def churn_last_touched(spark: SparkSession, root: str) -> DataFrame:
    return score.churn(changes(spark, root), ["project", "file"]).withColumn("churn_count", F.col("churn_count").cast("int"))


_FOLD = f"""list_reduce(xs, lambda acc, x: CASE WHEN acc.anchor - x.anchor < 86400
  THEN {{'anchor': acc.anchor, 'total': acc.total + x.total * exp(-({AS_OF} - acc.anchor) / 86400.0 / 30.0)}}
  ELSE {{'anchor': x.anchor, 'total': acc.total + x.total * exp(-({AS_OF} - x.anchor) / 86400.0 / 30.0)}} END, {{'anchor': 9000000000000::BIGINT, 'total': 0.0::DOUBLE}}).total"""
_SCORES = f"""{CHANGES},
newest AS (SELECT * FROM changes_ QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY ts DESC, size DESC) <= 50),
listed AS (SELECT project, file, list({{'anchor': ts::BIGINT, 'total': size::DOUBLE}} ORDER BY ts DESC, size DESC) AS xs, max(ts) AS last, count(*) AS events FROM newest GROUP BY ALL),
scores_ AS (SELECT project, file, events, last, {_FOLD} * CASE WHEN ({AS_OF} - last) / 86400.0 > 30 THEN exp(-(({AS_OF} - last) / 86400.0 - 30) / 30) ELSE 1 END AS score FROM listed)"""


@_query(f"WITH {_SCORES} SELECT project, file, events, last, round(score, 6) AS score FROM scores_")
def instability_score(spark: SparkSession, root: str) -> DataFrame:
    return score.activity(changes(spark, root), ["project", "file"], F.lit(AS_OF)).withColumn("score", F.round("score", 6))


_IDLE = "NOT is_called AND coalesce(intent_marker, '') = '' AND NOT has_todo"
_GOOD = "instability_score > 0 AND NOT isnan(instability_score) AND NOT isinf(instability_score)"
_LIMITS = f"""limits AS (SELECT project, quantile_cont(instability_score, 0.9) FILTER ({_GOOD}) AS score_p90,
  quantile_cont(({AS_OF} - touched) / 86400.0, 0.75) FILTER ({_IDLE}) AS age_p75 FROM symbols_ GROUP BY project)"""


@_query(f"WITH {SYMBOLS}, {_LIMITS} SELECT project, round(score_p90, 4) AS score_p90, round(age_p75, 4) AS age_p75 FROM limits")
def percentile_thresholds(spark: SparkSession, root: str) -> DataFrame:
    return score.thresholds(symbols(spark, root), ["project"], F.lit(AS_OF)).select("project", F.round("score_p90", 4).alias("score_p90"), F.round("age_p75", 4).alias("age_p75"))


def _tiers(ast: float, lexical: float, regex: float, other: float) -> str:
    return f"CASE signal_source WHEN 'ast' THEN {ast} WHEN 'lexical' THEN {lexical} WHEN 'regex' THEN {regex} ELSE {other} END"


@_query(
    f"""WITH {SYMBOLS}, {_LIMITS}, c AS (
      SELECT project, file, name, signal_source, CASE WHEN coalesce(intent_marker, '') <> '' THEN 'ignored' WHEN has_todo THEN 'planned' WHEN {_GOOD} AND score_p90 > 0 AND instability_score >= score_p90 THEN 'unstable'
        WHEN NOT is_called AND age_p75 > 0 AND ({AS_OF} - touched) / 86400.0 >= age_p75 THEN 'abandoned' WHEN NOT is_called THEN 'unused' ELSE 'active' END AS found_state
      FROM symbols_ JOIN limits USING (project))
    SELECT project, file, name, found_state, (CASE found_state WHEN 'ignored' THEN 1.0 WHEN 'planned' THEN 0.7 WHEN 'unstable' THEN 0.8 WHEN 'abandoned' THEN {_tiers(0.85, 0.6, 0.35, 0.7)}
      WHEN 'unused' THEN {_tiers(0.9, 0.65, 0.4, 0.6)} ELSE 0.9 END)::DOUBLE AS found_confidence FROM c"""
)
def classify_symbols(spark: SparkSession, root: str) -> DataFrame:
    s = symbols(spark, root)
    out = score.classify(s, score.thresholds(s, ["project"], F.lit(AS_OF)), ["project"], F.lit(AS_OF))
    return out.select("project", "file", "name", "found_state", "found_confidence")


@_query(
    f"""WITH {SYMBOLS}, {INTENTS}, w AS (SELECT project, {sql.path('scope')} AS file, sum(severity / 3.0 * exp(-({AS_OF} - updated) / 86400.0 / 30)) AS w FROM intents_ WHERE status = 'active' GROUP BY ALL)
    SELECT project, file, name, round(1 + coalesce(w, 0), 8) AS intent_weight FROM symbols_ LEFT JOIN w USING (project, file)"""
)
def intent_weight(spark: SparkSession, root: str) -> DataFrame:
    active = intents(spark, root).filter("status = 'active'").select("project", N.path("scope").alias("file"), "severity", "updated")
    out = score.intent_weight(symbols(spark, root), active, ["project", "file"], F.lit(AS_OF))
    return out.select("project", "file", "name", F.round("intent_weight", 8).alias("intent_weight"))


_INNER = """placed AS (
  SELECT t.project, t.file, t.line, s.name AS owner, s.end_line - s.line AS span FROM todos_ t JOIN symbols_ s ON s.project = t.project AND s.file = t.file AND t.line BETWEEN s.line AND s.end_line
  WHERE s.end_line >= s.line AND s.line > 0
  QUALIFY row_number() OVER (PARTITION BY t.project, t.file, t.line ORDER BY s.end_line - s.line, s.line, s.name) = 1)"""


@_query(f"WITH {SYMBOLS}, {TODOS}, {_INNER} SELECT * FROM placed")
def todo_in_range(spark: SparkSession, root: str) -> DataFrame:
    points = todos(spark, root).select("project", "file", "line", F.col("line").alias("point_id"))
    ranges = symbols(spark, root).select("project", "file", F.col("name").alias("owner"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    return score.innermost(points, ranges, ["project", "file"]).select("project", "file", "line", "owner", "span")


@_query(
    f"""WITH {SYMBOLS}, {TODOS} SELECT project, file, name, s.end_line >= s.line AND s.line > 0 AND EXISTS (
      SELECT 1 FROM todos_ t WHERE t.project = s.project AND t.file = s.file AND t.line BETWEEN s.line AND s.end_line) AS has_todo FROM symbols_ s"""
)
def symbols_with_todo(spark: SparkSession, root: str) -> DataFrame:
    return score.has_todo(symbols(spark, root), todos(spark, root), ["project", "file"]).select("project", "file", "name", "has_todo")


@_query(
    f"""WITH {SYMBOLS}, {SOURCES}, {DEFINITIONS}, calls_ AS (SELECT DISTINCT project, unnest({_calls_sql()}) AS name FROM definitions_ WHERE definitions_.name IS NULL)
    SELECT project, file, name, EXISTS (SELECT 1 FROM calls_ c WHERE c.project = s.project AND c.name = s.name) AS is_called FROM symbols_ s"""
)
def called_symbols(spark: SparkSession, root: str) -> DataFrame:
    found = extract.calls(lined(spark, root)).select("project", "name")
    return score.called(symbols(spark, root), found, ["project", "name"]).select("project", "file", "name", "is_called")


@_query(
    f"""WITH {sql.CURRENT.replace('name, line,', 'name, line, end_line,', 1)}, {sql.SNAPSHOTS}, s AS (SELECT c.*, n.ord FROM current_symbols c JOIN snaps n USING (snapshot_hash))
    SELECT a.project, a.snapshot_hash, a.file, a.name, coalesce(b.instability_score, a.instability_score) AS base_score
    FROM s a LEFT JOIN s b ON b.project = a.project AND b.ord = a.ord - 1 AND b.file = a.file AND b.name = a.name AND b.line = a.line AND b.end_line = a.end_line"""
)
def carried_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores of the snapshot before for symbols that didn't move."""
    snaps = _snaps(spark, root)
    rows = table(spark, root, "symbols").select(N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), "name", "line", "end_line", "instability_score", "delivered_at")
    now = attach(current.latest(rows, ["snapshot_hash", "file", "name"]), snaps.select("snapshot_hash", "project", "ord"), ["snapshot_hash"])
    before = now.select("project", "file", "name", "line", "end_line", "instability_score", (F.col("ord") + 1).alias("ord"))
    return score.carried(now, before, ["project", "ord", "file", "name"]).select("project", "snapshot_hash", "file", "name", "base_score")


# ---- extraction ----


@_query(f"WITH {SOURCES} SELECT language, count(*) AS files, count(DISTINCT project) AS projects FROM sources_ GROUP BY ALL")
def lang_detect(spark: SparkSession, root: str) -> DataFrame:
    return sources(spark, root).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("project").alias("projects"))


@_query(f"WITH {SOURCES} SELECT doc_id, count(*) AS n_lines, max(length(line))::INT AS longest FROM lines_ GROUP BY ALL")
def extract_lines(spark: SparkSession, root: str) -> DataFrame:
    return lined(spark, root).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"))


@_query(f"WITH {SOURCES}, {DEFINITIONS} SELECT doc_id, line_no, language, name FROM definitions_ WHERE name IS NOT NULL")
def extract_definitions(spark: SparkSession, root: str) -> DataFrame:
    return extract.definitions(lined(spark, root)).select("doc_id", "line_no", "language", "name")


@_query(f"WITH {SOURCES}, {DEFINITIONS} SELECT doc_id, line_no, unnest({_calls_sql()}) AS name FROM definitions_ WHERE definitions_.name IS NULL")
def extract_calls(spark: SparkSession, root: str) -> DataFrame:
    return extract.calls(lined(spark, root)).select("doc_id", "line_no", "name")


@_query(
    f"""WITH {SOURCES} SELECT doc_id, line_no, upper({_todo_sql(1)}) AS type, trim({_todo_sql(2)}, ' ' || chr(9) || chr(13) || chr(10)) AS text FROM lines_ WHERE {_todo_sql(1)} <> ''"""
)
def extract_todos(spark: SparkSession, root: str) -> DataFrame:
    return extract.todos(lined(spark, root)).select("doc_id", "line_no", "type", "text")


@_query()
def ignore_markers(spark: SparkSession, root: str) -> DataFrame:
    return extract.ignore_markers(sources(spark, root))


@_query()
def go_symbols(spark: SparkSession, root: str) -> DataFrame:
    return extract.go_symbols(sources(spark, root).filter("language = 'go'"))


_INCLUDE, _EXCLUDE = ["**/*.go", "src/**", "*.py"], ["**/zz_generated.*", "vendor/**", "docs/**/*.md", "**/test*"]


@_query(
    f"""SELECT project, file FROM (SELECT DISTINCT project, {sql.path('file')} AS file FROM commit_files)
    WHERE (regexp_full_match(file, '(.*/)?[^/]*\\.go') OR file = 'src' OR starts_with(file, 'src/') OR ends_with(file, '.py'))
      AND NOT (regexp_full_match(file, '(.*/)?zz_generated\\.[^/]*') OR file = 'vendor' OR starts_with(file, 'vendor/') OR regexp_full_match(file, 'docs/(.*/)?[^/]*\\.md') OR regexp_full_match(file, '(.*/)?test[^/]*'))"""
)
def glob_filter(spark: SparkSession, root: str) -> DataFrame:
    files = commit_files(spark, root).select("project", "file").distinct()
    return files.filter(globs.selected(F.col("file"), _INCLUDE, _EXCLUDE))


@_query(
    f"""SELECT project, file FROM (SELECT DISTINCT project, {sql.path('file')} AS file FROM commit_files)
    WHERE regexp_matches(lower(regexp_extract(file, '[^/]*$')), '(_test\\.go|_test\\.py|_test\\.rb|_spec\\.rb|_test\\.rs|_spec\\.rs|\\.(test|spec)\\.(ts|tsx|js|jsx)|\\.test\\.go)$|^(test_|spec_|test-)')"""
)
def test_files(spark: SparkSession, root: str) -> DataFrame:
    return commit_files(spark, root).select("project", "file").distinct().filter(paths.is_test(F.col("file")))


# ---- texts ----

_STEM1 = """CASE WHEN length(w) <= 3 THEN w WHEN ends_with(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y' WHEN ends_with(w, 'sses') THEN w[:-3]
  WHEN ends_with(w, 'ss') OR ends_with(w, 'us') OR ends_with(w, 'is') THEN w WHEN ends_with(w, 'es') THEN w[:-3] WHEN ends_with(w, 's') THEN w[:-2] ELSE w END"""
_STOP = ", ".join(map(_quoted, text.STOPWORDS))


def _terms_sql(source: str, keep: str, content: str) -> str:
    """Rows ``keep, term`` of the stemmed words of a table's texts."""
    return f"""SELECT {keep}, CASE WHEN length(w) > 3 AND ends_with(b, 'e') AND length(b) > 3 AND NOT ends_with(b, 'ee') AND NOT ends_with(b, 'ie') THEN b[:-2] ELSE b END AS term FROM (
      SELECT *, CASE WHEN length(w) <= 3 THEN w WHEN ends_with(a, 'ing') AND length(a) > 5 THEN a[:-4] WHEN (ends_with(a, 'ed') OR ends_with(a, 'ly')) AND length(a) > 4 THEN a[:-3] ELSE a END AS b FROM (
        SELECT *, {_STEM1} AS a FROM (
          SELECT {keep}, unnest(string_split_regex(lower(coalesce({content}, '')), '[^a-z0-9]+')) AS w FROM {source}) WHERE length(w) > 1 AND w NOT IN ({_STOP})))"""


@_query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({_terms_sql('documents', 'doc_id', 'text')}) GROUP BY term")
def tokenize_documents(spark: SparkSession, root: str) -> DataFrame:
    found = text.terms(table(spark, root, "documents"), "text", "doc_id")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


def candidates(spark: SparkSession, root: str) -> DataFrame:
    return _candidates(intents(spark, root), todos(spark, root))


def _candidates(own: DataFrame, open_: DataFrame) -> DataFrame:
    """``project, id, text``: intents (with each tag twice) and open todos."""
    i = own.select("project", F.concat(F.lit("intent:"), "id").alias("id"), text.candidate_text(F.col("message"), F.col("tags")).alias("text"))
    t = open_.filter("NOT resolved").select("project", F.concat(F.lit("todo:"), "file", F.lit(":"), F.col("line").cast("string")).alias("id"), "text")
    return i.unionByName(t)


_TFIDF = f"""{sql.SNAPSHOTS}, {TODOS}, {INTENTS},
cand AS (
  SELECT project, 'intent:' || id AS id, coalesce(message, '') || ' ' || coalesce(array_to_string(flatten(list_transform(tags, lambda t: [t, t])), ' '), '') AS txt FROM intents_
  UNION ALL SELECT project, 'todo:' || file || ':' || line, text FROM todos_ WHERE NOT resolved),
tf AS (SELECT project, id, term, count(*) AS tf FROM ({_terms_sql('cand', 'project, id', 'txt')}) GROUP BY ALL),
df AS (SELECT project, term, count(*) AS df FROM tf GROUP BY ALL),
nn AS (SELECT project, count(*) AS n FROM cand GROUP BY ALL),
v AS (SELECT tf.project, id, term, tf * ln(1 + n / df) AS w FROM tf JOIN df USING (project, term) JOIN nn USING (project)),
norm AS (SELECT project, id, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
u AS (SELECT project, id, term, w / norm AS w FROM v JOIN norm USING (project, id)),
sim AS (SELECT a.project, a.id, b.id AS other, sum(a.w * b.w) AS similarity FROM u a JOIN u b ON a.project = b.project AND a.term = b.term AND a.id <> b.id GROUP BY ALL)"""


@_query(
    f"""WITH {_TFIDF} SELECT project, id, other, round(x, 6) AS similarity FROM (
      SELECT project, id, other, similarity AS x FROM sim WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY project, id ORDER BY round(similarity, 9) DESC, other) <= 6)"""
)
def tfidf_similar(spark: SparkSession, root: str) -> DataFrame:
    """Related intents and todos. The threshold is 0.6, as these texts are made from few phrases."""
    return similarity.related_by_blocks(candidates(spark, root), "project", 0.6, 6).withColumn("similarity", F.round("similarity", 6))


_RELATED = """related_ AS (SELECT project, id, other, similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY round(similarity, 9) DESC, other) AS place FROM sim WHERE similarity >= 0.2) WHERE place <= 6)"""


@_query(f"WITH {_TFIDF}, {_RELATED} SELECT project, id, other, round(similarity, 6) AS similarity FROM related_")
def tfidf_related(spark: SparkSession, root: str) -> DataFrame:
    """Related intents and todos at the reference's threshold of 0.2, the top 6 of each."""
    return _related(spark, root).withColumn("similarity", F.round("similarity", 6))


def _related(spark: SparkSession, root: str) -> DataFrame:
    return similarity.related_by_blocks(candidates(spark, root), "project", 0.2, 6)


# ---- co-change ----

_COCHANGE = f"""{FACTS}, items AS (SELECT project, file, count(*) AS n FROM facts GROUP BY ALL),
pairs_ AS (SELECT a.project, a.file AS file_a, b.file AS file_b, count(*) AS co_occurrences FROM facts a JOIN facts b ON a.project = b.project AND a.hash = b.hash AND a.file < b.file GROUP BY ALL),
cochange_ AS (SELECT p.*, a.n AS commits_a, b.n AS commits_b, co_occurrences / (a.n + b.n - co_occurrences) AS jaccard
  FROM pairs_ p JOIN items a ON a.project = p.project AND a.file = file_a JOIN items b ON b.project = p.project AND b.file = file_b
  WHERE co_occurrences >= 3 AND co_occurrences / (a.n + b.n - co_occurrences) >= 0.3)"""


@_query(f"WITH {_COCHANGE} SELECT project, file_a, file_b, co_occurrences, commits_a, commits_b, round(jaccard, 6) AS jaccard FROM cochange_")
def cochange_pairs(spark: SparkSession, root: str) -> DataFrame:
    return cochange.co_changes(commit_files(spark, root)).withColumn("jaccard", F.round("jaccard", 6))


_EXPORTED = f"""exported AS (SELECT project, least({sql.path('file_a')}, {sql.path('file_b')}) AS a, greatest({sql.path('file_a')}, {sql.path('file_b')}) AS b FROM cochange)"""


@_query(
    f"""WITH {_COCHANGE}, {_EXPORTED}, free AS (SELECT project, file_a, file_b, jaccard FROM cochange_ c WHERE NOT EXISTS (SELECT 1 FROM exported e WHERE e.project = c.project AND e.a = c.file_a AND e.b = c.file_b))
    SELECT project, file_a AS src, file_b AS dst, round(jaccard, 6) AS weight FROM free UNION ALL SELECT project, file_b, file_a, round(jaccard, 6) FROM free"""
)
def cochange_hidden(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that the projects' own last export lacks."""
    known = table(spark, root, "cochange").select("project", N.path("file_a").alias("src"), N.path("file_b").alias("dst"))
    return cochange.hidden(cochange.co_changes(commit_files(spark, root)), known).withColumn("weight", F.round("weight", 6))


# ---- graph ----


def _go_facts(spark: SparkSession, root: str) -> DataFrame:
    go = extract.files_without_ignored(sources(spark, root)).filter("language = 'go'").withColumnRenamed("path", "file")
    return extract.go_symbols(go, ["project", "file"])


def _imports(spark: SparkSession, root: str) -> DataFrame:
    return _go_facts(spark, root).filter("kind = 'import'").select("project", "file", "name").distinct()


def _guardrails(files: DataFrame) -> DataFrame:
    """A guardrail of each project over its generated code."""
    rule = [F.lit("generated").alias("id"), F.array(F.lit("internal/**")).alias("paths"), F.lit("keep internals small").alias("reason")]
    return files.select("project").distinct().select("project", *rule)


_GRAPH_TABLES = ["project_states", "symbols", "todos", "intent_updates", "documents", "commit_files"]


def graph_parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges of all projects; built once for each state of the tables and kept as two tables, as an exported graph is."""
    return built(spark, ("graph", root, state_of(spark, root, *_GRAPH_TABLES)), lambda: _graph_parts(spark, root))


def _graph_parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    s = stored(symbols(spark, root))
    t, i, go = stored(todos(spark, root)), stored(intents(spark, root)), stored(_go_facts(spark, root))
    files = stored(s.select("project", "file").distinct())
    lines = lined(spark, root).filter("language <> 'go'")  # Go has a scanner of its own
    sure = F.lit(CONFIDENCE["ast"]).alias("confidence")
    calls = extract.calls(lines).select("project", F.col("path").alias("file"), F.col("line_no").alias("line"), "name", "confidence")
    calls = calls.unionByName(go.filter("kind = 'call'").select("project", "file", "line", "name", sure))
    defined = extract.definitions(lines).select("project", F.col("path").alias("file"), "name").unionByName(go.filter("kind = 'def'").select("project", "file", "name"))
    imports = stored(graph.resolved_imports(go.filter("kind = 'import'").select("project", "file", "name").distinct(), files))
    # stored, so that their shuffle files are gone when the edges are merged
    related = stored(similarity.related_by_blocks(_candidates(i, t), "project", 0.2, 6))
    pairs = stored(cochange.hidden(cochange.co_changes(commit_files(spark, root)), imports.filter("dst IS NOT NULL").select("project", "src", "dst")))
    modules = files.select("project", F.concat(F.lit("example.org/"), "project").alias("module")).distinct()
    parts = [
        graph.symbol_part(s), graph.todo_part(s, t), graph.intent_part(i, files), graph.import_part(imports),
        graph.test_part(s, defined, imports), graph.guardrail_part(_guardrails(files), files), graph.module_part(modules, files),
    ]
    edges = [e for _, e in parts]
    edges.append(graph.call_part(s, calls))
    edges.append(graph.edges(related, "RELATED_TO", F.col("id"), F.col("other"), F.col("similarity")))
    edges.append(graph.edges(pairs, "CO_CHANGES_WITH", graph.typed_id("file", F.col("src")), graph.typed_id("file", F.col("dst")), F.col("weight")))
    nodes = [n for n, _ in parts] + [graph.snapshot_part(_snaps(spark, root))]

    def united(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return graph.merged_nodes(united(nodes)), graph.merged_edges(united(edges))


def _small_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The part of the graph that SQL can follow: symbols, files, todos, intents, guardrails."""
    s = symbols(spark, root)
    files = s.select("project", "file").distinct()
    parts = [graph.symbol_part(s), graph.todo_part(s, todos(spark, root)), graph.intent_part(intents(spark, root), files), graph.guardrail_part(_guardrails(files), files)]
    n, e = parts[0]
    for more_n, more_e in parts[1:]:
        n, e = n.unionByName(more_n), e.unionByName(more_e)
    return graph.merged_nodes(n), graph.merged_edges(e)


_GRAPH = f"""{SYMBOLS}, {TODOS}, {INTENTS}, {_INNER}, files_ AS (SELECT DISTINCT project, file FROM symbols_),
scoped AS (
  SELECT i.project, i.id, f.file FROM (SELECT project, id, regexp_replace(regexp_replace(trim(scope), '^([^:]+):.*$', '\\1'), '^\\./', '') AS s FROM intents_) i
  JOIN files_ f ON f.project = i.project AND (f.file = i.s OR (contains(i.s, '*') AND regexp_full_match(f.file, replace(replace(regexp_escape(i.s), '\\*', '[^/]*'), '\\?', '[^/]'))))
  WHERE i.s <> '' AND i.s <> 'project'),
raw_edges AS (
  SELECT project, 'DEFINED_IN' AS type, 'symbol:' || file || '::' || name AS src, 'file:' || file AS dst, 1.0 AS weight FROM symbols_
  UNION ALL SELECT project, 'CONTAINS', 'file:' || file, 'symbol:' || file || '::' || name, 1.0 FROM symbols_
  UNION ALL SELECT project, 'HAS_TODO', 'file:' || file, 'todo:' || file || ':' || line, 1.0 FROM todos_ WHERE NOT resolved
  UNION ALL SELECT p.project, 'HAS_TODO', 'symbol:' || p.file || '::' || p.owner, 'todo:' || p.file || ':' || p.line, 1.0 FROM placed p JOIN todos_ t ON t.project = p.project AND t.file = p.file AND t.line = p.line AND NOT t.resolved
  UNION ALL SELECT DISTINCT project, 'SCOPE_MATCH', 'intent:' || id, 'file:' || file, 0.7 FROM scoped
  UNION ALL SELECT project, 'PROTECTS', 'guardrail:generated', 'file:' || file, 1.0 FROM files_ WHERE file = 'internal' OR starts_with(file, 'internal/')),
edges_ AS (SELECT project, type, src, dst, max(weight)::DOUBLE AS weight, count(*) AS occurrences FROM raw_edges GROUP BY ALL),
nodes_ AS (
  SELECT project, 'symbol:' || file || '::' || name AS id, 'symbol' AS type FROM symbols_ UNION SELECT project, 'file:' || file, 'file' FROM files_
  UNION SELECT project, 'todo:' || file || ':' || line, 'todo' FROM todos_ WHERE NOT resolved UNION SELECT project, 'intent:' || id, 'intent' FROM intents_ UNION SELECT project, 'guardrail:generated', 'guardrail' FROM files_)"""


@_query(f"WITH {_GRAPH} SELECT * FROM edges_")
def graph_edges(spark: SparkSession, root: str) -> DataFrame:
    return _small_graph(spark, root)[1].select("project", "type", "src", "dst", "weight", "occurrences")


@_query(f"WITH {_GRAPH} SELECT project, id, type FROM nodes_")
def graph_nodes(spark: SparkSession, root: str) -> DataFrame:
    return _small_graph(spark, root)[0].select("project", "id", "type")


@_query(
    f"""WITH {_GRAPH}, x AS (SELECT project, 'nodes' AS metric, type AS key, count(*) AS value FROM nodes_ GROUP BY ALL UNION ALL SELECT project, 'edges', type, count(*) FROM edges_ GROUP BY ALL)
    SELECT * FROM x UNION ALL SELECT project, metric, '', sum(value)::BIGINT FROM x GROUP BY project, metric
    UNION ALL SELECT project, 'flags', unnest(['deps_with_importers', 'has_co_changes']), 0 FROM (SELECT DISTINCT project FROM edges_)"""
)
def graph_stats(spark: SparkSession, root: str) -> DataFrame:
    return graph.stats(*_small_graph(spark, root))


@_query(f"WITH {_GRAPH} SELECT project, id, count(*) AS degree FROM (SELECT project, src AS id FROM edges_ UNION ALL SELECT project, dst FROM edges_) GROUP BY ALL")
def node_degree(spark: SparkSession, root: str) -> DataFrame:
    return graph.degrees(_small_graph(spark, root)[1])


#: Go calls line by line: comments and texts blanked out, the declared name taken off.
_GO_LINE = r"""regexp_replace(regexp_replace(line, '//.*|/\*.*?\*/|"(\\.|[^"\\])*"|`[^`]*`|\x27(\\.|[^\x27\\])*\x27', ' ', 'g'), '^func\s+(\([^()]*\)\s*)?\w+', ' ')"""
_GO_NO_CALLS = ", ".join(map(_quoted, "if for switch select return func go defer range case map chan struct interface type var const package import else".split()))
_WHOLE_GRAPH = f"""{_TFIDF}, {_RELATED}, {SYMBOLS.replace(sql.SNAPSHOTS + ',', '', 1)}, {_INNER}, {SOURCES}, {DEFINITIONS}, {_COCHANGE}, {_GRAPH[_GRAPH.index("files_ AS"):_GRAPH.index("edges_ AS (SELECT project, type")]}
found_calls AS (
  SELECT project, path AS file, line_no AS line, unnest({_calls_sql()}) AS name, CASE WHEN language IN ({', '.join(_quoted(x.id) for x in LANGUAGES if x.tier == 'lexical')}) THEN 0.8 ELSE 0.6 END AS sure
    FROM definitions_ WHERE definitions_.name IS NULL AND language <> 'go'
  UNION ALL SELECT DISTINCT project, path, line_no, unnest(list_filter(list_distinct(regexp_extract_all({_GO_LINE}, '(\\w+)[ \\t]*\\(', 1)), lambda n: n NOT IN ({_GO_NO_CALLS}))), 1.0 FROM lines_ WHERE language = 'go'),
called_at AS (SELECT DISTINCT * FROM found_calls),
around AS (
  SELECT c.*, s.name AS owner FROM called_at c JOIN symbols_ s ON s.project = c.project AND s.file = c.file AND c.line BETWEEN s.line AND s.end_line
  WHERE s.end_line >= s.line AND s.line > 0 QUALIFY row_number() OVER (PARTITION BY c.project, c.file, c.line, c.name, c.sure ORDER BY s.end_line - s.line, s.line, s.name) = 1),
named AS (SELECT project, name, count(*) AS n FROM symbols_ GROUP BY ALL),
all_edges AS (
  SELECT project, type, src, dst, weight FROM raw_edges
  UNION ALL SELECT a.project, 'CALLS', 'symbol:' || a.file || '::' || a.owner, 'symbol:' || t.file || '::' || t.name, a.sure / n.n
    FROM around a JOIN named n ON n.project = a.project AND n.name = a.name JOIN symbols_ t ON t.project = a.project AND t.name = a.name
  UNION ALL SELECT project, 'RELATED_TO', id, other, similarity FROM related_
  UNION ALL SELECT project, 'CO_CHANGES_WITH', 'file:' || file_a, 'file:' || file_b, jaccard FROM cochange_
  UNION ALL SELECT project, 'CO_CHANGES_WITH', 'file:' || file_b, 'file:' || file_a, jaccard FROM cochange_
  UNION ALL SELECT project, 'CONTAINS', 'module:example.org/' || project, 'file:' || file, 1.0 FROM files_),
edges_ AS (SELECT project, type, src, dst, max(weight)::DOUBLE AS weight, count(*) AS occurrences FROM all_edges GROUP BY ALL),
nodes_ AS (
  SELECT project, 'symbol:' || file || '::' || name AS id, 'symbol' AS type FROM symbols_ UNION SELECT project, 'file:' || file, 'file' FROM files_
  UNION SELECT project, 'todo:' || file || ':' || line, 'todo' FROM todos_ WHERE NOT resolved UNION SELECT project, 'intent:' || id, 'intent' FROM intents_ UNION SELECT project, 'guardrail:generated', 'guardrail' FROM files_
  UNION SELECT project, 'module:example.org/' || project, 'module' FROM files_ UNION SELECT project, 'snapshot:' || snapshot_hash, 'snapshot' FROM snaps)"""
_CHOSEN = "chosen AS (SELECT project, id FROM nodes_ WHERE substr(md5(project || chr(1) || id), 1, 2) < '05')"


@_query(
    f"""WITH {_WHOLE_GRAPH}, x AS (SELECT project, 'nodes' AS metric, type AS key, count(*) AS value FROM nodes_ GROUP BY ALL UNION ALL SELECT project, 'edges', type, count(*) FROM edges_ GROUP BY ALL)
    SELECT * FROM x UNION ALL SELECT project, metric, '', sum(value)::BIGINT FROM x GROUP BY project, metric
    UNION ALL SELECT project, 'flags', 'deps_with_importers', 0 FROM edges_ GROUP BY project
    UNION ALL SELECT project, 'flags', 'has_co_changes', max((type = 'CO_CHANGES_WITH')::BIGINT) FROM edges_ GROUP BY project"""
)
def graph_full(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of nodes and edges of the whole graph, with calls, imports, tests, related texts, co-changes and modules."""
    return graph.stats(*graph_parts(spark, root))


_SEEDS = """seeds AS (SELECT project, min(file) AS file FROM files_ GROUP BY project)"""


def _seeds(nodes: DataFrame) -> DataFrame:
    """The first file of each project."""
    return nodes.filter("type = 'file'").groupBy("project").agg(F.min("id").alias("id"))


@_query(
    f"""WITH {_GRAPH}, {_SEEDS}, at_ AS (SELECT e.*, s.file FROM edges_ e JOIN seeds s ON s.project = e.project)
    SELECT project, src AS id, 'contains' AS role, type, src, dst, weight FROM at_ WHERE src = 'file:' || file AND type = 'CONTAINS'
    UNION ALL SELECT project, src, 'todo', type, src, dst, weight FROM at_ WHERE src = 'file:' || file AND type = 'HAS_TODO'
    UNION ALL SELECT project, dst, 'intents', type, src, dst, weight FROM at_ WHERE dst = 'file:' || file AND type = 'SCOPE_MATCH'
    UNION ALL SELECT project, dst, 'protects', type, src, dst, weight FROM at_ WHERE dst = 'file:' || file AND type = 'PROTECTS'"""
)
def trace_node(spark: SparkSession, root: str) -> DataFrame:
    n, e = _small_graph(spark, root)
    return graph.trace(e, _seeds(n))


@_query(f"WITH {_GRAPH} SELECT project, id FROM nodes_ WHERE type = 'file' AND (id = 'file:internal' OR starts_with(id, 'file:internal/'))")
def scope_glob(spark: SparkSession, root: str) -> DataFrame:
    return graph.scope(_small_graph(spark, root)[0], "internal/**").select("project", "id")


@_query(
    f"""WITH {_GRAPH}, steps AS (
      SELECT project, src AS at_, dst AS to_, weight, '0' || type || chr(1) || dst AS o FROM edges_
      UNION ALL SELECT project, dst, src, weight, '1' || type || chr(1) || src FROM edges_ WHERE type IN ('CALLS', 'TESTS', 'IMPORTS', 'SCOPE_MATCH', 'CO_CHANGES_WITH', 'DEPENDS_ON')),
    s0 AS (SELECT project, 'file:' || min(file) AS seed FROM files_ GROUP BY project),
    r1 AS (SELECT project, seed, to_, weight AS part, 1 AS depth, o FROM s0 JOIN steps USING (project) WHERE at_ = seed),
    f1 AS (SELECT project, seed, to_, arg_min(part, o) AS first_ FROM r1 WHERE to_ <> seed GROUP BY ALL),
    r2 AS (SELECT f.project, seed, s.to_, first_ * weight AS part, 2 AS depth FROM f1 f JOIN steps s ON s.project = f.project AND s.at_ = f.to_),
    taken AS (SELECT project, seed, to_, part, depth FROM r1 UNION ALL SELECT * FROM r2)
    SELECT project, seed, to_ AS id, round(sum(part), 6) AS score, min(depth) AS depth FROM taken WHERE to_ <> seed GROUP BY ALL"""
)
def blast_radius(spark: SparkSession, root: str) -> DataFrame:
    n, e = _small_graph(spark, root)
    return graph.blast_radius(e, _seeds(n).withColumnRenamed("id", "seed"), depth=2).withColumn("score", F.round("score", 6))


@_query(
    f"""WITH {_GRAPH}, ends AS (SELECT project, 'intent:' || min(id) AS src FROM scoped GROUP BY project),
    via AS (SELECT e.project, e.src, a.dst AS m, b.dst AS t FROM ends e JOIN edges_ a ON a.project = e.project AND a.src = e.src JOIN edges_ b ON b.project = a.project AND b.src = a.dst),
    goal AS (SELECT project, src, max(t) AS dst FROM via GROUP BY ALL)
    SELECT project, src, dst, [src, m, dst] AS path FROM (SELECT g.project, g.src, g.dst, min(m) AS m FROM goal g JOIN via v ON v.project = g.project AND v.src = g.src AND v.t = g.dst GROUP BY 1, 2, 3)"""
)
def shortest_path(spark: SparkSession, root: str) -> DataFrame:
    """From the first scoped intent of each project to the last node two steps away."""
    e = stored(_small_graph(spark, root)[1])
    first = e.filter("type = 'SCOPE_MATCH'").groupBy("project").agg(F.min("src").alias("src"))
    one = e.join(first, ["project", "src"], "left_semi").select("project", F.col("src").alias("start"), F.col("dst").alias("src"))
    ends = one.join(e.select("project", "src", "dst"), ["project", "src"]).groupBy("project", F.col("start").alias("src")).agg(F.max("dst").alias("dst"))
    return graph.shortest_paths(e, ends, 3)


def _some_nodes(nodes: DataFrame) -> DataFrame:
    """``project, id``: about a fiftieth of all nodes, of every type: those whose digest begins with 00 to 04."""
    return nodes.filter(F.substring(F.md5(F.concat_ws("\u0001", "project", "id")), 1, 2) < "05").select("project", "id")


_ROLES = {
    "out": {"CALLS": "callees", "IMPORTS": "imports", "DEPENDS_ON": "imports", "TESTS": "tested", "SCOPE_MATCH": "intents", "HAS_TODO": "todo", "CO_CHANGES_WITH": "co_changes", "CONTAINS": "contains", "DEFINED_IN": "defined_in", "PROTECTS": "protected"},
    "in": {"CALLS": "callers", "IMPORTS": "imported_by", "TESTS": "tests", "SCOPE_MATCH": "intents", "CO_CHANGES_WITH": "co_changes", "PROTECTS": "protects"},
}


def _role_sql(way: str, end: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in _ROLES[way].items())
    kinds = ", ".join(f"'{t}'" for t in _ROLES[way])
    return f"SELECT e.project, e.{end} AS id, CASE e.type {cases} END AS role, e.type, e.src, e.dst, round(e.weight, 6) AS weight FROM edges_ e JOIN chosen c ON c.project = e.project AND c.id = e.{end} WHERE e.type IN ({kinds})"


@_query(f"WITH {_WHOLE_GRAPH}, {_CHOSEN} {_role_sql('out', 'src')} UNION ALL {_role_sql('in', 'dst')}")
def trace_node_whole(spark: SparkSession, root: str) -> DataFrame:
    """Every relation in the whole graph of a fiftieth of its nodes."""
    n, e = graph_parts(spark, root)
    return graph.trace(e, stored(_some_nodes(n))).withColumn("weight", F.round("weight", 6))


_RADIUS = f"""{_WHOLE_GRAPH}, {_CHOSEN}, steps AS (
      SELECT project, src AS at_, dst AS to_, weight, '0' || type || chr(1) || dst AS o FROM edges_
      UNION ALL SELECT project, dst, src, weight, '1' || type || chr(1) || src FROM edges_ WHERE type IN ('CALLS', 'TESTS', 'IMPORTS', 'SCOPE_MATCH', 'CO_CHANGES_WITH', 'DEPENDS_ON')),
    r1 AS (SELECT c.project, c.id AS seed, to_, weight AS part, o FROM chosen c JOIN steps s ON s.project = c.project AND s.at_ = c.id),
    g1 AS (SELECT project, seed, to_, arg_min(part, o) AS first_, min(o) AS o FROM r1 WHERE to_ <> seed GROUP BY ALL),
    f1 AS (SELECT *, printf('%09d', row_number() OVER (PARTITION BY project, seed ORDER BY o)) AS pos FROM g1),
    r2 AS (SELECT f.project, seed, s.to_, first_ * weight AS part, pos || s.o AS o FROM f1 f JOIN steps s ON s.project = f.project AND s.at_ = f.to_),
    f2 AS (SELECT r.project, r.seed, r.to_, arg_min(r.part, r.o) AS first_ FROM r2 r LEFT JOIN g1 ON g1.project = r.project AND g1.seed = r.seed AND g1.to_ = r.to_ WHERE r.to_ <> r.seed AND g1.to_ IS NULL GROUP BY ALL),
    r3 AS (SELECT f.project, seed, s.to_, first_ * weight AS part FROM f2 f JOIN steps s ON s.project = f.project AND s.at_ = f.to_),
    taken AS (SELECT project, seed, to_, part, 1 AS depth FROM r1 UNION ALL SELECT project, seed, to_, part, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3),
    radius AS (SELECT project, seed, to_ AS id, sum(part) AS score, min(depth) AS depth FROM taken WHERE to_ <> seed GROUP BY ALL)"""


def _chosen(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the whole graph, and a fiftieth of its nodes as seeds."""
    n, e = graph_parts(spark, root)
    return n, e, stored(_some_nodes(n)).withColumnRenamed("id", "seed")


@_query(f"WITH {_RADIUS} SELECT project, seed, id, round(score, 6) AS score, depth FROM radius")
def blast_radius_whole(spark: SparkSession, root: str) -> DataFrame:
    """What a change of a fiftieth of the whole graph's nodes reaches within three steps."""
    _, e, seeds = _chosen(spark, root)
    return graph.blast_radius(e, seeds, depth=3, digits=6)


@_query(
    f"""WITH {_RADIUS}, at_file AS (SELECT project, 'symbol:' || file || '::' || name AS id, file FROM symbols_ UNION SELECT project, 'file:' || file, file FROM files_ UNION SELECT project, 'todo:' || file || ':' || line, file FROM todos_)
    SELECT project, seed, count(DISTINCT file) AS files, count(*) AS nodes FROM radius LEFT JOIN at_file USING (project, id) GROUP BY ALL"""
)
def affected_files(spark: SparkSession, root: str) -> DataFrame:
    """Distinct files and nodes that each of these changes reaches."""
    n, e, seeds = _chosen(spark, root)
    return graph.affected_files(e, n, seeds, depth=3)


@_query(
    f"""WITH {_WHOLE_GRAPH} SELECT project, id, other, round(max(weight), 6) AS weight FROM (
      SELECT project, src AS id, dst AS other, weight FROM edges_ WHERE type = 'CO_CHANGES_WITH' AND weight >= 0.4
      UNION ALL SELECT project, dst, src, weight FROM edges_ WHERE type = 'CO_CHANGES_WITH' AND weight >= 0.4) WHERE (project, id) IN (SELECT project, id FROM nodes_) GROUP BY ALL"""
)
def co_changes_of_nodes(spark: SparkSession, root: str) -> DataFrame:
    """What changes together with each file that is a node."""
    n, e = graph_parts(spark, root)
    return graph.co_changes_of(e, n.select("project", "id"), 0.4).withColumn("weight", F.round("weight", 6))


@_query(f"WITH {_WHOLE_GRAPH} SELECT project, type, src, dst, round(weight, 6) AS weight, occurrences FROM edges_")
def graph_edges_whole(spark: SparkSession, root: str) -> DataFrame:
    return graph_parts(spark, root)[1].select("project", "type", "src", "dst", F.round("weight", 6).alias("weight"), "occurrences")


@_query(f"WITH {_WHOLE_GRAPH} SELECT project, id, type FROM nodes_")
def graph_nodes_whole(spark: SparkSession, root: str) -> DataFrame:
    return graph_parts(spark, root)[0].select("project", "id", "type")


@_query(f"WITH {_WHOLE_GRAPH} SELECT project, id, count(*) AS degree FROM (SELECT project, src AS id FROM edges_ UNION ALL SELECT project, dst FROM edges_) GROUP BY ALL")
def node_degree_whole(spark: SparkSession, root: str) -> DataFrame:
    return graph.degrees(graph_parts(spark, root)[1])


@_query()
def shortest_path_whole(spark: SparkSession, root: str) -> DataFrame:
    """In the whole graph, from the intent to the symbol of the least hash in each project."""
    n, e = graph_parts(spark, root)
    least = [F.min_by(F.when(F.col("type") == t, F.col("id")), F.when(F.col("type") == t, F.xxhash64("id"))).alias(c) for t, c in (("intent", "src"), ("symbol", "dst"))]
    return graph.shortest_paths(e, n.groupBy("project").agg(*least).filter("src IS NOT NULL AND dst IS NOT NULL"))


@_query()
def exported_edges_whole(spark: SparkSession, root: str) -> DataFrame:
    return graph.exported_edges(graph_parts(spark, root)[1])


@_query(
    f"""WITH {_WHOLE_GRAPH}, d AS (SELECT project, id, count(*) AS degree FROM (SELECT project, src AS id FROM edges_ UNION ALL SELECT project, dst FROM edges_) GROUP BY ALL)
    SELECT n.project, n.id, n.type, coalesce(degree, 0) AS degree, round(2 + log2(coalesce(degree, 0) + 1), 6) AS size FROM nodes_ n LEFT JOIN d USING (project, id)"""
)
def exported_nodes_whole(spark: SparkSession, root: str) -> DataFrame:
    out = graph.exported_nodes(*graph_parts(spark, root))
    return out.select("project", "id", "type", "degree", F.round(graph.node_size(F.col("degree")), 6).alias("size"))


@_query(f"WITH {_WHOLE_GRAPH}, kept AS (SELECT project, id FROM nodes_ WHERE type IN ('file', 'todo')) SELECT project, type, src, dst FROM edges_ e WHERE (project, src) IN (FROM kept) AND (project, dst) IN (FROM kept)")
def visible_links_whole(spark: SparkSession, root: str) -> DataFrame:
    n, e = graph_parts(spark, root)
    return graph.visible_links(n.filter("type IN ('file', 'todo')"), e).select("project", "type", "src", "dst")


_IMPORTS = f"""{SYMBOLS}, files_ AS (SELECT DISTINCT project, file FROM symbols_),
look AS (
  SELECT project, 'stem' AS kind, regexp_replace(file, '\\.[^./]*$', '') AS key, file FROM files_
  UNION ALL SELECT project, 'dir', regexp_replace(file, '/[^/]*$', ''), file FROM files_ WHERE contains(file, '/')
  UNION ALL SELECT project, 'base', regexp_extract(file, '[^/]*$'), file FROM files_
  UNION ALL SELECT project, 'base', regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^./]*$', ''), file FROM files_),
targets AS (SELECT project, kind, key, min(file) AS target FROM look GROUP BY ALL),
asked AS (SELECT DISTINCT project, {sql.path('file_a')} AS src, 'mod/' || regexp_replace({sql.path('file_b')}, '\\.[^./]*$', '') AS import FROM cochange),
parts_ AS (SELECT *, string_split(import, '/') AS parts FROM asked),
ends AS (SELECT project, src, import, parts, unnest(range(1, len(parts) + 1)) AS k FROM parts_),
tries AS (
  SELECT project, src, import, 2 * k AS prio, 'dir' AS kind, array_to_string(parts[len(parts) - k + 1:], '/') AS key FROM ends
  UNION ALL SELECT project, src, import, 2 * k + 1, 'stem', array_to_string(parts[len(parts) - k + 1:], '/') FROM ends
  UNION ALL SELECT project, src, import, 1000000, 'base', parts[-1] FROM parts_)"""


@_query(f"WITH {_IMPORTS} SELECT project, src, import, arg_min(target, prio) AS dst FROM tries LEFT JOIN targets USING (project, kind, key) GROUP BY ALL")
def import_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Imports of exported file pairs: the sources here hold no import, so one file of a pair stands for what the other imports."""
    files = symbols(spark, root).select("project", "file").distinct()
    name = F.concat(F.lit("mod/"), paths.without_extension(N.path("file_b")))
    return graph.resolved_imports(table(spark, root, "cochange").select("project", N.path("file_a").alias("file"), name.alias("name")), files)


@_query()
def test_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Tests and the symbols they cover."""
    s = symbols(spark, root)
    imports = graph.resolved_imports(_imports(spark, root), s.select("project", "file").distinct())
    defined = extract.definitions(lined(spark, root)).select("project", F.col("path").alias("file"), "name")
    return graph.merged_edges(graph.test_part(s, defined, imports)[1]).select("project", F.col("dst").alias("id"), F.col("src").alias("test"), "weight")


# ---- snapshots ----

#: What makes a symbol a changed one.
_VALUES = ["state", "confidence", "churn_count", "instability_score"]
_ENTRY = ["kind", "file", "item"]


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """Current rows of all snapshots with their ordinals."""
    rows = table(spark, root, "symbols").select(N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), "name", N.label("state").alias("state"), "churn_count", "delivered_at")
    snaps = _snaps(spark, root).select("snapshot_hash", "project", "ord", "n")
    return attach(current.latest(rows, ["snapshot_hash", "file", "name"]), snaps, ["snapshot_hash"]).drop("delivered_at", "snapshot_hash")


def _entries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and todos of all snapshots: ``project, ord, n, kind, file, item``, a symbol's compared values, a todo's text, type and being resolved.

    Partitioned by file and item, which serves current rows and whatever is grouped by entity later.
    """
    snaps = _snaps(spark, root).select("snapshot_hash", "project", "ord", "n")
    rows = table(spark, root, "symbols").select(N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), F.col("name").alias("item"), N.label("state").alias("state"), *_VALUES[1:], "delivered_at")
    s = current.latest(attach(rows, snaps, ["snapshot_hash"]).repartition("file", "item"), ["snapshot_hash", "file", "item"])
    rows = table(spark, root, "todos").select(
        N.hash_id("snapshot_hash").alias("snapshot_hash"), N.path("file").alias("file"), F.col("line").cast("string").alias("item"),
        F.struct("delivered_at", "text", F.upper(F.btrim("type", F.lit(" \t"))).alias("type"), F.coalesce("resolved", F.lit(False)).alias("resolved")).alias("b"),
    )
    t = attach(rows, snaps, ["snapshot_hash"]).repartition("file", "item").groupBy("snapshot_hash", "project", "ord", "n", "file", "item").agg(F.max("b").alias("b"))
    key = ["project", "ord", "n"]
    return s.select(*key, F.lit("symbol").alias("kind"), "file", "item", *_VALUES), t.select(*key, F.lit("todo").alias("kind"), "file", "item", "b.text", "b.type", "b.resolved")


def _all_entries(spark: SparkSession, root: str) -> DataFrame:
    s, t = _entries(spark, root)
    return s.unionByName(t, allowMissingColumns=True)


_TWO = f"""{sql.CURRENT}, {sql.SNAPSHOTS}, v AS (SELECT s.project, s.ord, s.next_hash IS NULL AS is_last, c.file, c.name, c.state, c.churn_count FROM current_symbols c JOIN snaps s USING (snapshot_hash)),
last_ AS (SELECT * FROM v WHERE is_last), first_ AS (SELECT * FROM v WHERE ord = 1)"""


@_query(
    f"""WITH {_TWO} SELECT project, change, count(*) AS n FROM (
      SELECT coalesce(a.project, b.project) AS project, CASE WHEN a.project IS NULL THEN 'added' WHEN b.project IS NULL THEN 'removed' WHEN a.state IS DISTINCT FROM b.state OR a.churn_count IS DISTINCT FROM b.churn_count THEN 'changed' END AS change
      FROM first_ a FULL JOIN last_ b ON a.project = b.project AND a.file = b.file AND a.name = b.name) WHERE change IS NOT NULL GROUP BY ALL"""
)
def snapshot_diff(spark: SparkSession, root: str) -> DataFrame:
    """Changes from each project's first snapshot to its last."""
    return _first_to_last(spark, root)[2].groupBy("project", "change").agg(F.count(F.lit(1)).alias("n"))


def _first_to_last(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = _versions(spark, root)
    first, last = (v.filter(f).drop("ord", "n") for f in ("ord = 0", "ord = n - 1"))
    return first, last, snapshots.diff(first, last, ["project", "file", "name"], ["state", "churn_count"])


@_query(f"WITH {_TWO} SELECT project, file, name, state, churn_count FROM last_")
def snapshot_apply(spark: SparkSession, root: str) -> DataFrame:
    """The first snapshot with the changes applied is the last one."""
    first, _, delta = _first_to_last(spark, root)
    return snapshots.apply(first, delta, ["project", "file", "name"]).select("project", "file", "name", "state", "churn_count")


@_query(f"WITH {_TWO} SELECT project, file, name, state, churn_count FROM last_")
def delta_chain(spark: SparkSession, root: str) -> DataFrame:
    """Each project's last snapshot, rebuilt from the first and all changes between."""
    v = _versions(spark, root)
    key = ["project", "file", "name"]
    sides = v.drop("n")
    before = sides.withColumn("ord", F.col("ord") + 1).join(_snaps(spark, root).select("project", "ord").distinct(), ["project", "ord"], "left_semi")
    deltas = snapshots.diff(before, sides, ["project", "ord", "file", "name"], ["state", "churn_count"]).withColumnRenamed("ord", "seq")
    return snapshots.chain(deltas, key).select(*key, "state", "churn_count")


_WHOLE = f"""{sql.CURRENT}, {sql.SNAPSHOTS}, rows_ AS (
  SELECT snapshot_hash, 'symbol' AS kind, file, name AS item, state, confidence, churn_count, instability_score FROM current_symbols
  UNION ALL SELECT DISTINCT lower(snapshot_hash), 'todo', {sql.path('file')}, line::VARCHAR, NULL, NULL::DOUBLE, NULL::INT, NULL::DOUBLE FROM todos),
v AS (SELECT s.project, s.ord, s.next_hash IS NULL AS is_last, r.* EXCLUDE (snapshot_hash) FROM rows_ r JOIN snaps s USING (snapshot_hash)),
last_ AS (SELECT * FROM v WHERE is_last), first_ AS (SELECT * FROM v WHERE ord = 1)"""


@_query(
    f"""WITH {_WHOLE} SELECT project, kind, change, count(*) AS n FROM (
      SELECT coalesce(a.project, b.project) AS project, coalesce(a.kind, b.kind) AS kind,
        CASE WHEN a.project IS NULL THEN 'added' WHEN b.project IS NULL THEN 'removed'
          WHEN (a.state, a.confidence, a.churn_count, a.instability_score) IS DISTINCT FROM (b.state, b.confidence, b.churn_count, b.instability_score) THEN 'changed' END AS change
      FROM first_ a FULL JOIN last_ b ON a.project = b.project AND a.kind = b.kind AND a.file = b.file AND a.item = b.item) WHERE change IS NOT NULL GROUP BY ALL"""
)
def snapshot_diff_whole(spark: SparkSession, root: str) -> DataFrame:
    """Changes of symbols, by all four values, and of todos from each project's first snapshot to its last."""
    return _entries_first_to_last(spark, root)[1].groupBy("project", "kind", "change").agg(F.count(F.lit(1)).alias("n"))


def _entries_first_to_last(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    v = _all_entries(spark, root).select("project", "ord", "n", *_ENTRY, *_VALUES)
    first, last = (v.filter(f).drop("ord", "n") for f in ("ord = 0", "ord = n - 1"))
    return first, snapshots.diff(first, last, ["project", *_ENTRY], _VALUES)


@_query(f"WITH {_WHOLE} SELECT project, kind, file, item, state, confidence, churn_count, instability_score FROM last_")
def snapshot_apply_whole(spark: SparkSession, root: str) -> DataFrame:
    """The first snapshot's symbols and todos with the changes applied are the last one's."""
    first, delta = _entries_first_to_last(spark, root)
    return snapshots.apply(first, delta, ["project", *_ENTRY])


@_query(f"WITH {_WHOLE} SELECT project, kind, file, item, state, confidence, churn_count, instability_score FROM last_")
def delta_chain_whole(spark: SparkSession, root: str) -> DataFrame:
    """Symbols and todos of each project's last snapshot, rebuilt from the first and all changes between."""
    s, t = (snapshots.chain(snapshots.deltas(x, ["project", *_ENTRY], v), ["project", *_ENTRY]) for x, v in zip(_entries(spark, root), (_VALUES, [])))
    return s.unionByName(t.select("project", *_ENTRY), allowMissingColumns=True)


_SEQ = f"""{sql.SNAPSHOTS}, q AS (SELECT project, snapshot_hash AS hash, moment AS at_, ord - 1 AS seq, prev_hash, (ord - 1) % 3 = 0 AS is_checkpoint FROM snaps),
r AS (SELECT *, sum(is_checkpoint::INT) OVER (PARTITION BY project ORDER BY seq) AS run, sum(is_checkpoint::INT) OVER (PARTITION BY project) AS last_ FROM q)"""


@_query(f"WITH {_SEQ} SELECT project, hash, seq::INT AS seq, prev_hash, is_checkpoint FROM q")
def snapshot_sequence(spark: SparkSession, root: str) -> DataFrame:
    return _sequence(spark, root).select("project", "hash", "seq", "prev_hash", "is_checkpoint")


def _sequence(spark: SparkSession, root: str) -> DataFrame:
    # projects have up to eight snapshots here, so a checkpoint is made at every third
    return snapshots.sequence(_snaps(spark, root).select("project", F.col("snapshot_hash").alias("hash"), "at"), 3)


@_query(f"WITH {_SEQ} SELECT project, hash FROM r WHERE run <= last_ - 1")
def snapshot_prune(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.pruned(_sequence(spark, root), 1).select("project", "hash")


@_query(
    f"""WITH {SYMBOLS}, {sql.SNAPSHOTS.replace('snaps AS', 'snaps2 AS')} SELECT s.project, count(*) AS snapshots, max(moment) AS last_at, min(snapshot_hash) AS first_hash FROM snaps2 s GROUP BY ALL"""
)
def snapshot_list(spark: SparkSession, root: str) -> DataFrame:
    return _snaps(spark, root).groupBy("project").agg(F.count(F.lit(1)).alias("snapshots"), F.max("at").alias("last_at"), F.min("snapshot_hash").alias("first_hash"))


@_query()
def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.fingerprint(_all_entries(spark, root), ["project", "ord"], [*_ENTRY, *_VALUES, "text", "type", "resolved"])


@_query()
def content_hash(spark: SparkSession, root: str) -> DataFrame:
    return snapshots.content_hash(_all_entries(spark, root), ["project", "ord"], [*_ENTRY, *_VALUES, "text", "type", "resolved"])


# ---- format ----


@_query("SELECT doc_id, coalesce(trim(text, ' '), '') AS text, coalesce(trim(source, ' '), '') AS source FROM documents WHERE text IS NULL OR NOT contains(text, chr(1))")
def ton_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Documents as delimited records, and read again."""
    docs = table(spark, root, "documents")
    written = docs.select(delimited.record("doc_id", F.trim("text"), "source").alias("line"))
    return delimited.parsed(written, ["doc_id", "text", "source"]).withColumn("doc_id", F.col("doc_id").cast("long"))


_ESC = r"replace(replace(replace(%s, '\\', '\\\\'), chr(10), '\\n'), '|', '\\|')"


def _record_sql(*columns: str) -> str:
    return " || '|' || ".join(_ESC % f"coalesce(({c})::VARCHAR, '')" for c in columns)


@_query(
    f"""WITH {SYMBOLS}, {TODOS}, {INTENTS} SELECT project, 0::BIGINT AS section, 'intents' AS title, {_record_sql('id', 'type', 'severity', 'message')} AS line FROM intents_ WHERE status = 'active'
    UNION ALL SELECT project, list_position(['unstable', 'unused', 'abandoned', 'planned', 'active'], state)::BIGINT, state, {_record_sql('file', 'name', 'line', 'type')} FROM symbols_ WHERE state IN ('unstable', 'unused', 'abandoned', 'planned', 'active')
    UNION ALL SELECT project, 9, 'todos', {_record_sql('file', 'line', 'type', 'text')} FROM todos_ WHERE NOT resolved"""
)
def context_export(spark: SparkSession, root: str) -> DataFrame:
    return delimited.export_lines(symbols(spark, root), todos(spark, root), intents(spark, root))


@_query(f"WITH {SYMBOLS}, {TODOS}, {INTENTS} SELECT project, true AS valid FROM (SELECT project FROM symbols_ WHERE state IS NOT NULL UNION SELECT project FROM todos_ WHERE NOT resolved UNION SELECT project FROM intents_ WHERE status = 'active')")
def context_hash_valid(spark: SparkSession, root: str) -> DataFrame:
    return delimited.verified(delimited.context_text(context_export(spark, root))).select("project", "valid")


@_query(
    f"""WITH {SYMBOLS}, {TODOS}, {INTENTS}
    SELECT project, 'intents' AS section, id || '|' || {_ESC % "coalesce(type, '')"} || '|' || coalesce(severity::VARCHAR, '') || '|' || status || '|' || {_ESC % "coalesce(message, '')"} AS line FROM intents_ WHERE status = 'active'
    UNION ALL SELECT project, 'symbols', state || '|' || count(*) FROM symbols_ WHERE state IN ('planned', 'unstable', 'unused', 'abandoned') GROUP BY project, state
    UNION ALL SELECT project, 'todos', {_ESC % 'file'} || '|' || line || '|' || {_ESC % "coalesce(type, '')"} || '|' || {_ESC % "coalesce(text, '')"} FROM todos_ WHERE NOT resolved
    UNION ALL SELECT project, 'snapshots', substr(snapshot_hash, 1, 8) FROM (SELECT *, count(*) OVER (PARTITION BY project) AS n FROM snaps) WHERE ord > n - 5"""
)
def context_report(spark: SparkSession, root: str) -> DataFrame:
    return delimited.context_report(symbols(spark, root), todos(spark, root), intents(spark, root), _snaps(spark, root))


@_query(f"WITH {_GRAPH} SELECT project, type || '|' || src || '|' || dst AS id, type, src, dst, printf('%.4f', weight) AS weight FROM edges_")
def exported_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.exported_edges(_small_graph(spark, root)[1])


@_query(
    f"""WITH {_GRAPH}, d AS (SELECT project, id, count(*) AS degree FROM (SELECT project, src AS id FROM edges_ UNION ALL SELECT project, dst FROM edges_) GROUP BY ALL)
    SELECT n.project, n.id, n.type, coalesce(degree, 0) AS degree, round(2 + log2(coalesce(degree, 0) + 1), 6) AS size FROM nodes_ n LEFT JOIN d USING (project, id)"""
)
def exported_nodes(spark: SparkSession, root: str) -> DataFrame:
    out = graph.exported_nodes(*_small_graph(spark, root))
    return out.select("project", "id", "type", "degree", F.round(graph.node_size(F.col("degree")), 6).alias("size"))


@_query(f"WITH {_GRAPH}, kept AS (SELECT project, id FROM nodes_ WHERE type IN ('file', 'todo')) SELECT project, type, src, dst FROM edges_ e WHERE (project, src) IN (FROM kept) AND (project, dst) IN (FROM kept)")
def visible_links(spark: SparkSession, root: str) -> DataFrame:
    n, e = _small_graph(spark, root)
    return graph.visible_links(n.filter("type IN ('file', 'todo')"), e).select("project", "type", "src", "dst")


@_query(
    """SELECT project, lower(hash) AS hash FROM commits WHERE committed_at IS NOT NULL GROUP BY project, lower(hash)
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY max(committed_at) DESC, lower(hash)) <= 20"""
)
def newest_commits(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "commits").filter("committed_at IS NOT NULL").groupBy("project", F.lower("hash").alias("hash")).agg(F.max("committed_at").alias("committed_at"))
    return cochange.newest_commits(rows, 20).select("project", "hash")


@_query(
    f"""WITH {SYMBOLS}, {TODOS} SELECT project, file, line, CASE WHEN trim(type) IN ('FIXME', 'FIX', 'BUG', 'HACK') THEN 'FIX' WHEN trim(type) IN ('TODO', 'TBD') THEN 'TODO' WHEN trim(type) IN ('NOTE', 'INFO') THEN 'NOTE'
      WHEN regexp_matches(upper(text), 'FIXME|FIX|BUG|HACK') THEN 'FIX' WHEN regexp_matches(upper(text), 'TODO|TBD') THEN 'TODO' WHEN regexp_matches(upper(text), 'NOTE|INFO') THEN 'NOTE' ELSE 'TODO' END AS class FROM todos_"""
)
def todo_classes(spark: SparkSession, root: str) -> DataFrame:
    return todos(spark, root).select("project", "file", "line", text.todo_class(F.col("type"), F.col("text")).alias("class"))


_AGE = f"({AS_OF} - moment)"


@_query(
    f"""WITH {sql.SNAPSHOTS} SELECT project, snapshot_hash, CASE WHEN {_AGE} < 60 THEN 'just now' WHEN {_AGE} < 3600 THEN ({_AGE} // 60) || ' minutes ago' WHEN {_AGE} < 86400 THEN ({_AGE} // 3600) || ' hours ago'
      WHEN {_AGE} < 604800 THEN ({_AGE} // 86400) || ' days ago' WHEN {_AGE} < 2592000 THEN ({_AGE} // 604800) || ' weeks ago' ELSE ({_AGE} // 2592000) || ' months ago' END AS age FROM snaps"""
)
def snapshot_ages(spark: SparkSession, root: str) -> DataFrame:
    return _snaps(spark, root).select("project", "snapshot_hash", text.age_text(F.col("at"), F.lit(AS_OF)).alias("age"))


@_query(
    f"""WITH tf AS (SELECT project, id, term, count(*) AS w FROM ({_terms_sql("(SELECT project, id, message AS txt FROM intents_)", 'project, id', 'txt')}) GROUP BY ALL),
    u AS (SELECT project, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY project, id)) AS w FROM tf)
    SELECT a.project, a.id, b.id AS other, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.project = b.project AND a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.7000001""".replace("WITH tf", f"WITH {INTENTS}, tf", 1)
)
def cosine_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Intents of a project with much the same words, by plain cosine."""
    rows = intents(spark, root).select("project", "id", F.col("message").alias("text"))
    return similarity.cosine(rows, "project", 0.7000001).withColumn("similarity", F.round("similarity", 6))


@_query(
    f"""SELECT source, count(*) AS documents, (sum(strlen(text) // 4))::BIGINT AS estimated FROM documents WHERE text IS NOT NULL GROUP BY source"""
)
def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").filter("text IS NOT NULL")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(text.estimated_tokens(F.col("text"))).alias("estimated"))


_PACKED = "CASE WHEN resolution IS NULL THEN '' ELSE concat_ws(':', coalesce(resolution.method, ''), coalesce(resolution.description, ''), coalesce(epoch(resolution.resolved_at)::BIGINT::VARCHAR, ''), coalesce(resolution.resolved_by, '')) END"


@_query(f"""SELECT project, {_record_sql('id', 'type', 'severity', 'status', 'scope', 'message', "coalesce(array_to_string(tags, ','), '')", _PACKED)} AS line FROM intent_updates""")
def intent_records(spark: SparkSession, root: str) -> DataFrame:
    from symbolarium.operators import intents as intent_rows

    return intent_rows.records(table(spark, root, "intent_updates"))


# ---- state files, the store of snapshots, repeated analysis ----


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query(
    f"""WITH {SYMBOLS}, {TODOS}
    SELECT project, 'symbol' AS kind, file, name AS item, line, coalesce(state, '') AS state, printf('%.2f', coalesce(confidence, 0))::DOUBLE AS confidence, coalesce(churn_count, 0) AS churn, touched FROM symbols_
    UNION ALL SELECT project, 'todo', file, trim(text, ' '), line, coalesce(type, ''), NULL, NULL, NULL FROM todos_"""
)
def state_files(spark: SparkSession, root: str) -> DataFrame:
    """Symbols and todos of state files that were written and read again."""
    s, t = symbols(spark, root), todos(spark, root)
    names = {"lang": "language", "called": "is_called", "todo": "has_todo", "churn": "churn_count", "instability": "instability_score", "marker": "intent_marker", "source": "signal_source", "touched": "last_touched"}
    at = _snaps(spark, root).filter("ord = n - 1").select("project", F.lit(states.VERSION).alias("version"), F.timestamp_seconds("at").alias("updated_at"))
    parts = {"state": at, "symbols": s.withColumns({k: F.col(v) for k, v in names.items()}), "todos": t.withColumn("text", F.btrim("text", F.lit(" ")))}
    path = _folder(spark, "states")
    states.write(states.lines(parts), path)
    found = stored(states.read(spark, path))
    read = states.table(found, "symbols").select(
        "project", F.lit("symbol").alias("kind"), "file", F.col("name").alias("item"), "line", "state", "confidence", "churn", F.unix_timestamp("touched").alias("touched")
    )
    open_ = states.table(found, "todos").select("project", F.lit("todo").alias("kind"), "file", F.col("text").alias("item"), "line", F.col("type").alias("state"))
    return read.unionByName(open_, allowMissingColumns=True)


@_query(f"WITH {_WHOLE} SELECT project, kind, file, item, state, confidence, churn_count, instability_score FROM last_")
def store_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Each project's latest snapshot, by its name, from a store that keeps every third snapshot whole and of the others what changed."""
    path = _folder(spark, "store")
    snaps = stored(_snaps(spark, root))
    new = snaps.select("project", F.col("snapshot_hash").alias("hash"), "at")
    rows = stored(_all_entries(spark, root).select("project", "ord", "n", *_ENTRY, *_VALUES))
    store.save(new, rows, path, _ENTRY, _VALUES, 3)
    store.refer(new.select("project", F.lit("latest").alias("ref"), "hash", "at"), path)
    names = store.referred(spark, path).filter("ref = 'latest'").select("project", "hash")
    found = store.load(spark, path, names.select("hash"), _ENTRY)
    return attach(found, names.select("project", F.col("hash").alias("target")), ["target"]).select("project", *_ENTRY, *_VALUES)


_LISTED = f"""listed AS (SELECT project, {sql.path('file')} AS path, max(harvested_at) AS mtime FROM documents WHERE source = 'source_file' AND project IS NOT NULL AND file IS NOT NULL GROUP BY ALL)"""


@_query(
    f"""WITH {_LISTED} SELECT project, path, CASE WHEN mtime IS NULL THEN 'extract' WHEN hour(mtime) % 3 = 0 THEN 'new' WHEN hour(mtime) % 3 = 1 THEN 'extract' ELSE 'reuse' END AS route FROM listed
    """
)
def rescan_routes(spark: SparkSession, root: str) -> DataFrame:
    """What a second analysis does with each file, where a third of the files is new and a third was touched since the first."""
    files = table(spark, root, "documents").filter("source = 'source_file' AND project IS NOT NULL AND file IS NOT NULL")
    listed = files.groupBy("project", N.path("file").alias("path")).agg(F.max("harvested_at").alias("mtime"))
    hour = F.coalesce(F.hour("mtime") % 3, F.lit(1))
    known = listed.filter(hour > 0).select("project", "path", F.when(hour == 2, F.col("mtime")).alias("mtime"))
    return snapshots.rescan(listed, known.withColumn("mtime", F.coalesce("mtime", F.lit("1970-01-01").cast("timestamp_ntz"))), ["project", "path"]).select("project", "path", "route")


# ---- orders, first ones and subsets ----


def _place_sql(source: str, order: str, columns: str, group: str = "project") -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS place FROM {source}"


@_query(f"WITH {SYMBOLS} {_place_sql('symbols_', 'file, name', 'project, file, name')}")
def ordered_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of each project by file and name."""
    return ranking.placed(symbols(spark, root).select("project", "file", "name"), ["project"], [F.col("file"), F.col("name")])


@_query(f"WITH {_WHOLE_GRAPH} {_place_sql('nodes_', 'id', 'project, id')}")
def ordered_nodes(spark: SparkSession, root: str) -> DataFrame:
    return ranking.placed(graph_parts(spark, root)[0].select("project", "id"), ["project"], [F.col("id")])


@_query(f"WITH {_RADIUS}, r AS (SELECT project, seed, id, round(score, 6) AS score FROM radius) {_place_sql('r', 'score DESC, id', 'project, seed, id', 'project, seed')}")
def ordered_radius(spark: SparkSession, root: str) -> DataFrame:
    """What each change reaches, most affected first, then by id."""
    _, e, seeds = _chosen(spark, root)
    return graph.ordered_radius(e, seeds, depth=3, digits=6)


@_query(f"WITH {_COCHANGE}, r AS (SELECT project, file_a, file_b, round(jaccard, 9) AS j FROM cochange_) {_place_sql('r', 'j DESC, file_a || file_b, file_a', 'project, file_a, file_b')}")
def ordered_cochange(spark: SparkSession, root: str) -> DataFrame:
    """Pairs by their index, highest first, then by both paths."""
    rows = cochange.co_changes(commit_files(spark, root)).select("project", "file_a", "file_b", F.round("jaccard", 9).alias("j"))
    return ranking.placed(rows, ["project"], [F.col("j").desc(), F.concat("file_a", "file_b"), F.col("file_a")]).drop("j")


@_query(
    f"""WITH {INTENTS} {_place_sql('intents_', "severity DESC NULLS LAST, coalesce(list_position(['fixme', 'todo', 'question', 'refactor', 'hack', 'temporary'], type), 7), id", 'project, id')}"""
)
def ordered_intents(spark: SparkSession, root: str) -> DataFrame:
    """Intents by severity, highest first, then by the order of types, then by id."""
    rows = intents(spark, root).select("project", "id", "severity", "type")
    rank = F.coalesce(reports.type_rank(F.col("type")), F.lit(len(reports.TYPE_ORDER) + 1))
    return ranking.placed(rows, ["project"], [F.col("severity").desc_nulls_last(), rank, F.col("id")]).select("project", "id", "place")


@_query(f"WITH {SYMBOLS}, t AS (SELECT project, file, name, coalesce(state, '') || '|' || name AS cell FROM symbols_) {_place_sql('t', 'cell, file, name', 'project, file, name')}")
def ordered_cells(spark: SparkSession, root: str) -> DataFrame:
    """A table sorted by the text of a cell, here state and name, ties by what identifies a row."""
    rows = symbols(spark, root).select("project", "file", "name", F.concat(F.coalesce("state", F.lit("")), F.lit("|"), "name").alias("cell"))
    return ranking.placed(rows, ["project"], [F.col("cell"), F.col("file"), F.col("name")]).drop("cell")


@_query(f"WITH {SYMBOLS}, n AS (SELECT project, file, count(*) AS symbols FROM symbols_ GROUP BY ALL) {_place_sql('n', 'symbols DESC, file', 'project, file, symbols')}")
def files_by_size(spark: SparkSession, root: str) -> DataFrame:
    return reports.files_by_size(symbols(spark, root), ["project"])


@_query(
    f"""WITH {SYMBOLS}, {TODOS} SELECT project, file, line, (SELECT greatest(count(*) - 3, 0) FROM todos_ WHERE NOT resolved) AS more FROM todos_ WHERE NOT resolved
    QUALIFY row_number() OVER (ORDER BY project, file, line) <= 3"""
)
def first_todos(spark: SparkSession, root: str) -> DataFrame:
    """The first three open todos of all and how many more there are."""
    rows = todos(spark, root).filter("NOT resolved").select("project", "file", "line")
    return ranking.first_overall(rows, [F.col("project"), F.col("file"), F.col("line")], 3)


@_query(
    f"""WITH {SYMBOLS}, n AS (SELECT project, state, file, name FROM symbols_ WHERE state IN ('planned', 'unstable', 'unused', 'abandoned')
      QUALIFY row_number() OVER (PARTITION BY project ORDER BY list_position(['planned', 'unstable', 'unused', 'abandoned'], state), file, name) = 1)
    SELECT project, CASE state WHEN 'planned' THEN 'finish' WHEN 'unstable' THEN 'stabilise' WHEN 'unused' THEN 'use or remove' ELSE 'revive or remove' END || ' ' || name || ' in ' || file AS action FROM n"""
)
def next_action_words(spark: SparkSession, root: str) -> DataFrame:
    found = reports.next_action(symbols(spark, root), ["project"])
    return found.select("project", reports.next_action_text(F.col("state"), F.col("name"), F.col("file")).alias("action"))


@_query(
    f"""WITH {SOURCES}, {DEFINITIONS} SELECT project, path, name, min(line_no) AS line FROM definitions_ WHERE name IS NOT NULL GROUP BY ALL"""
)
def first_definitions(spark: SparkSession, root: str) -> DataFrame:
    """The first definition of each name of a file; of a path that several documents hold, the first line of all."""
    found = extract.definitions(lined(spark, root)).select("project", "path", "name", F.col("line_no").alias("line"), "doc_id")
    return reports.first_definitions(found, ["project", "path", "name"], [F.col("line"), F.col("doc_id")]).drop("doc_id")


@_query(f"WITH {SYMBOLS} SELECT project, file, name, state FROM symbols_ WHERE coalesce(state, '') NOT IN ('unstable', 'abandoned')")
def without_states(spark: SparkSession, root: str) -> DataFrame:
    return reports.without_states(symbols(spark, root), ["unstable", "abandoned"]).select("project", "file", "name", "state")


@_query(f"WITH {SYMBOLS} SELECT project, file, name, state FROM symbols_ WHERE state IN ('unused', 'planned')")
def log_view(spark: SparkSession, root: str) -> DataFrame:
    return reports.log_view(symbols(spark, root), [" Unused", "planned"]).select("project", "file", "name", "state")


def _dump_sql(*columns: str) -> str:
    return " || '|' || ".join(_ESC % f"coalesce({c}::VARCHAR, '')" for c in columns)


@_query(
    f"""WITH {SYMBOLS}, {TODOS}, {INTENTS} SELECT project, 'symbols' AS dump, {_dump_sql('file', 'name', 'type', 'churn_count')} AS line FROM symbols_
    UNION ALL SELECT project, 'todos', {_dump_sql('file', 'line', 'type', 'text')} FROM todos_ UNION ALL SELECT project, 'intents', {_dump_sql('id', 'type', 'severity', 'status', 'message')} FROM intents_"""
)
def dumps(spark: SparkSession, root: str) -> DataFrame:
    """Symbols, todos and intents as records of chosen columns."""
    parts = [reports.dump(df(spark, root), kind, ["project"]).withColumn("dump", F.lit(kind)) for kind, df in (("symbols", symbols), ("todos", todos), ("intents", intents))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("SELECT project, regexp_full_match(lower(hash), '[0-9a-f]{40}') AS full_hash, count(*) AS n FROM commits GROUP BY ALL")
def commit_hashes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "commits").select("project", text.is_commit_hash(F.lower("hash")).alias("full_hash"))
    return rows.groupBy("project", "full_hash").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT source, sum(len(list_filter(string_split_regex(text, '[ \t\r\n|]+'), lambda w: w <> '')))::BIGINT AS fields FROM documents WHERE text IS NOT NULL GROUP BY source")
def counted_fields(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").filter("text IS NOT NULL")
    return docs.groupBy("source").agg(F.sum(text.counted_fields(F.col("text"))).alias("fields"))


# ---- streams ----


@_query("SELECT project, strftime(delivered_at, '%Y-%m-%d') AS day, count(*) AS n FROM commit_files WHERE delivered_at IS NOT NULL GROUP BY ALL")
def stream_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries of each project and day, counted by a stream over the table's files that runs until it has read all.

    The watermark is wide, as one run reads files in any order. Each batch's changed counts are
    written to the shared folder; a window's last count is its greatest.
    """
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    path = f"{root}/commit_files.parquet"
    rows = deliveries.stream(spark, path, "project STRING, delivered_at TIMESTAMP_NTZ").filter("delivered_at IS NOT NULL")
    counted = deliveries.windowed(rows, "delivered_at", ["project"], "1 day", "36500 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("project STRING, start TIMESTAMP, n BIGINT, batch INT").parquet(f"{base}/out")
    return out.groupBy("project", F.date_format("start", "yyyy-MM-dd").alias("day")).agg(F.max("n").alias("n"))
