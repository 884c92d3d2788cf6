"""The knowledge graph: nodes and edges as DataFrames, derived by joins and merged by key.

Nodes have ``project, id, type, label, attrs``; edges ``project, type, src, dst, weight, evidence``.
Ids are typed strings such as ``file:a/b.go`` and are unique within a project.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions import globs, paths, ranking
from symbolarium.functions.sizing import as_scan
from symbolarium.operators import radius
from symbolarium.operators.score import innermost
from symbolarium.session import checkpoint_dir, stored

# Weights of derived edges.
SCOPE_WEIGHT, NAMING_WEIGHT, IMPORT_WEIGHT = 0.7, 0.9, 0.6
#: Edge types that a blast radius also follows backwards.
BACKWARDS = ["CALLS", "TESTS", "IMPORTS", "SCOPE_MATCH", "CO_CHANGES_WITH", "DEPENDS_ON"]

_NODE = ["project", "id", "type", "label", "attrs"]
_EDGE = ["project", "type", "src", "dst", "weight", "evidence"]


def symbol_id(file: Column, name: Column) -> Column:
    return F.concat(F.lit("symbol:"), file, F.lit("::"), name)


def typed_id(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), c.cast("string"))


def nodes(df: DataFrame, kind: str, id_: Column, label: Column, **attrs: Column) -> DataFrame:
    """Rows as nodes of a type; attributes without a value are left out."""
    items = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in attrs.items()]) if attrs else F.array()
    packed = F.map_from_entries(F.filter(items, lambda x: x["value"].isNotNull())) if attrs else F.create_map().cast("map<string,string>")
    return df.select("project", id_.alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), packed.alias("attrs"))


def edges(df: DataFrame, kind: str, src: Column, dst: Column, weight: Column | float, evidence: Column | str = "") -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    e = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return df.select("project", F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), w.cast("double").alias("weight"), e.alias("evidence"))


def merged_edges(all_edges: DataFrame) -> DataFrame:
    """One edge for each project, type and pair of ends: greatest weight, first evidence, number of occurrences.

    Rows have no order, so the first evidence is that of the lowest line it names, then the least text.
    """
    line = F.regexp_extract("evidence", r"at line (\d+)$", 1).try_cast("int")
    first = F.min(F.when(F.col("evidence") != "", F.struct(F.coalesce(line, F.lit(0)).alias("line"), "evidence")))["evidence"]
    return all_edges.groupBy("project", "type", "src", "dst").agg(F.max("weight").alias("weight"), first.alias("evidence"), F.count(F.lit(1)).alias("occurrences"))


def merged_nodes(all_nodes: DataFrame) -> DataFrame:
    """One node for each project and id; of several the least by type, then label."""
    first = F.min_by(F.struct("type", "label", "attrs"), F.struct("type", "label")).alias("__n")
    return all_nodes.groupBy("project", "id").agg(first).select("project", "id", "__n.type", "__n.label", "__n.attrs")


def symbol_part(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbol and file nodes, DEFINED_IN and CONTAINS edges; ``symbols`` has ``project, file, name, state, line, end_line``."""
    own, file = symbol_id(F.col("file"), F.col("name")), typed_id("file", F.col("file"))
    files = symbols.select("project", "file").distinct()
    n = nodes(symbols, "symbol", own, F.col("name"), file=F.col("file"), line=F.col("line"), state=F.col("state")).unionByName(
        nodes(files, "file", file, paths.base(F.col("file")), path=F.col("file"))
    )
    e = edges(symbols, "DEFINED_IN", own, file, 1.0).unionByName(edges(symbols, "CONTAINS", file, own, 1.0))
    return n, e


def call_part(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """CALLS edges from the symbol around each call to all symbols of the called name; the confidence is split among them.

    ``calls`` has ``project, file, line, name, confidence``. A name's number of symbols is counted
    once, before the join fans out.
    """
    ranges = symbols.select("project", "file", F.col("name").alias("owner"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    points = calls.select("project", "file", "line", F.concat_ws("\u0001", F.col("line").cast("string"), "name", F.col("confidence").cast("string")).alias("point_id"))
    around = innermost(points.distinct(), ranges, ["project", "file"])
    callers = around.select("project", "file", "owner", "line", F.split("point_id", "\u0001").alias("p")).select(
        "project", symbol_id(F.col("file"), F.col("owner")).alias("caller"), "line", F.col("p")[1].alias("name"), F.col("p")[2].cast("double").alias("confidence")
    )
    targets = symbols.select("project", "name", symbol_id(F.col("file"), F.col("name")).alias("target"))
    n = targets.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"))
    met = callers.join(n, ["project", "name"]).join(targets, ["project", "name"])
    return edges(met, "CALLS", F.col("caller"), F.col("target"), F.col("confidence") / F.col("n"), F.concat(F.lit("call at line "), F.col("line").cast("string")))


def todo_part(symbols: DataFrame, todos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of unresolved todos; HAS_TODO edges from their file and the innermost symbol around them."""
    open_ = todos.filter("NOT coalesce(resolved, false)")
    own, file = F.concat(F.lit("todo:"), F.col("file"), F.lit(":"), F.col("line").cast("string")), typed_id("file", F.col("file"))
    n = nodes(open_, "todo", own, F.col("text"), file=F.col("file"), line=F.col("line"), type=F.col("type"))
    ranges = symbols.select("project", "file", F.col("name").alias("owner"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    around = innermost(open_.select("project", "file", "line", F.col("line").alias("point_id")), ranges, ["project", "file"])
    e = edges(open_, "HAS_TODO", file, own, 1.0).unionByName(edges(around, "HAS_TODO", symbol_id(F.col("file"), F.col("owner")), own, 1.0))
    return n, e


def scope_matches(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """``project, id, file``: files that each scope names: a path (a line part is ignored) or a single-level glob.

    ``scopes`` has ``project, id, scope``; empty ones and "project" match nothing. Exact scopes are an
    equality join; globs meet only files of their project and first folder, and as many folders deep, as
    no wildcard crosses a slash.
    """
    clean = F.regexp_replace(F.regexp_replace(F.trim("scope"), r"^([^:]+):.*$", "$1"), r"^\./", "")
    usable = scopes.select("project", "id", clean.alias("s")).filter("s <> '' AND s <> 'project'")
    exact = usable.join(files.select("project", F.col("file").alias("s")), ["project", "s"]).select("project", "id", F.col("s").alias("file"))
    quoted = F.regexp_replace("s", r"([.^$+{}()|\\\[\]])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    deep = lambda c: F.size(F.split(c, "/"))
    wild = usable.filter(F.col("s").rlike(r"[*?]")).select("project", "id", pattern.alias("p"), _first_folder(F.col("s")).alias("first"), deep("s").alias("deep"))
    met = wild.join(_by_first_folder(files).withColumn("deep", deep("file")), ["project", "first", "deep"])
    return exact.unionByName(met.filter("file RLIKE p").select("project", "id", "file")).distinct()


def _first_folder(glob: Column) -> Column:
    """What a glob's files must begin with: its first segment if that is a folder without wildcards, else "*"."""
    return F.when(F.contains(glob, F.lit("/")) & ~F.substring_index(glob, "/", 1).rlike(r"[*?\[]"), F.substring_index(glob, "/", 1)).otherwise("*")


def _by_first_folder(files: DataFrame) -> DataFrame:
    """Files under their first segment, and once more under "*"."""
    return files.select("project", "file", F.explode(F.array_distinct(F.array(F.substring_index("file", "/", 1), F.lit("*")))).alias("first"))


def intent_part(intents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intent nodes and SCOPE_MATCH edges; ``intents`` has ``project, id, message, type, severity, status, scope``."""
    own = typed_id("intent", F.col("id"))
    n = nodes(intents, "intent", own, F.col("message"), type=F.col("type"), severity=F.col("severity"), status=F.col("status"), scope=F.col("scope"))
    return n, edges(scope_matches(intents, files), "SCOPE_MATCH", own, typed_id("file", F.col("file")), SCOPE_WEIGHT)


def guardrail_part(guardrails: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Guardrail nodes and PROTECTS edges: by their globs, all files of the project without any.

    ``guardrails`` has ``project, id, paths ARRAY<STRING>, reason``; they are configuration, a few a project.
    """
    own = typed_id("guardrail", F.col("id"))
    n = nodes(guardrails, "guardrail", own, F.coalesce("reason", "id"))
    each = guardrails.select("project", "id", F.explode_outer("paths").alias("glob"))
    below = F.regexp_replace(F.regexp_replace("glob", r"([.^$+{}()|\\\[\]])", r"\\$1"), r"/\*\*$", "\u0001")
    one = F.replace(F.replace(below, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    each = each.withColumn("p", F.concat(F.lit("^"), F.replace(one, F.lit("\u0001"), F.lit("(?:/.*)?")), F.lit("$")))
    each = each.withColumn("first", F.coalesce(_first_folder(F.col("glob")), F.lit("*")))
    met = _by_first_folder(files).join(each, ["project", "first"]).filter("p IS NULL OR file RLIKE p").select("project", "id", "file").distinct()
    return n, edges(met, "PROTECTS", own, typed_id("file", F.col("file")), 1.0)


def module_part(modules: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A module node for each project that names one, and CONTAINS edges to its files."""
    own = typed_id("module", F.col("module"))
    met = files.select("project", "file").join(modules.select("project", "module"), "project")
    return nodes(modules, "module", own, F.col("module")), edges(met, "CONTAINS", own, typed_id("file", F.col("file")), 1.0)


def snapshot_part(snapshots: DataFrame) -> DataFrame:
    return nodes(snapshots, "snapshot", typed_id("snapshot", F.col("snapshot_hash")), F.substring("snapshot_hash", 1, 8), at=F.col("at"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``project, src, import, dst``: the file each import means, or null for a dependency.

    ``imports`` has ``project, file, name``. Relative imports are joined to the file's folder.
    Others are tried by their endings, the shortest first, as a folder (its least file) or a path
    without extension, then by base name. All candidates of an import are rows with a priority;
    one join with the project's lookup rows and one aggregate pick the first that hits.
    """
    path = F.col("file")
    look = F.explode(
        F.array(
            F.struct(F.lit("stem").alias("kind"), paths.without_extension(path).alias("key")),
            F.struct(F.lit("dir").alias("kind"), paths.folder(path).alias("key")),
            F.struct(F.lit("base").alias("kind"), paths.base(path).alias("key")),
            F.struct(F.lit("base").alias("kind"), paths.without_extension(paths.base(path)).alias("key")),
        )
    ).alias("l")
    table = files.select("project", "file", look).select("project", "l.kind", "l.key", "file").filter("NOT (kind = 'dir' AND key = '.')")
    table = table.groupBy("project", "kind", "key").agg(F.min("file").alias("target"))
    imp = F.regexp_replace("name", "^[\"']+|[\"']+$", "")
    asked = imports.select("project", F.col("file").alias("src"), F.translate(imp, "\\", "/").alias("import")).filter("import <> ''").distinct()
    relative = F.col("import").rlike(r"^\.\.?/")
    joined = paths.cleaned(F.concat(paths.folder(F.col("src")), F.lit("/"), F.col("import")))
    parts = F.split("import", "/")

    def both(key: Column, prio: Column) -> Column:
        return F.array(
            F.struct((prio * 2).alias("prio"), F.lit("dir").alias("kind"), key.alias("key")), F.struct((prio * 2 + 1).alias("prio"), F.lit("stem").alias("kind"), key.alias("key"))
        )

    stems_first = F.array(
        F.struct(F.lit(0).alias("prio"), F.lit("stem").alias("kind"), joined.alias("key")), F.struct(F.lit(1).alias("prio"), F.lit("dir").alias("kind"), joined.alias("key"))
    )
    endings = F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: both(F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"), k))
    )
    base = F.array(F.struct(F.lit(1_000_000).alias("prio"), F.lit("base").alias("kind"), F.element_at(parts, -1).alias("key")))
    tries = F.when(relative, stems_first).when(F.col("import").startswith("/"), F.array_except(base, base)).otherwise(F.concat(endings, base))
    tried = asked.select("project", "src", "import", F.explode_outer(tries).alias("t")).select("project", "src", "import", "t.prio", "t.kind", "t.key")
    hit = tried.join(table, ["project", "kind", "key"], "left")
    best = F.min(F.when(F.col("target").isNotNull(), F.struct("prio", "target"))).alias("b")
    return hit.groupBy("project", "src", "import").agg(best).select("project", "src", "import", F.col("b.target").alias("dst"))


def import_part(resolved: DataFrame, weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """IMPORTS edges to files, DEPENDS_ON edges to dependency nodes for what no file explains."""
    outside = resolved.filter("dst IS NULL")
    src = typed_id("file", F.col("src"))
    n = nodes(outside.select("project", "import").distinct(), "dep", typed_id("dep", F.col("import")), F.col("import"))
    e = edges(resolved.filter("dst IS NOT NULL"), "IMPORTS", src, typed_id("file", F.col("dst")), weight, F.concat(F.lit("imports "), F.col("import")))
    return n, e.unionByName(edges(outside, "DEPENDS_ON", src, typed_id("dep", F.col("import")), weight, F.concat(F.lit("depends on "), F.col("import"))))


def test_part(symbols: DataFrame, definitions: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test nodes, and TESTS edges by name (0.9), else to all symbols of imported files (0.6).

    ``definitions`` has ``project, file, name``: what test files define; ``resolved`` is the result
    of :func:`resolved_imports`. A test and symbol get one edge, the one of greater weight.
    """
    tests = definitions.select("project", "file").union(resolved.select("project", "src")).distinct().filter(paths.is_test(F.col("file")))
    s = paths.test_stem(F.col("file"))
    by_file = tests.select("project", "file", F.explode(F.array(s, F.lower(s), paths.exported(s))).alias("name"))
    fns = definitions.filter(paths.is_test(F.col("file")))
    by_fn = fns.select("project", "file", F.explode(F.array(F.col("name"), paths.tested_name(F.col("name")))).alias("name"))
    names = by_file.unionByName(by_fn).filter("name IS NOT NULL AND trim(name) <> ''").distinct()
    target = symbols.select("project", "name", F.col("file").alias("in_file"), symbol_id(F.col("file"), F.col("name")).alias("target"))
    named = names.join(target, ["project", "name"]).select("project", "file", "target", F.lit(NAMING_WEIGHT).alias("w"), F.concat(F.lit("test name "), F.col("name")).alias("why"))
    imported = resolved.filter("dst IS NOT NULL").filter(paths.is_test(F.col("src"))).select("project", F.col("src").alias("file"), F.col("dst").alias("in_file")).distinct()
    near = imported.join(target, ["project", "in_file"]).select("project", "file", "target", F.lit(IMPORT_WEIGHT).alias("w"), F.concat(F.lit("test imports "), F.col("in_file")).alias("why"))
    best = named.unionByName(near).groupBy("project", "file", "target").agg(F.max(F.struct("w", "why")).alias("b"))
    own = typed_id("test", F.col("file"))
    return nodes(tests, "test", own, paths.base(F.col("file")), path=F.col("file")), edges(best, "TESTS", own, F.col("target"), F.col("b.w"), F.col("b.why"))


# ---- queries ----


def stats(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """``project, metric, key, value``: nodes and edges in all and by type; flags: dependencies with importers, and whether there are co-changes."""
    n = node_rows.groupBy("project", "type").agg(F.count(F.lit(1)).alias("value")).select("project", F.lit("nodes").alias("metric"), F.col("type").alias("key"), "value")
    e = edge_rows.groupBy("project", "type").agg(F.count(F.lit(1)).alias("value")).select("project", F.lit("edges").alias("metric"), F.col("type").alias("key"), "value")
    both = n.unionByName(e)
    total = both.groupBy("project", "metric").agg(F.sum("value").alias("value")).select("project", "metric", F.lit("").alias("key"), "value")
    flag = edge_rows.groupBy("project").agg(
        F.countDistinct(F.when(F.col("type") == "DEPENDS_ON", F.col("dst"))).alias("deps_with_importers"), F.max((F.col("type") == "CO_CHANGES_WITH").cast("long")).alias("has_co_changes")
    )
    flags = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("deps_with_importers", "has_co_changes")])).alias("x")
    return both.unionByName(total).unionByName(flag.select("project", F.lit("flags").alias("metric"), flags).select("project", "metric", "x.key", "x.value"))


def co_changes_of(edge_rows: DataFrame, node_ids: DataFrame, least: float = 0.0) -> DataFrame:
    """``project, id, other, weight``: files that change together with the given nodes, each once; edges of either direction at ``least`` or more."""
    met = incident(edge_rows.filter((F.col("type") == "CO_CHANGES_WITH") & (F.col("weight") >= least)), node_ids)
    other = F.when(F.col("out"), F.col("dst")).otherwise(F.col("src"))
    return met.groupBy("project", "id", other.alias("other")).agg(F.max("weight").alias("weight"))


def affected_files(edge_rows: DataFrame, node_rows: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """``project, seed, files, nodes``: distinct files, by the nodes' path or file, and nodes that a :func:`blast_radius` reaches; counted where they are found."""
    edge_rows, seeds = as_scan(edge_rows.select(_EDGE[:-1])), as_scan(seeds)
    at = as_scan(node_rows.select("project", "id", F.coalesce(F.col("attrs")["file"], F.col("attrs")["path"]).alias("file")))
    found, others = radius.split(edge_rows, seeds, BACKWARDS, depth, "affected", node_files=at)
    if others is None:
        return found
    far = _radius_by_joins(*(x.join(others, "project", "left_semi") for x in (edge_rows, seeds)), depth)
    rest = far.join(at, ["project", "id"], "left").groupBy("project", "seed").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("nodes"))
    return found.unionByName(rest)


def symbols_named(node_rows: DataFrame, names: DataFrame) -> DataFrame:
    """Symbol nodes of the given names (``project, label``)."""
    return node_rows.filter("type = 'symbol'").join(names.select("project", "label").distinct(), ["project", "label"], "left_semi")


def symbols_in(node_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol nodes of the given files (``project, file``)."""
    own = node_rows.filter("type = 'symbol'").withColumn("file", F.col("attrs")["file"])
    return own.join(files.select("project", "file").distinct(), ["project", "file"], "left_semi").drop("file")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """``project, id, degree``: edges in and out; a loop counts twice."""
    ends = edge_rows.select("project", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("project", "id").agg(F.count(F.lit(1)).alias("degree"))


def incident(edge_rows: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges at each node of ``node_ids`` (``project, id``), with ``id`` and ``out``."""
    return edge_rows.withColumn("id", F.col("src")).join(node_ids, ["project", "id"], "left_semi").withColumn("out", F.lit(True)).unionByName(
        edge_rows.withColumn("id", F.col("dst")).join(node_ids, ["project", "id"], "left_semi").withColumn("out", F.lit(False))
    )


def trace(edge_rows: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Every relation of the given nodes with its ``role``; edges without a role are left out."""
    t, out = F.col("type"), F.col("out")
    role = (
        F.when(t == "CALLS", F.when(out, "callees").otherwise("callers"))
        .when((t == "IMPORTS") & ~out, "imported_by")
        .when(t.isin("IMPORTS", "DEPENDS_ON") & out, "imports")
        .when(t == "TESTS", F.when(out, "tested").otherwise("tests"))
        .when(t == "SCOPE_MATCH", "intents")
        .when((t == "HAS_TODO") & out, "todo")
        .when(t == "CO_CHANGES_WITH", "co_changes")
        .when((t == "CONTAINS") & out, "contains")
        .when((t == "DEFINED_IN") & out, "defined_in")
        .when(t == "PROTECTS", F.when(out, "protected").otherwise("protects"))
    )
    return incident(edge_rows, node_ids).withColumn("role", role).filter("role IS NOT NULL").select("project", "id", "role", "type", "src", "dst", "weight")


def coverage(edge_rows: DataFrame, node_ids: DataFrame) -> DataFrame:
    return trace(edge_rows, node_ids).filter("role = 'tests'").select("project", "id", F.col("src").alias("test"), "weight")


def scope(node_rows: DataFrame, pattern: str) -> DataFrame:
    """File nodes whose path the pattern matches."""
    return node_rows.filter("type = 'file'").filter(F.col("attrs")["path"].rlike(globs.scope_pattern(pattern)))


def resolve(node_rows: DataFrame, term: str, project: str) -> str:
    """Id of the one node that a term means: an id, ``symbol:name@file``, a file or a bare symbol name.

    Raises ``LookupError`` if there is none or more than one (a name in several files).
    """
    own = node_rows.filter(F.col("project") == project)
    name, _, file = term.removeprefix("symbol:").partition("@")
    tries = [F.col("id") == term]
    if file:
        tries.append(F.col("id") == f"symbol:{file}::{name}")
    else:
        tries += [F.col("id") == f"file:{term}", (F.col("type") == "symbol") & (F.col("label") == name)]
    for t in tries:
        found = [r.id for r in own.filter(t).select("id").limit(2).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise LookupError(f"{term} is ambiguous: {', '.join(found)}")
    raise LookupError(f"{term} isn't in the graph")


def blast_radius(edge_rows: DataFrame, seeds: DataFrame, depth: int = 3, digits: int | None = None) -> DataFrame:
    """``project, seed, id, score, depth``: what a change of each seed reaches within ``depth`` steps.

    ``seeds`` has ``project, seed``. Steps go along all edges, and back along dependencies. A node's
    score sums the steps into it; each step carries the score its origin was first reached with,
    times the weight. Nodes of a level are expanded in the order they were reached, a node's steps
    in order of direction, type and neighbour. ``digits`` of scores are kept where given.

    Each project's graph is packed and searched by the tasks that have its seeds, so that nothing reached is moved;
    projects too large for that (``radius.LARGEST``) are searched by joins.
    """
    edge_rows, seeds = as_scan(edge_rows.select(_EDGE[:-1])), as_scan(seeds)
    found, others = radius.split(edge_rows, seeds, BACKWARDS, depth, "scores", digits)
    if others is None:
        return found
    far = _radius_by_joins(*(x.join(others, "project", "left_semi") for x in (edge_rows, seeds)), depth)
    return found.unionByName(far if digits is None else far.withColumn("score", F.round("score", digits)))


def ordered_radius(edge_rows: DataFrame, seeds: DataFrame, depth: int = 3, digits: int = 6) -> DataFrame:
    """``project, seed, id, place``: what :func:`blast_radius` finds, the greatest score first, then by id; ordered where it is found."""
    edge_rows, seeds = as_scan(edge_rows.select(_EDGE[:-1])), as_scan(seeds)
    found, others = radius.split(edge_rows, seeds, BACKWARDS, depth, "places", digits)
    if others is None:
        return found
    far = _radius_by_joins(*(x.join(others, "project", "left_semi") for x in (edge_rows, seeds)), depth).select("project", "seed", "id", F.round("score", digits).alias("score"))
    return found.unionByName(ranking.placed(far, ["project", "seed"], [F.col("score").desc(), F.col("id")]).drop("score"))


def _radius_by_joins(edge_rows: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """A :func:`blast_radius` of projects of any size: all seeds advance together, a level is one join of the frontier with the steps."""
    forward = edge_rows.select("project", F.col("src").alias("at"), F.col("dst").alias("to"), "weight", F.struct(F.lit(0).alias("d"), "type", F.col("dst").alias("n")).alias("o"))
    backward = edge_rows.filter(F.col("type").isin(*BACKWARDS)).select(
        "project", F.col("dst").alias("at"), F.col("src").alias("to"), "weight", F.struct(F.lit(1).alias("d"), "type", F.col("src").alias("n")).alias("o")
    )
    checkpoint_dir(edge_rows.sparkSession)
    steps = stored(forward.unionByName(backward))  # joined on every level
    key = ["project", "seed"]
    frontier = seeds.select(*key, F.col("seed").alias("at"), F.lit(1.0).alias("first"), F.lit(0).cast("long").alias("pos"))
    seen = frontier.select(*key, F.col("at").alias("to"))
    taken = None
    for level in range(1, depth + 1):
        reached = frontier.join(steps, ["project", "at"]).select(*key, "to", (F.col("first") * F.col("weight")).alias("part"), F.struct("pos", "o").alias("order"), F.lit(level).alias("depth"))
        reached = reached if level == depth else reached.checkpoint()  # read by the result and the next level
        taken = reached if taken is None else taken.unionByName(reached)
        if level == depth:
            break
        new = reached.join(seen, [*key, "to"], "left_anti").groupBy(*key, "to").agg(F.min_by("part", "order").alias("first"), F.min("order").alias("order"))
        frontier = new.select(*key, F.col("to").alias("at"), "first", F.row_number().over(Window.partitionBy(*key).orderBy("order")).cast("long").alias("pos"))
        seen = seen.unionByName(frontier.select(*key, F.col("at").alias("to")))
    total = taken.filter("to <> seed").groupBy(*key, F.col("to").alias("id"))
    return total.agg(F.sum("part").alias("score"), F.min("depth").alias("depth"))


def shortest_paths(edge_rows: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """``project, src, dst, path ARRAY<STRING>``: a shortest path along edges for each pair, the least of equally long ones; none, or none within ``most`` steps where given: no row.

    The frontier holds one row for each pair and node reached first on that level, with the least
    path to it, so that it never exceeds the number of nodes a pair can reach.
    """
    checkpoint_dir(edge_rows.sparkSession)
    steps = stored(edge_rows.select("project", F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    key = ["project", "a", "b"]
    frontier = pairs.select("project", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("src").alias("at"), F.array("src").alias("path"))
    seen, found = frontier, frontier.filter("a = b").select(*key, "path")
    frontier = frontier.filter("a <> b")
    for _ in itertools.count() if most is None else range(most):
        ahead = frontier.join(steps, ["project", "at"]).select(*key, F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        new = ahead.join(seen.select(*key, "at"), [*key, "at"], "left_anti").groupBy(*key, "at").agg(F.min("path").alias("path")).checkpoint()
        if new.isEmpty():
            break
        found = found.unionByName(new.filter("at = b").select(*key, "path"))
        open_ = new.join(new.filter("at = b").select(*key), key, "left_anti")
        seen, frontier = seen.unionByName(open_), open_
    return found.select("project", F.col("a").alias("src"), F.col("b").alias("dst"), "path")


def visible_links(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edges both ends of which are among the nodes."""
    ids = node_rows.select("project", "id")
    return edge_rows.join(ids.withColumnRenamed("id", "src"), ["project", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi")


def exported_nodes(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes with their degree and attributes as a sorted ``k=v`` list."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return node_rows.join(degrees(edge_rows), ["project", "id"], "left").select("project", "id", "type", "label", attrs.alias("attrs"), F.coalesce("degree", F.lit(0)).alias("degree"))


def exported_edges(edge_rows: DataFrame) -> DataFrame:
    """Edges for the delimited export: the id of each and the weight with four decimals."""
    own = F.concat_ws("|", "type", "src", "dst")
    return edge_rows.select("project", own.alias("id"), "type", "src", "dst", F.format_string("%.4f", F.coalesce("weight", F.lit(0.0))).alias("weight"))


def whole_attr(attrs: Column, key: str) -> Column:
    """A whole number among attributes; null without it or where it isn't one."""
    return F.when(attrs[key].rlike(r"^[+-]?\d+$"), attrs[key].try_cast("bigint"))


def parsed_attrs(text: Column) -> Column:
    """Attributes of an export's ``k=v`` list; a part without ``=`` belongs to none and is left out."""
    pairs = F.filter(F.split(text, ","), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value"))))


def json_nodes(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """``project, id, json``: nodes for drawing, with state, file, attributes and degree."""
    n = node_rows.join(degrees(edge_rows), ["project", "id"], "left")
    a = F.col("attrs")
    fields = F.struct("id", "label", "type", a["state"].alias("state"), F.coalesce(a["file"], a["path"]).alias("file"), F.coalesce("degree", F.lit(0)).alias("degree"), "attrs")
    return n.select("project", "id", F.to_json(fields).alias("json"))


def json_links(edge_rows: DataFrame) -> DataFrame:
    """``project, id, json``: edges for drawing."""
    own = F.concat_ws("|", "type", "src", "dst")
    return edge_rows.select("project", own.alias("id"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "weight")).alias("json"))


def node_size(degree: Column) -> Column:
    """Size at which a node is drawn."""
    return 2 + F.log2(degree + 1)
