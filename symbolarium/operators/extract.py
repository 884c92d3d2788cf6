"""From file contents to facts: lines, definitions, calls, todos and ignore markers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolarium.functions import paths
from symbolarium.sources.languages import CONFIDENCE, LANGUAGES, Language

#: Todo words, and the markers of symbols and files to be ignored.
TODO_WORDS = "TODO|FIXME|XXX|HACK|NOTE"
IGNORE_MARK = r"@(?:\w+-)?ignore-(unstable|unused|abandoned)\b"
IGNORE_FILE = r"@\w+-ignore-file\b"


def language_of(path: Column, first_line: Column, languages: list[Language] = LANGUAGES) -> Column:
    """Language by the lower-case extension, else by the interpreter of a ``#!`` line; null for none.

    The interpreter is the base name of the first word, or the second word after ``env``; the first
    language with a shebang that begins the interpreter's name is taken.
    """
    ids = [(e, x.id) for x in reversed(languages) for e in x.extensions]  # of several languages the first
    by_ext = F.try_element_at(_constant_map(dict(ids), "string"), paths.extension(path))
    words = F.split(F.trim(F.regexp_extract(F.coalesce(first_line, F.lit("")), r"^#!(.*)$", 1)), r"\s+")
    marks = [(m, x.id) for x in languages for m in x.shebangs]

    def named(w: Column) -> Column:
        """The language of an interpreter's words."""
        return F.when((w[0] == "env") & (F.size(w) > 1), F.try_element_at(w, F.lit(2))).otherwise(w[0])

    # each step is evaluated once, as the only item of an array
    parts = F.transform(F.array(words), lambda w: F.concat(F.array(paths.base(w[0])), F.slice(w, 2, 1)))
    by_mark = F.transform(parts, lambda w: F.coalesce(*[F.when(named(w).startswith(m), F.lit(id_)) for m, id_ in marks]) if marks else F.lit(None).cast("string"))
    return F.coalesce(by_ext, by_mark[0])


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """All columns but ``content``, and ``line_no`` (from 1) and ``line``; a file is split at ``\\n`` or ``\\r\\n``.

    Null contents give no lines, empty ones one empty line. A very long line is one row.
    """
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(F.split(content, "\r?\n")).alias("__at", "line")).select(*rest, (F.col("__at") + 1).alias("line_no"), "line")


def files_without_ignored(files: DataFrame, content: str = "content") -> DataFrame:
    """Without files that carry the ignore mark in their first 200 characters."""
    return files.filter(~F.coalesce(F.substring(content, 1, 200), F.lit("")).rlike(IGNORE_FILE))


def _of_language(value, languages: list[Language]) -> Column:
    """``value(language)`` of the row's language; null for languages without one.

    A lookup in a constant map, so that an expression is as long for thirty languages as for one. Spark
    keeps the last pattern compiled: neighbouring lines are mostly of one file.
    """
    known = {x.id: v for x in languages if (v := value(x)) is not None}
    kind = {str: "string", float: "double", tuple: "array<string>"}[type(next(iter(known.values()), ""))]
    return F.try_element_at(_constant_map(known, kind), F.col("language"))


def _constant_map(values: dict, kind: str) -> Column:
    """A map as one literal, which the planner reads once."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def _slots(values, languages: list[Language]) -> list[Column]:
    """The first, second, ... of the texts ``values(language)`` of the row's language, as many as any language has."""
    most = max((len(values(x)) for x in languages), default=0)
    return [_of_language(lambda x, k=k: values(x)[k] if k < len(values(x)) else None, languages) for k in range(most)]


def _extracted(line: Column, pattern: Column, group: int = 1) -> Column:
    return F.call_function("regexp_extract", line, pattern, F.lit(group))


def definition(line: Column, languages: list[Language] = LANGUAGES) -> Column:
    """Name that the line defines, or null: the first pattern with a name that isn't a keyword; needs a column ``language``."""
    words = _of_language(lambda x: x.keywords, languages)
    names = [_extracted(line, p) for p in _slots(lambda x: (*x.functions, *x.types), languages)]
    return F.coalesce(*[F.when((n != "") & ~F.array_contains(words, n), n) for n in names])


def definitions(lined: DataFrame, languages: list[Language] = LANGUAGES) -> DataFrame:
    """Rows of ``lines`` with a column ``language`` that define something, with ``name`` and ``confidence``."""
    sure = _of_language(lambda x: CONFIDENCE[x.tier], languages)
    return lined.withColumn("name", definition(F.col("line"), languages)).filter("name IS NOT NULL").withColumn("confidence", sure)


def calls(lined: DataFrame, languages: list[Language] = LANGUAGES) -> DataFrame:
    """Names called by lines that define nothing and aren't comments: each once a line, without keywords."""

    line = F.col("line")
    trimmed = F.btrim(line, F.lit(" \t\r\n"))
    comment = F.lit(False)
    for mark in _slots(lambda x: x.line_comments, languages):
        comment = comment | F.coalesce(F.startswith(trimmed, mark), F.lit(False))
    found = [F.coalesce(F.call_function("regexp_extract_all", line, p, F.lit(1)), F.array().cast("array<string>")) for p in _slots(lambda x: x.calls, languages)]
    words = _of_language(lambda x: ("", *x.keywords), languages)
    names = F.array_except(F.array_distinct(F.flatten(F.array(*found))), words)
    sure = _of_language(lambda x: CONFIDENCE[x.tier], languages)
    plain = lined.filter(~comment & definition(line, languages).isNull())
    return plain.withColumn("name", F.explode(names)).withColumn("confidence", sure)


def todo_pattern(lang: Language) -> str:
    """A todo word and a colon behind one of the language's comment marks at the start of a line; only ``\\n`` ends a line."""
    marks = [re.escape(m) for m in (*lang.line_comments, *lang.block_comments)] or ["//", "#"]
    return rf"(?id)^\s*(?:{'|'.join(marks)}|\*+|/\*)\s*({TODO_WORDS}):\s*(.+)"


def todos(lined: DataFrame, languages: list[Language] = LANGUAGES) -> DataFrame:
    """Rows of ``lines`` that hold a todo, with ``type`` in upper case and trimmed ``text``."""
    kind, text = (_extracted(F.col("line"), _of_language(todo_pattern, languages), k) for k in (1, 2))
    return lined.withColumn("type", F.upper(kind)).filter("type <> ''").withColumn("text", F.btrim(text, F.lit(" \t\r\n")))


#: Patterns of definitions in any language, for what ignore markers precede.
GENERAL = (
    r"func\s+(\w+)\s*\(", r"(?:async\s+)?def\s+(\w+[?!]?)", r"(?:async\s+)?function\s+(\w+)\s*\(", r"(?:pub\s+)?fn\s+(\w+)\s*[<(]",
    r"sub\s+(\w+)\s*[{(]", r"defp?\s+(\w+[?!]?)",
)
#: Lines below a marker among which its symbol is, and below the symbol among which its name comes again where its body begins; lines it has else.
NEAR, AGAIN, ELSE = 10, 50, 10
_SIGNS = ("//", "#", "--", "%", ";")


def _captured(lines: pa.Array, pattern: str) -> pa.Array:
    """The first group's first match in each line, or null; empty matches count as none."""
    named = re.sub(r"(?<!\\)\((?!\?)", "(?P<x>", pattern, count=1)
    found = pc.struct_field(pc.extract_regex(lines, named), "x")
    return pc.if_else(pc.equal(found, ""), pa.scalar(None, pa.string()), found)


class _Lines:
    """All lines of a batch's texts as one array, with what is asked of each line."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.text = lists.flatten()
        self.first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        self.trimmed = pc.utf8_trim_whitespace(self.text)
        self.file = np.repeat(np.arange(len(lists)), np.diff(self.first))

    def braces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many braces are open after each line, whether it can end a body, and whether it can begin one."""
        opened = pc.count_substring(self.text, "{").to_numpy() - pc.count_substring(self.text, "}").to_numpy()
        ends = pc.match_substring_regex(self.trimmed, r"\}|[);]$").to_numpy(zero_copy_only=False)
        begins = pc.match_substring_regex(self.trimmed, r"[{(]").to_numpy(zero_copy_only=False)
        return np.cumsum(opened), ends, begins


def _marked(lines: _Lines, languages: list[str | None], by_id: dict[str, Language]) -> tuple[np.ndarray, ...]:
    """For each marker that a definition follows: its line, the definition's, the end's (all in ``lines``), name and kind."""
    at = np.flatnonzero(pc.match_substring_regex(lines.text, IGNORE_MARK).to_numpy(zero_copy_only=False))
    of = np.array([by_id.get(languages[f], None) is not None and languages[f] or "" for f in lines.file[at]], dtype=object)
    below = at[:, None] + np.arange(1, NEAR + 1)
    last = lines.first[lines.file[at] + 1]
    there = below < last[:, None]
    keep = np.zeros(len(at), bool)
    names = np.full(below.shape, None, dtype=object)
    for id_ in set(of):
        own = np.flatnonzero(of == id_)
        lang = by_id.get(id_)
        signs = (*lang.line_comments, *lang.block_comments) if lang else _SIGNS
        comment = "|".join(map(re.escape, signs))
        trimmed = lines.trimmed.take(pa.array(at[own]))
        keep[own] = pc.match_substring_regex(trimmed, f"(?:{comment}).*?{IGNORE_MARK}").to_numpy(zero_copy_only=False) if signs else True
        want = np.unique(below[own][there[own]])
        near = lines.trimmed.take(pa.array(want))
        patterns = (*(lang.functions if lang else ()), *GENERAL)
        found = pc.coalesce(*[_captured(near, p) for p in patterns]) if len(want) else pa.array([], pa.string())
        table = np.array(found.to_pylist(), dtype=object)
        place = np.searchsorted(want, below[own])
        for row, o in enumerate(own):
            names[o, there[o]] = table[place[row, there[o]]]
    has = names != None  # noqa: E711
    keep &= has.any(axis=1)
    first = has.argmax(axis=1)
    at, at_def, name = at[keep], below[np.arange(len(at)), first][keep], names[np.arange(len(at)), first][keep]
    kind = pc.struct_field(pc.extract_regex(lines.text.take(pa.array(at)), IGNORE_MARK.replace("(unstable", "(?P<k>unstable")), "k")
    open_, ends, begins = lines.braces()
    stop = np.empty(len(at), np.int64)
    for k, (d, n, upto) in enumerate(zip(at_def, name, lines.first[lines.file[at] + 1])):
        again = [i for i in range(d + 1, min(upto, d + 1 + AGAIN)) if begins[i] and n in lines.trimmed[i].as_py()]
        closing = (i + np.flatnonzero((open_[i:upto] <= open_[i - 1]) & ends[i:upto])[:1] for i in again)
        stop[k] = next((c[0] for c in closing if len(c)), d + ELSE)
    return at, at_def, stop, name, kind


def ignore_markers(files: DataFrame, languages: list[Language] = LANGUAGES, keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """``keys..., language, line, end_line, name, ignore_type``: ignore markers in comments and the symbol each precedes.

    ``files`` has ``keys, language, content``. The symbol is the first that a pattern finds within 10
    lines below; it ends where the braces are closed again that are open at the next line that names it,
    10 lines on where there is none. Only files with a marker reach Python, where the lines of a batch of
    files are one array; nulls have no markers.
    """
    by_id = {x.id: x for x in languages}
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = _Lines(batch.column(width + 1))
            at, at_def, stop, name, kind = _marked(lines, batch.column(width).to_pylist(), by_id)
            if len(at):
                file = lines.file[at]
                base = lines.first[file]
                end = np.maximum(stop - base + 1, at_def - base + 2)
                own = [c.take(pa.array(file)) for c in batch.columns[: width + 1]]
                numbers = [pa.array((at - base + 1).astype(np.int32)), pa.array(end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array(name.tolist(), pa.string()), kind], [*keys, "language", "line", "end_line", "name", "ignore_type"])

    kinds = dict(files.dtypes)
    marked = files.select(*keys, "language", "content").filter(F.col("content").rlike(IGNORE_MARK))
    return marked.mapInArrow(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, language string, line int, end_line int, name string, ignore_type string")


_SKIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\'', re.DOTALL)
_FUNC = re.compile(r"^func\s+(\((?:[^()]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*\(", re.MULTILINE)
_GO_CALL = re.compile(r"(\w+)[ \t]*\(")
_GO_INTERFACE = re.compile(r"\binterface\s*\{")
_IMPORT = re.compile(r'^import\s*(?:\(([^)]*)\)|[\w.]*\s*"([^"]+)")', re.MULTILINE)
_GO_TODO = re.compile(rf"(?i)(?://|/\*|\*)\s*({TODO_WORDS}):\s*(.*)")
_GO_WORDS = frozenset("if for switch select return func go defer range case map chan struct interface type var const package import else".split())


def _by_depth(at: np.ndarray, depth: np.ndarray) -> dict[int, np.ndarray]:
    """Places in order, by their depth."""
    order = np.argsort(depth, kind="stable")
    levels, starts = np.unique(depth[order], return_index=True)
    return dict(zip(levels.tolist(), np.split(at[order], starts[1:])))


def _go(source: str) -> Iterator[tuple]:
    """``kind, name, line, end_line, is_method, is_interface, text`` of a Go source.

    Strings and comments are blanked out; depths of brackets are running sums over all characters, and
    a declaration's end is the next closing brace of its depth, by binary search.
    """
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    chars = np.frombuffer(blank.encode("utf-32-le"), np.uint32)
    newlines = np.flatnonzero(chars == 10)

    def line(i: int) -> int:
        return int(np.searchsorted(newlines, i)) + 1

    for m in _SKIP.finditer(source):
        if m[0][:1] == "/" and (t := _GO_TODO.search(m[0])):
            yield "todo", t[1].upper(), line(m.start()), line(m.start()), False, False, t[2].strip()
    plain = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:1] == "/" else m[0], source)
    for m in _IMPORT.finditer(plain):
        for q in re.finditer(r'"([^"]+)"', m[0]):
            yield "import", q[1], line(m.start() + q.start()), line(m.start() + q.start()), False, False, None
    parens = np.cumsum((chars == 40).astype(np.int64) - (chars == 41))
    braces = np.cumsum((chars == 123).astype(np.int64) - (chars == 125))
    turns = np.flatnonzero((chars == 123) | (chars == 10))
    closes = np.flatnonzero(chars == 125)
    turn_at, close_at = _by_depth(turns, parens[turns]), _by_depth(closes, braces[closes])
    none = np.empty(0, np.int64)
    declared = set()
    for m in _FUNC.finditer(blank):
        declared.add(m.start(2))
        outer = int(parens[m.end() - 1]) - 1  # depth around the parameters
        ahead = turn_at.get(outer, none)
        k = int(np.searchsorted(ahead, m.end()))
        begin = int(ahead[k]) if k < len(ahead) else len(blank) - 1
        end, body = begin, k < len(ahead) and chars[begin] == 123
        if body:
            back = close_at.get(int(braces[begin]) - 1, none)
            k = int(np.searchsorted(back, begin))
            end = int(back[k]) if k < len(back) else len(blank) - 1
        yield "def", m[2], line(m.start()), line(end), m[1] is not None, not body, None
    outside = np.ones(len(blank) + 1, bool)  # what an interface lists isn't called there
    for m in _GO_INTERFACE.finditer(blank):
        back = close_at.get(int(braces[m.end() - 1]) - 1, none)
        k = int(np.searchsorted(back, m.end()))
        outside[m.end() : back[k] if k < len(back) else len(blank)] = False
    for m in _GO_CALL.finditer(blank):
        if m[1] not in _GO_WORDS and m.start(1) not in declared and outside[m.start(1)]:
            yield "call", m[1], line(m.start(1)), line(m.start(1)), False, False, None


def go_symbols(files: DataFrame, keys: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """``keys..., kind, name, line, end_line, is_method, is_interface, text``: what Go files declare, call, import and leave to do.

    ``files`` has ``keys, content``. ``kind`` is ``def``, ``call``, ``import`` or ``todo`` (with its type as name).
    A declaration without a body is marked ``is_interface``. Files that don't parse give what was found.
    """
    width = len(keys)
    names = ["kind", "name", "line", "end_line", "is_method", "is_interface", "text"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, c in enumerate(batch.column(width).to_pylist()) if c for r in _go(c)]
            if rows:
                at, *columns = zip(*rows)
                own = [c.take(pa.array(at)) for c in batch.columns[:width]]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types))], [*keys, *names])

    kinds = dict(files.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return files.select(*keys, "content").mapInArrow(run, f"{schema}, kind string, name string, line int, end_line int, is_method boolean, is_interface boolean, text string")


def facts(files: DataFrame, keys: list[str], languages: list[Language] = LANGUAGES) -> DataFrame:
    """``keys..., type, name, line, end_line, language, metadata, confidence``: all that can be read from files.

    ``files`` has ``keys`` (the last of which is the path) and ``content``. Files with the ignore mark give
    nothing. Files are routed by their detected language: those of the tier ``ast`` to the scanner of Go,
    others to the patterns of their lines, files of no known language only to the ignore markers, which
    all others are searched for too. ``type`` is ``function_defined``, ``function_called``,
    ``import_found``, ``todo_found`` or ``ignore_flag``; ``metadata`` has ``source_tier`` and what the type brings.
    Rows of unknown ends have ``end_line`` 0. Null contents give nothing.
    """
    path = keys[-1]
    known = files_without_ignored(files.select(*keys, "content").filter("content IS NOT NULL"))
    known = known.withColumn("language", language_of(F.col(path), F.substring_index("content", "\n", 1), languages))
    parsed = [x.id for x in languages if x.tier == "ast"]
    tier = _of_language(lambda x: x.tier, languages)
    sure = _of_language(lambda x: CONFIDENCE[x.tier], languages)

    def rows(df: DataFrame, kind: Column, end: Column, **more: Column) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {"source_tier": tier, **more}.items()])
        packed = F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
        return df.select(*keys, kind.alias("type"), "name", "line", end.cast("int").alias("end_line"), "language", packed.alias("metadata"), F.coalesce(sure, F.lit(0.8)).alias("confidence"))

    go = go_symbols(known.filter(F.col("language").isin(*parsed)), keys).withColumn("language", F.lit(parsed[0] if parsed else None))
    names = {"def": "function_defined", "call": "function_called", "import": "import_found", "todo": "todo_found"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("kind")]
    todo = F.col("kind") == "todo"
    parts = [
        rows(
            go.withColumn("todo_type", F.when(todo, F.col("name"))).withColumn("name", F.when(~todo, F.col("name")).otherwise("")), kind, F.col("end_line"),
            is_method=F.when(F.col("is_method"), "true"), is_interface=F.when(F.col("is_interface"), "true"), type=F.col("todo_type"), text=F.col("text"),
        )
    ]
    lined = lines(known.filter(~F.col("language").isin(*parsed))).withColumnRenamed("line_no", "at")
    for df, label, more in (
        (definitions(lined, languages), "function_defined", {}),
        (calls(lined, languages), "function_called", {}),
        (todos(lined, languages).withColumn("name", F.lit("")), "todo_found", {"type": F.col("todo_type"), "text": F.col("text")}),
    ):
        df = df.withColumnRenamed("type", "todo_type") if "text" in more else df
        parts.append(rows(df.withColumn("line", F.col("at")), F.lit(label), F.lit(0), **more))
    marks = ignore_markers(known, languages, keys)
    parts.append(rows(marks, F.lit("ignore_flag"), F.col("end_line"), ignore_type=F.col("ignore_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
