"""The bar-delimited text format: records, sections, exports with a trailing hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.text import escape, unescape
from symbolarium.operators.reports import EXPORT_ORDER

#: A backslash with what follows it, a bar, or a run without either.
_TOKEN = r"(?s)(\\.?|\||[^\\|]+)"


def record(*columns):
    """A record of the format: escaped fields with bars between them."""
    return F.concat_ws("|", *[escape(F.col(c) if isinstance(c, str) else c) for c in columns])


def fields(line):
    """Trimmed, unescaped fields of a record, as an array."""
    # bars between fields are marked by U+0001 and b, and U+0001 itself by U+0001 and a, so that any text can be told apart
    marked = F.transform(F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(1)), lambda t: F.when(t == "|", "\u0001b").otherwise(F.replace(t, F.lit("\u0001"), F.lit("\u0001a"))))
    parts = F.split(F.array_join(marked, ""), "\u0001b", -1)
    return F.transform(parts, lambda x: unescape(F.replace(F.trim(x), F.lit("\u0001a"), F.lit("\u0001"))))


def parsed(lines: DataFrame, columns: list[str], header: list[str] | None = None, required: list[str] = ()) -> DataFrame:
    """Records of ``lines`` (``line``, without header, comments and blank lines) as ``columns``, found by their place in ``header``.

    Columns that the header doesn't have are empty, unknown ones are ignored. A missing required column is an error.
    """
    header = header or columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    parts = lines.filter("trim(line) <> '' AND NOT line LIKE '#%'").select(fields(F.col("line")).alias("f"))
    pick = [F.coalesce(F.get("f", F.lit(header.index(c))), F.lit("")).alias(c) if c in header else F.lit("").alias(c) for c in columns]
    return parts.select(*pick)


def read(spark, path: str, columns: list[str], required: list[str] = ()) -> DataFrame:
    """A delimited file or folder of files of one layout; the header is the first record of the first file.

    Text files are split among tasks like any others; gzip is read by its suffix.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter("trim(line) <> '' AND NOT line LIKE '#%'")
    first = lines.select(fields(F.col("line"))).head()
    header = list(first[0]) if first else list(columns)
    return parsed(lines.filter(record(*[F.lit(h) for h in header]) != F.col("line")), columns, header, required)


def write(df: DataFrame, path: str, columns: list[str], compression: str = "gzip") -> None:
    """Records as text files, each with the header before its first record."""
    body = df.select(record(*columns).alias("value"))
    head = "|".join(columns)

    def with_header(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            values = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([head, *values] if first else values, pa.string())], ["value"])
            first = False

    body.mapInArrow(with_header, "value string").write.mode("overwrite").option("compression", compression).text(path)


def sections(numbered: DataFrame, document: str = "document") -> DataFrame:
    """``document, section, row, line``: lines of files with ``# name`` headings; lines before the first heading have section "".

    ``numbered`` has ``document, line_no, line``: a state file is one document of its own.
    """
    w = Window.partitionBy(document).orderBy("line_no")
    name = F.when(F.col("line").startswith("# "), F.trim(F.substring("line", 3, 1000)))
    marked = numbered.withColumn("section", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("")))
    body = marked.filter("trim(line) <> '' AND NOT line LIKE '#%'")
    return body.withColumn("row", F.row_number().over(Window.partitionBy(document, "section").orderBy("line_no"))).select(document, "section", "row", "line")


def symbol_records(symbols: DataFrame) -> DataFrame:
    """``project, line``: a state file's symbol records; confidence with two decimals, times in RFC 3339, the score so that it reads back the same."""
    line = record(
        "file", "name", "line", "type", "language", "state", F.format_string("%.2f", F.coalesce(F.col("confidence"), F.lit(0.0))),
        F.date_format(F.col("last_touched").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "churn_count", F.col("instability_score").cast("string"),
    )
    return symbols.select("project", "file", "name", line.alias("line"))


def export_lines(symbols: DataFrame, todos: DataFrame, intents: DataFrame) -> DataFrame:
    """``project, section, title, line``: what each project's export holds: active intents, symbols by state, open todos.

    Sorted by ``project, section, line`` it is the export without its hash; no group is gathered.
    """
    order = F.array_position(F.array(*map(F.lit, EXPORT_ORDER)), F.col("state"))

    def part(df: DataFrame, number, title, *columns: str) -> DataFrame:
        return df.select("project", number.alias("section"), title.alias("title"), record(*columns).alias("line"))

    rows = part(intents.filter("status = 'active'"), F.lit(0).cast("long"), F.lit("intents"), "id", "type", "severity", "message")
    rows = rows.unionByName(part(symbols.filter(order > 0), order, F.col("state"), "file", "name", "line", "type"))
    return rows.unionByName(part(todos.filter("NOT coalesce(resolved, false)"), F.lit(9).cast("long"), F.lit("todos"), "file", "line", "type", "text"))


def context_text(lines: DataFrame) -> DataFrame:
    """``project, text``: exports as texts with a trailing hash of all before it, from :func:`export_lines`.

    For the projects an agent asks for: each one's text is put together by one task, as it is one object.
    """
    blocks = lines.groupBy("project", "section", "title").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    block = F.struct("section", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.col("body"), F.lit("\n")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"]), "")
    return blocks.groupBy("project").agg(text.alias("text")).select("project", F.concat("text", F.lit("hash|"), F.sha2("text", 256), F.lit("\n")).alias("text"))


def verified(exports: DataFrame) -> DataFrame:
    """``exports`` with ``valid``: the trailing hash is that of what precedes it; without one it isn't."""
    stored = F.regexp_extract("text", r"(?s)hash\|([0-9a-f]{64})\n$", 1)
    body = F.regexp_extract("text", r"(?s)^(.*)hash\|[0-9a-f]{64}\n$", 1)
    return exports.withColumn("valid", (stored != "") & (F.sha2(body, 256) == stored))


def context_report(symbols: DataFrame, todos: DataFrame, intents: DataFrame, snapshots: DataFrame, newest: int = 5) -> DataFrame:
    """``project, section, line``: the short report for agents: active intents, counts of states that need something, open todos, the newest snapshots' short hashes.

    ``snapshots`` is the result of :func:`operators.current.snapshots`.
    """
    counts = symbols.filter(F.col("state").isin("planned", "unstable", "unused", "abandoned")).groupBy("project", "state").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        intents.filter("status = 'active'").select("project", F.lit("intents").alias("section"), record("id", "type", "severity", "status", "message").alias("line")),
        counts.select("project", F.lit("symbols").alias("section"), record("state", "n").alias("line")),
        todos.filter("NOT coalesce(resolved, false)").select("project", F.lit("todos").alias("section"), record("file", "line", "type", "text").alias("line")),
        snapshots.filter(F.col("ord") >= F.col("n") - newest).select("project", F.lit("snapshots").alias("section"), F.substring("snapshot_hash", 1, 8).alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
