"""Project state files: sections of delimited records, written from tables and read into tables of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.sources.delimited import fields, parsed, record, sections

#: Sections in their order and their columns, each with the type it is read as.
SECTIONS = {
    "state": {"version": "string", "updated_at": "timestamp"},
    "git": {"hash": "string", "message": "string", "time": "timestamp"},
    "symbols": {
        "name": "string", "file": "string", "line": "int", "col": "int", "end_line": "int", "end_col": "int", "type": "string", "lang": "string", "state": "string", "confidence": "double",
        "defined": "boolean", "called": "boolean", "todo": "boolean", "churn": "int", "instability": "double", "marker": "string", "source": "string", "touched": "timestamp",
    },
    "todos": {"file": "string", "line": "int", "text": "string", "type": "string", "lang": "string", "resolved": "boolean"},
    "files": {"path": "string", "lang": "string", "modified": "timestamp", "churn": "int", "symbols": "string"},
}
VERSION = "1.0"
#: Columns of an intent file, and those it must have.
INTENTS = {"id": "string", "type": "string", "sev": "int", "status": "string", "scope": "string", "msg": "string", "created_by": "string", "tags": "string", "resolution": "string"}
REQUIRED = ["id", "type", "sev", "status", "msg"]


def _text(name: str, kind: str) -> Column:
    """A value as it is written: times in RFC 3339, confidences with two decimals, other numbers so that they read back the same."""
    c = F.col(name)
    if kind == "timestamp":
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if name == "confidence":
        return F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))
    return F.coalesce(c.cast("string"), F.lit({"int": "0", "double": "0", "boolean": "false"}.get(kind, "")))


def lines(parts: dict[str, DataFrame], document: str = "project") -> DataFrame:
    """``document, section, row, line``: state files as lines, from tables by section with its columns and ``document``.

    In the order of ``document, section, row`` they are the file: headings are rows "0", headers "1", records "2" and what
    identifies them. Every document has a state section; columns that a table lacks are empty, extra ones are ignored.
    """
    out = None
    for number, (name, columns) in enumerate(SECTIONS.items()):
        if name not in parts:
            continue
        df = parts[name]
        for c in columns:
            df = df if c in df.columns else df.withColumn(c, F.lit(None))
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in list(columns)[:3]]
        kept = df.select(document, F.lit(number).alias("section"), F.concat(F.lit("2"), F.concat_ws("\u0001", *keys)).alias("row"), record(*[_text(c, k) for c, k in columns.items()]).alias("line"))
        head = df.select(document).distinct().select(document, F.explode(F.array(F.struct(F.lit("0").alias("row"), F.lit(f"# {name}").alias("line")), F.struct(F.lit("1").alias("row"), F.lit("|".join(columns)).alias("line")))).alias("h"))
        both = kept.unionByName(head.select(document, F.lit(number).alias("section"), "h.row", "h.line"))
        out = both if out is None else out.unionByName(both)
    return out


def write(numbered: DataFrame, path: str, document: str = "project", compression: str = "gzip") -> None:
    """State files from :func:`lines`, a folder with one file for each document; one is written by one task, as it is one file."""
    ordered = numbered.repartition(document).sortWithinPartitions(document, "section", "row", "line")
    ordered.select(document, F.col("line").alias("value")).write.mode("overwrite").option("compression", compression).partitionBy(document).text(path)


def read(spark: SparkSession, path: str, document: str = "project") -> DataFrame:
    """``document, section, row, line``: the sections of state files as :func:`write` makes them; compression is told by the suffix."""
    texts = spark.read.text(path, wholetext=True).select(F.col(document).cast("string").alias("document"), F.col("value"))
    numbered = texts.select("document", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return sections(numbered).withColumnRenamed("document", document)


def table(found: DataFrame, section: str, document: str = "project") -> DataFrame:
    """``document`` and the section's columns with their types, found by the names of the section's header.

    Missing columns and bad texts are empty, 0, false or null (times); columns of other names are ignored.
    """
    own = found.filter(F.col("section") == section).select(document, "row", fields(F.col("line")).alias("f"))
    head = own.filter("row = 1").select(document, F.col("f").alias("h"))
    body = own.filter("row > 1").join(head, document)

    def value(name: str, kind: str) -> Column:
        at = F.array_position("h", F.lit(name))
        text = F.coalesce(F.when(at > 0, F.get("f", (at - 1).cast("int"))), F.lit(""))
        if kind == "string":
            return text
        if kind == "timestamp":
            return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
        none = F.lit({"int": 0, "double": 0.0, "boolean": False}[kind])
        return F.coalesce(text.try_cast(kind), none)

    return body.select(document, *[value(c, k).alias(c) for c, k in SECTIONS[section].items()])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def read_intents(spark: SparkSession, path: str, json: str | None = None) -> DataFrame:
    """Intents of a delimited file, else of a JSON file ``{"intents": [...]}``, else none; columns and types of :data:`INTENTS`.

    A delimited file without one of the required columns is an error. Its header is its first record, so that one task finds it.
    """
    if _exists(spark, path):
        kept = spark.read.text(path).withColumnRenamed("value", "line").filter("trim(line) <> '' AND NOT line LIKE '#%'")
        first = kept.select(fields(F.col("line"))).head()
        header = list(first[0]) if first else list(INTENTS)
        rows = parsed(kept.filter(F.array_join(fields(F.col("line")), "|") != "|".join(header)), list(INTENTS), header, REQUIRED)
        return rows.select(*[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) if k == "int" else F.col(c) for c, k in INTENTS.items()])
    if json and _exists(spark, json):
        item = "id STRING, type STRING, severity INT, status STRING, scope STRING, message STRING, created_by STRING, tags ARRAY<STRING>"
        rows = spark.read.schema(f"intents ARRAY<STRUCT<{item.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", "true").json(json).select(F.explode("intents").alias("i")).select("i.*")
        return rows.select("id", "type", F.col("severity").alias("sev"), "status", "scope", F.col("message").alias("msg"), "created_by", F.array_join("tags", ",").alias("tags"), F.lit("").alias("resolution"))
    return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in INTENTS.items()))
