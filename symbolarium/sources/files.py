"""Source trees, caches and stored objects as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.functions import globs, paths
from symbolarium.sources.languages import LANGUAGES, Language

#: Schema of extracted facts, as they are cached by file.
SIGNAL = (
    "type STRING, name STRING, file STRING, line INT, col INT, end_line INT, end_col INT, language STRING, metadata MAP<STRING,STRING>, confidence DOUBLE"
)
CONFIG = (
    "version STRING, project_name STRING, description STRING, commands MAP<STRING,STRING>, instructions STRING, "
    "guardrails ARRAY<STRUCT<id:STRING,paths:ARRAY<STRING>,require_all:BOOLEAN,action:STRING,reason:STRING>>, include ARRAY<STRING>, exclude ARRAY<STRING>"
)


def tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """``path`` (relative), ``mtime, length, content``: files below ``root`` that are included and not excluded.

    The patterns are compared with paths only; Spark reads a file's content where a query needs it
    and the path has passed. Files and folders whose names begin with a dot or underscore are left out, as by all of Spark's readers.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = found.select(F.regexp_replace("path", "^file:/*", "/").alias("p"), F.col("modificationTime").alias("mtime"), "length", "content")
    prefix = root.rstrip("/").removeprefix("file://") + "/"
    relative = base.select(F.substring("p", len(prefix) + 1, 2**31 - 1).alias("path"), "mtime", "length", "content")
    return relative.filter(globs.selected(F.col("path"), list(include), list(exclude)))


def code_files(files: DataFrame, languages: list[Language] = LANGUAGES) -> DataFrame:
    """Files with an extension of one of the languages."""
    return files.filter(paths.extension(F.col("path")).isin(*[e for x in languages for e in x.extensions]))


def ignore_patterns(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """Exclude patterns of all ignore files below ``root``; these are few and small, so the driver reads them.

    Spark's readers skip files whose names begin with a dot, so they are listed and read through the file system.
    """
    jvm = spark._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(start).toString().rstrip("/") + "/"
    patterns, listing = [], fs.listFiles(start, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if path.getName() == name:
            folder = path.toString().removeprefix(base)[: -len(name)].rstrip("/")
            stream = fs.open(path)
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            patterns += [p for line in text.splitlines() if (p := globs.ignore_line(line, folder))]
    return sorted(set(patterns))


def with_hash(files: DataFrame) -> DataFrame:
    """``files`` with the SHA-256 of their content."""
    return files.withColumn("content_hash", F.sha2("content", 256))


def signals(spark: SparkSession, path: str) -> DataFrame:
    """Cached facts, JSON lines, gzip by suffix; what doesn't parse is left out."""
    return spark.read.schema(SIGNAL).option("mode", "DROPMALFORMED").json(path)


def config(spark: SparkSession, path: str) -> DataFrame:
    """A configuration; instructions may be texts or objects and come out as ``ARRAY<STRUCT<rule, scope>>``."""
    raw = spark.read.schema(CONFIG).option("multiLine", "true").json(path)
    items = F.from_json("instructions", "array<string>")
    one = F.transform(items, lambda s: F.coalesce(F.from_json(F.when(s.startswith("{"), s), "rule STRING, scope STRING"), F.struct(s.alias("rule"), F.lit("").alias("scope"))))
    return raw.withColumn("instructions", one)


def chosen_sections(config_: DataFrame, sections: list[str]) -> DataFrame:
    """``section, value`` (JSON; null for none): the named parts of a configuration in the order asked for, all for none; an unknown name is an error."""
    unknown = [s for s in sections if s not in config_.columns]
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    names = list(sections) or config_.columns
    kinds = dict(config_.dtypes)
    value = [F.col(c) if kinds[c] == "string" else F.to_json(c) for c in names]
    rows = F.posexplode(F.array(*[F.struct(F.lit(c).alias("section"), v.alias("value")) for c, v in zip(names, value)])).alias("place", "x")
    return config_.select(rows).select("place", "x.section", "x.value")


def objects(spark: SparkSession, root: str) -> DataFrame:
    """``hash, is_delta, mtime``: stored snapshots, two characters of the hash as a folder, the rest as name. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("mtime"))
    at = r"/([0-9a-f]{2})/([0-9a-f]+)\.(json|delta)$"
    parts = [F.regexp_extract("path", at, k) for k in (1, 2, 3)]
    return found.select(F.concat(parts[0], parts[1]).alias("hash"), (parts[2] == "delta").alias("is_delta"), "mtime").filter("hash <> ''")


def write_object(state: DataFrame, root: str, hash_: str) -> bool:
    """Store a snapshot under its hash unless it is there; whether it was written."""
    spark = state.sparkSession
    target = f"{root}/{hash_[:2]}/{hash_[2:]}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    state.write.parquet(target)
    return True


def module_name(content: Column, path: Column) -> Column:
    """Module that a project's manifest names, by the manifest's file name; null for other files."""
    name = paths.base(path)
    return (
        F.when(name == "go.mod", F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1))
        .when(name == "package.json", F.get_json_object(content, "$.name"))
        .when(name == "Cargo.toml", F.regexp_extract(content, r'(?m)^name\s*=\s*"([^"]+)"', 1))
    )
