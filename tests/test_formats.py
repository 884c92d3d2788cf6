from datetime import datetime

from pyspark.sql import functions as F

from symbolarium.operators import reports
from symbolarium.sources import delimited
from symbolarium.streaming import deliveries

VALUES = ["", "a|b", "a\\nb", "a\nb", "\\", "\\|", "tail\\\\", "é中", "||", "x\\\\|y"]


def test_records_roundtrip(spark):
    df = spark.createDataFrame([(str(i), v, VALUES[-i]) for i, v in enumerate(VALUES)], "id STRING, a STRING, b STRING")
    lines = df.select(delimited.record("id", "a", "b").alias("line"))
    assert not any("\n" in r.line for r in lines.collect())
    assert sorted(map(tuple, delimited.parsed(lines, ["id", "a", "b"]).collect())) == sorted(map(tuple, df.collect()))


def test_headers(spark):
    lines = spark.createDataFrame([("1|x|y",), ("# note",), ("  ",), ("2|z",)], "line STRING")
    assert sorted(map(tuple, delimited.parsed(lines, ["b", "id", "none"], ["id", "b", "c"]).collect())) == [("x", "1", ""), ("z", "2", "")]
    try:
        delimited.parsed(lines, ["id"], ["b"], required=["id"])
        raise AssertionError("no error")
    except ValueError as e:
        assert "id" in str(e)


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"v|{i}\n") for i in range(100)], "id STRING, v STRING").repartition(3)
    delimited.write(df, str(tmp_path / "t"), ["id", "v"])
    back = delimited.read(spark, str(tmp_path / "t"), ["id", "v"])
    assert sorted(map(tuple, back.select("id", "v").collect())) == sorted((str(i), f"v|{i}\n") for i in range(100))


def test_sections(spark):
    rows = [("d", i, x) for i, x in enumerate(["# state", "a|b", "", "# symbols", "file|name", "f|n", "# todos"])]
    got = delimited.sections(spark.createDataFrame(rows, "document STRING, line_no INT, line STRING"))
    assert sorted(map(tuple, got.collect())) == [("d", "state", 1, "a|b"), ("d", "symbols", 1, "file|name"), ("d", "symbols", 2, "f|n")]


def test_export_hash(spark):
    symbols = spark.createDataFrame([("p", "f", "n", "unstable", 1, "function"), ("p", "f", "m", "active", 2, "function"), ("p", "f", "x", None, 2, None)], "project STRING, file STRING, name STRING, state STRING, line INT, type STRING")
    todos = spark.createDataFrame([("p", "f", 1, "do", "TODO", False), ("p", "f", 2, "done", "TODO", True)], "project STRING, file STRING, line INT, text STRING, type STRING, resolved BOOLEAN")
    intents = spark.createDataFrame([("p", "i", "todo", 2, "say|it", "active"), ("p", "j", "todo", 2, "no", "closed")], "project STRING, id STRING, type STRING, severity INT, message STRING, status STRING")
    text = delimited.context_text(delimited.export_lines(symbols, todos, intents))
    body = text.head().text
    assert body.startswith("# intents\ni|todo|2|say\\|it\n# unstable\nf|n|1|function\n# active\n") and "done" not in body and "closed" not in body
    tampered = text.select("project", F.replace("text", F.lit("unstable"), F.lit("stable")).alias("text"))
    cut = text.select("project", F.lit("# intents\n").alias("text"))
    assert [delimited.verified(x).head().valid for x in (text, tampered, cut)] == [True, False, False]


def test_health_bands(spark):
    df = spark.createDataFrame([("a", 10, 8), ("b", 10, 6), ("c", 3, 1), ("d", 0, 0)], "project STRING, symbols LONG, active LONG")
    assert {r.project: (r.score, r.band, len(r.bar)) for r in reports.health(df).collect()} == {"a": (80, "good", 20), "b": (60, "fair", 20), "c": (33, "poor", 20), "d": (0, "poor", 20)}


def test_views(spark):
    df = spark.createDataFrame([("Fix cache", "a.go", "active", 3, "fixme"), (None, None, None, None, None), ("x", "y", "closed", 1, "todo")], "message STRING, scope STRING, status STRING, severity INT, type STRING")
    assert reports.intent_view(df, "open").count() == 2
    assert reports.intent_view(df, severities=[]).count() == 0
    assert reports.intent_view(df, query="CACHE").count() == 1
    assert [r.type for r in df.orderBy(reports.type_rank(F.col("type"))).collect()][:2] == ["fixme", "todo"]


def test_first_with_remainder(spark):
    df = spark.createDataFrame([("f", i) for i in range(5)] + [("g", 1)], "file STRING, line INT")
    got = reports.first_with_remainder(df, ["file"], [F.col("line")], 3)
    assert sorted((r.file, r.place, r.more) for r in got.collect()) == [("f", 1, 2), ("f", 2, 2), ("f", 3, 2), ("g", 1, 0)]


def test_streams(spark, tmp_path):
    schema = "k STRING, v INT, at TIMESTAMP"
    source = str(tmp_path / "in")
    for n, rows in enumerate([[("a", 1, datetime(2025, 1, 1)), ("b", 1, datetime(2025, 1, 2))], [("a", 2, datetime(2025, 1, 3)), ("b", 0, datetime(2024, 1, 1))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = deliveries.keep_current(deliveries.stream(spark, source, schema), ["k"], "at", str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination()
        assert query.exception() is None
    assert sorted((r.k, r.v) for r in deliveries.current_table(spark, str(tmp_path / "out")).collect()) == [("a", 2), ("b", 1)]
    counted = deliveries.windowed(deliveries.stream(spark, source, schema), "at", ["k"], late="1000 days")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect() == [("a", 2), ("b", 2)]
    for f in (deliveries.sessions, lambda r, t, k: deliveries.once(r, t, k)):
        q = f(deliveries.stream(spark, source, schema), "at", ["k"]).writeStream.outputMode("append").format("memory").queryName("s").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    schema, source, state = "k STRING, at TIMESTAMP", str(tmp_path / "in"), str(tmp_path / "ck")
    seen = {}

    def keep(batch, number):
        seen.update({(r.k, r.start): r.n for r in batch.collect()})

    for rows in ([("a", datetime(2025, 1, 10))], [("a", datetime(2025, 1, 9)), ("a", datetime(2025, 1, 2)), ("a", datetime(2025, 1, 12))], [("a", datetime(2025, 1, 3))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        counted = deliveries.windowed(deliveries.stream(spark, source, schema), "at", ["k"], "1 day", "3 days")
        q = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    assert {s.day: n for (_, s), n in seen.items()} == {10: 1, 9: 1, 12: 1}  # days 2 and 3 came too late


def test_git(spark, tmp_path):
    import subprocess

    from symbolarium.sources import git

    root = tmp_path / "work"
    root.mkdir()
    me = ["-c", "user.name=me", "-c", "user.email=me@here", "-c", "commit.gpgsign=false"]

    def run(*args):
        subprocess.run(["git", "-C", str(root), *me, *args], check=True, capture_output=True)

    run("init", "-q", "-b", "trunk")
    for k, name in enumerate("abbc"):
        (root / f"{name}.txt").write_text(str(k))
        run("add", "-A")
        run("commit", "-q", "-m", f"change | {k}")
    commits, files = git.log(spark, str(root), 3)
    assert sorted(r.message for r in commits.collect()) == ["change | 1", "change | 2", "change | 3"]
    assert sorted(r.file for r in files.collect()) == ["b.txt", "b.txt", "c.txt"]
    at = git.head(spark, str(root)).head()
    assert (at.branch, at.dirty, at.user, len(at.hash)) == ("trunk", False, "me", 40)
    (root / "a.txt").write_text("other")
    assert git.head(spark, str(root)).head().dirty
    assert git.head(spark, str(tmp_path / "nowhere")).count() == 0


def test_intents(spark):
    from symbolarium.operators import intents

    schema = "project STRING, id STRING, type STRING, severity INT, status STRING, scope STRING, message STRING, tags ARRAY<STRING>, updated_at TIMESTAMP_NTZ, resolution STRUCT<method:STRING,description:STRING,resolved_at:TIMESTAMP_NTZ,resolved_by:STRING>"
    df = spark.createDataFrame([("p", "i", "todo", 2, "active", "project", "a|b", ["x", "y"], datetime(2025, 1, 1), None), ("p", "j", None, None, None, None, None, None, None, None)], schema)
    assert intents.added(df, df.filter("id = 'i'").drop("tags")).count() == 3
    done = intents.ended(df, "i", "resolved", {"method": "fixed", "description": "d", "by": "me"}, F.lit(datetime(2025, 2, 1)))
    row = done.filter("id = 'i'").head()
    assert (row.status, row.resolution.method, row.updated_at) == ("resolved", "fixed", datetime(2025, 2, 1))
    assert done.filter("id = 'j'").head().status is None
    lines = sorted(r.line for r in intents.records(done).collect())
    assert lines == ["i|todo|2|resolved|project|a\\|b|x,y|fixed:d:1738368000:me", "j|||||||"]
    back = spark.createDataFrame([("fixed:d:1738368000:me",), ("",), ("a:b",)], "r STRING").select(intents.unpacked_resolution(F.col("r")).alias("u")).collect()
    assert [None if r.u is None else (r.u.method, r.u.seconds, r.u.resolved_by) for r in back] == [("fixed", 1738368000, "me"), None, None]
    try:
        intents.ended(df, "zzz", "closed", {}, F.lit(datetime(2025, 2, 1)))
        raise AssertionError("no error")
    except LookupError:
        pass
    rules = spark.createDataFrame([("r", None)], "rule STRING, scope STRING")
    assert intents.appended(rules, spark.createDataFrame([("r", None), ("s", "x"), ("s", "x")], "rule STRING, scope STRING"), ["rule", "scope"]).count() == 2
