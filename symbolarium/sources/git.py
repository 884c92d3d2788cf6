"""Commits of a local repository as DataFrames, by the git command on the driver.

For the one repository an agent works in; the commits of many repositories come as tables.
"""

from __future__ import annotations

import re
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

_COMMITS = "hash STRING, message STRING, committed_at TIMESTAMP, author STRING"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def log(spark: SparkSession, root: str, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The newest commits, and ``hash, file`` of what each touched."""
    out = _git(root, "log", f"-{most}", "--name-only", "--format=%x01%H%x02%s%x02%ct%x02%an")
    commits, files = [], []
    for block in out.split("\x01")[1:]:
        head, *names = block.split("\n")
        hash_, message, at, author = head.split("\x02")
        commits.append((hash_, message, datetime.fromtimestamp(int(at), UTC), author))
        files += [(hash_, n) for n in names if n]
    return spark.createDataFrame(commits, _COMMITS), spark.createDataFrame(files, "hash STRING, file STRING")


def head(spark: SparkSession, root: str) -> DataFrame:
    """``hash, branch, dirty, user``: one row, or none outside a repository."""
    try:
        row = (
            _git(root, "rev-parse", "HEAD").strip(), _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip(),
            bool(_git(root, "status", "--porcelain").strip()), _git(root, "log", "-1", "--format=%an").strip(),
        )
    except (subprocess.CalledProcessError, FileNotFoundError):
        return spark.createDataFrame([], "hash STRING, branch STRING, dirty BOOLEAN, user STRING")
    return spark.createDataFrame([row], "hash STRING, branch STRING, dirty BOOLEAN, user STRING")


_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")


def hunks(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """``hash, ts, file, start, length, changed, is_new``: the changed stretches of the newest commits, by the file's new lines.

    ``changed`` is the number of lines added and removed, ``is_new`` true for files that the commit made.
    """
    rows: list[tuple] = []
    for block in _git(root, "log", f"-{most}", "-p", "--unified=0", "--no-renames", "--no-color", "--format=%x01%H%x02%ct%x02").split("\x01")[1:]:
        hash_, at, body = block.split("\x02", 2)
        for part in re.split(r"(?m)^diff --git ", body)[1:]:
            name = re.search(r"(?m)^\+\+\+ (?:b/)?(.*)$", part)
            pieces = _HUNK.split(part)  # what precedes, then start, length and lines of each hunk
            for start, length, text in zip(pieces[1::3], pieces[2::3], pieces[3::3]):
                changed = sum(line[:1] in ("+", "-") for line in text.split("\n")[1:])
                rows.append((hash_, int(at), name[1], int(start), int(length or 1), changed, "\nnew file mode" in part))
    return spark.createDataFrame(rows, "hash STRING, ts LONG, file STRING, start INT, length INT, changed INT, is_new BOOLEAN")
