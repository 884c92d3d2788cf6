"""Glob patterns as anchored regular expressions, built on the driver, matched inside Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(p: str) -> str:
    """Regex of one path segment: a star at its start matches a suffix, one at its end a prefix, others are literal."""
    if p == "*":
        return "[^/]*"
    if p.startswith("*"):
        return "[^/]*" + re.escape(p[1:])
    if p.endswith("*"):
        return re.escape(p[:-1]) + "[^/]*"
    return re.escape(p)


def path_pattern(pattern: str) -> str:
    """Regex of an include or exclude pattern.

    ``**`` stands for any number of whole segments. Without it a leading star matches any end of
    the path, a trailing star any beginning, other stars nothing but themselves.
    """
    if "**" not in pattern:
        if pattern.startswith("*"):
            return f"(?s)^.*{re.escape(pattern[1:])}$"
        if pattern.endswith("*"):
            return f"(?s)^{re.escape(pattern[:-1])}.*$"
        return f"^{re.escape(pattern)}$"
    out, segments = "", pattern.split("/")
    for k, p in enumerate(segments):
        last = k == len(segments) - 1
        if p != "**":
            out += _segment(p) + ("" if last else "/")
        elif not last:
            out += "(?:[^/]*/)*"
        else:  # at the end: nothing, or a slash and anything
            out = out[:-1] + "(?:/.*)?" if out.endswith("/") else out + ".*"
    return f"(?s)^(?:{out}|{re.escape(pattern)})$"


def shell_pattern(pattern: str) -> str:
    """Regex of a single-level glob: ``*``, ``?`` and ``[...]`` don't cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + body + "&&[^/]]" if not body.startswith("^") else "[" + body + "/]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def scope_pattern(pattern: str) -> str:
    """Regex of a graph scope: an exact path, a single-level glob, or everything below ``dir/**``."""
    pattern = pattern.strip().removeprefix("file:")
    if pattern.endswith("/**"):
        below = re.escape(pattern[:-3])
        return f"^{below}(?:/.*)?$"
    return shell_pattern(pattern)


def any_of(path: Column, patterns: Iterable[str]) -> Column:
    """Whether ``path`` matches one of the include or exclude patterns; false for none. Null paths give null."""
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(path_pattern(p))
    return found


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Included (by anything if there is no include pattern) and not excluded."""
    return (any_of(path, include) if include else F.lit(True)) & ~any_of(path, exclude)


def ignore_line(line: str, folder: str = "") -> str:
    """Exclude pattern of a line in an ignore file of ``folder`` ("" for the root); "" where it has none.

    Blank lines, comments and negations have none. A bare name matches at any depth; at the root
    a leading slash is dropped before that is decided, in a folder it anchors the name.
    """
    line = line.strip()
    if not line or line[0] in "#!":
        return ""
    is_dir = line.endswith("/")
    anchored = line.startswith("/")
    body = line.removeprefix("/")
    if not body:
        return ""
    body = body.removesuffix("/")
    if not body:
        return ""
    if not folder:
        body = body if "/" in body else "**/" + body
    elif anchored or "/" in body:
        body = f"{folder}/{body}"
    else:
        body = f"{folder}/**/{body}"
    return body + "/**" * is_dir
