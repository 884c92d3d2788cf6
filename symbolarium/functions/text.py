"""Text functions as Column builders: tokens, stems, escapes, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without topical meaning.
STOPWORDS = (
    "a an the to of in on at for and or with from by we our us it its this that is are be as do does "
    "if then so will can could should have has had not no but"
).split()


def _cut(c: Column, k: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - k)


def _singular(t: Column) -> Column:
    return (
        F.when(F.length(t) <= 3, t)
        .when(t.endswith("ies") & (F.length(t) > 4), F.concat(_cut(t, 3), F.lit("y")))
        .when(t.endswith("sses"), _cut(t, 2))
        .when(t.endswith("ss") | t.endswith("us") | t.endswith("is"), t)
        .when(t.endswith("es"), _cut(t, 2))
        .when(t.endswith("s"), _cut(t, 1))
        .otherwise(t)
    )


def _uninflected(t: Column) -> Column:
    short = F.when(t.endswith("ing") & (F.length(t) > 5), _cut(t, 3))
    return short.when((t.endswith("ed") | t.endswith("ly")) & (F.length(t) > 4), _cut(t, 2)).otherwise(t)


def _without_e(t: Column) -> Column:
    return F.when(t.endswith("e") & (F.length(t) > 3) & ~t.endswith("ee") & ~t.endswith("ie"), _cut(t, 1)).otherwise(t)


def stemmed(df, word: str, name: str = "term"):
    """``df`` with the stem of a word: suffixes off in three steps: plural; then -ing, -ed or -ly; then a final e.

    Words of up to three letters stay. Each step is a projection of its own, as every step reads
    its input several times: nested in one expression they would grow as a product.
    """
    one = df.withColumn("__s1", _singular(F.col(word)))
    two = one.withColumn("__s2", F.when(F.length(word) <= 3, F.col(word)).otherwise(_uninflected(F.col("__s1"))))
    return two.withColumn(name, F.when(F.length(word) <= 3, F.col(word)).otherwise(_without_e(F.col("__s2")))).drop("__s1", "__s2")


def words(text: Column) -> Column:
    """Lower-case words of two letters and digits or more, without stopwords, in order, repeats kept. Null gives none."""
    raw = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(raw, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def terms(df, text: str, *keep: str):
    """``keep..., term``: a row for each word of ``text``, stemmed after the explode, where the JVM compiles it."""
    return stemmed(df.select(*keep, F.explode(words(F.col(text))).alias("__w")), "__w").select(*keep, "term")


def candidate_text(message: Column, tags: Column) -> Column:
    """The message and each tag twice, so that tags weigh more."""
    twice = F.flatten(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.array(t, t)))
    return F.concat_ws(" ", F.coalesce(message, F.lit("")), F.array_join(twice, " "))


def escape(c: Column) -> Column:
    """A field of the delimited format: backslash, then newline, then the bar. Null becomes empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\|"))


def unescape(c: Column) -> Column:
    """Reverse of :func:`escape` in one pass over pairs of a backslash and what follows it; other pairs stay."""
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)(\\.?|[^\\]+)"), F.lit(1))
    plain = F.transform(tokens, lambda t: F.when(t == "\\n", "\n").when(t == "\\|", "|").when(t == "\\\\", "\\").otherwise(t))
    return F.array_join(plain, "")


def one_line(message: Column, most: int | None = None) -> Column:
    """A commit message for a delimited report: bars become slashes, line ends spaces; cut to ``most`` characters."""
    flat = F.translate(message, "|\n", "/ ")
    return flat if most is None else F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def age_text(then: Column, now: Column) -> Column:
    """How long ago, in words; seconds since 1970 on both sides. Null stays null."""
    s = (now - then).cast("long")

    def ago(seconds: int, unit: str) -> Column:
        return F.concat(F.floor(s / seconds).cast("string"), F.lit(f" {unit} ago"))

    day = 86400
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, ago(60, "minutes"))
        .when(s < day, ago(3600, "hours"))
        .when(s < 7 * day, ago(day, "days"))
        .when(s < 30 * day, ago(7 * day, "weeks"))
        .otherwise(ago(30 * day, "months"))
    )


#: Words by which todos are classed, in the order they are looked for.
TODO_CLASSES = {"FIX": ["FIXME", "FIX", "BUG", "HACK"], "TODO": ["TODO", "TBD"], "NOTE": ["NOTE", "INFO"]}


def todo_class(kind: Column, text: Column) -> Column:
    """FIX, TODO or NOTE: by the type if it is one of their words, else by the first of them in the text, else TODO."""
    k, t = F.upper(F.trim(F.coalesce(kind, F.lit("")))), F.upper(F.coalesce(text, F.lit("")))
    by_type, by_text = F.lit(None).cast("string"), F.lit("TODO")
    for name, found in reversed(TODO_CLASSES.items()):
        by_type = F.when(k.isin(*found), name).otherwise(by_type)
        by_text = F.when(t.rlike("|".join(found)), name).otherwise(by_text)
    return F.coalesce(by_type, by_text)


def without_comment_marks(text: Column) -> Column:
    """Comment marks off the start, one of each kind at most, in a fixed order."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    for mark in ("//", "#", "/\\*", "\\*/", "\\*"):
        t = F.regexp_replace(t, f"^{mark}\\s*", "")
    return t


def is_commit_hash(c: Column) -> Column:
    """Whether a text is a full commit hash: 40 hexadecimal digits in lower case. Null stays null."""
    return c.rlike("^[0-9a-f]{40}$")


def counted_fields(text: Column) -> Column:
    """How many non-empty parts spaces, line ends and bars separate; another rough count of tokens."""
    return F.size(F.filter(F.split(text, "[ \t\r\n|]+"), lambda w: w != ""))


def estimated_tokens(text: Column) -> Column:
    """A rough count: a quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4)
