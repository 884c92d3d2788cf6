"""Cutting oversized texts at natural boundaries: range maxima over the strength of each cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm import bpe
from symbolarium.llm.encoding import blocks

LIMIT = 512
OVERLAP = 64

# Strength of a cut, by what it separates.
WITHIN_CHARACTER, TOKEN, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)


def strengths(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the cut at each byte of ``ends`` (above 0 and up to the length of ``data``)."""
    padded = np.concatenate([np.full(4, 32, np.uint8), data, np.full(1, 32, np.uint8)])
    at = ends + 4
    after, last, last2, last3, last4 = padded[at], padded[at - 1], padded[at - 2], padded[at - 3], padded[at - 4]
    new, ret = ord("\n"), ord("\r")

    def white(c: np.ndarray) -> np.ndarray:
        return (c == 32) | ((c >= 9) & (c <= 13))

    def any_of(c: np.ndarray, text: str) -> np.ndarray:
        return np.isin(c, np.frombuffer(text.encode("ascii"), np.uint8))

    out = np.where((after & 0xC0) == 0x80, WITHIN_CHARACTER, TOKEN).astype(np.uint32)
    out[white(after) | white(last)] = WORD
    spaced = white(after)
    out[spaced & any_of(last, ",;:")] = CLAUSE
    closed = any_of(last, "\"')]") & any_of(last2, ".!?")
    # the ideographic full stop, and the full-width exclamation and question marks, need no space
    wide = (last3 == 0xE3) & (last2 == 0x80) & (last == 0x82) | (last3 == 0xEF) & (last2 == 0xBC) & ((last == 0x81) | (last == 0x9F))
    out[spaced & (any_of(last, ".!?") | closed) | wide] = SENTENCE
    line = (last == new) | (last == ret) & (after != new)
    out[line] = LINE
    out[(last == new) & ((last2 == new) | (last2 == ret) & (last3 == new)) | (last == ret) & (after != new) & (last2 == ret)] = PARAGRAPH
    return out


class RangeMaximum:
    """Sparse table: row ``k`` holds the greatest of each ``2**k`` neighbours, so two of them cover any range."""

    def __init__(self, values: np.ndarray, widest: int):
        self.rows = [values]
        reach = 1
        while 2 * reach <= widest:
            below = self.rows[-1]
            row = below.copy()
            np.maximum(below[:-reach], below[reach:], out=row[:-reach])
            self.rows.append(row)
            reach *= 2

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Greatest value of ``first..last`` (inclusive, all ranges of one length)."""
        k = int(last[0] - first[0] + 1).bit_length() - 1
        row = self.rows[k]
        return np.maximum(row[first], row[last - (1 << k) + 1])


def cut(strength: np.ndarray, offsets: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, first and last (exclusive) token of each piece, counted over all texts' tokens.

    ``strength[t]``: that of the cut behind token ``t``; ``offsets``: the texts' first tokens.
    A piece has at least half of ``limit`` and more than ``overlap`` tokens; of the permitted cuts
    the strongest is taken, of equal ones the rightmost.
    """
    least = max(overlap + 1, limit // 2)
    begin, end = offsets[:-1], offsets[1:]
    text = np.arange(len(begin))
    number, at = np.zeros(len(begin), np.int64), begin.copy()
    # strength above position: the greatest key is the strongest cut, the rightmost of equal ones
    bits = max(1, len(strength)).bit_length()
    table = RangeMaximum((strength.astype(np.int64) << bits) | np.arange(len(strength)), limit - least + 1)
    out = [(text[:0], number[:0], at[:0], at[:0])]
    while len(text):
        rest = end[text] - at
        done = rest <= limit
        out.append((text[done], number[done], at[done], end[text][done]))
        text, number, at = text[~done], number[~done], at[~done]
        if len(text):
            best = table.query(at + least - 1, at + limit - 1) & ((1 << bits) - 1)
            out.append((text, number, at, best + 1))
            at, number = best + 1 - overlap, number + 1
    t, n, a, b = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((n, t))
    return t[order], n[order], a[order], b[order]


def split(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    vocab: str = bpe.BYTE_BPE,
    folder: str = bpe.FOLDER,
    with_text: bool = True,
) -> DataFrame:
    """``<id_col>, piece, first, last, first_byte, last_byte[, text]``: pieces of at most ``limit`` tokens.

    Pieces count from 0; a text within the limit is one piece, also an empty or null one (of no
    tokens). ``first`` to ``last`` (exclusive) are tokens of the text's encoding, the bytes are
    those of its UTF-8 form. Consecutive pieces share exactly ``overlap`` tokens. A piece ends at
    the strongest cut in reach: behind a paragraph, line, sentence, clause or word, else between
    characters, and within one only where nothing else is in reach. ``text`` leaves out the parts
    of a character that an overlap cuts. No shuffle; a text of any length is cut by one task.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "piece", "first", "last", "first_byte", "last_byte"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(vocab, folder)
        for block in blocks(batches, 1):
            e = bpe.Encoded(block.column(1), words)
            ends = e.ends()
            strength = strengths(e.data, ends)
            last = e.offsets[1:][np.diff(e.offsets) > 0] - 1
            strength[last] = PARAGRAPH  # what follows is another text
            text, number, a, b = cut(strength, e.offsets, limit, overlap)
            bounds = np.concatenate([np.zeros(1, np.int64), ends])
            base = e.byte_offsets[text]
            columns = [block.column(0).take(pa.array(text)), pa.array(number), pa.array(a - e.offsets[text]), pa.array(b - e.offsets[text])]
            columns += [pa.array(bounds[a] - base), pa.array(bounds[b] - base)]
            if with_text:
                raw = e.data.tobytes()
                columns.append(pa.array([raw[i:j].decode("utf-8", "ignore") for i, j in zip(bounds[a].tolist(), bounds[b].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, piece long, first long, last long, first_byte long, last_byte long" + ", text string" * with_text
    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)
