"""Encoding of a corpus with a public byte-level tokenizer, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm import bpe

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BATCH_BYTES = 4_000_000


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = bpe.BYTE_BPE, folder: str = bpe.FOLDER) -> DataFrame:
    """``<id_col>, ids ARRAY<INT>``: ids of each text, without special tokens; a null or empty text has an empty list.

    No shuffle: each task encodes its own rows. Ids of rows may repeat or be null; other columns
    are ignored, whatever their names are. Texts of special tokens are ordinary text.
    """
    out = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(vocab, folder)
        for block in blocks(batches, 1):
            e = bpe.Encoded(block.column(1), words)
            ids = pa.ListArray.from_arrays(pa.array(e.offsets, pa.int32()), pa.array(e.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), ids], [id_col, "ids"])

    return out.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = bpe.BYTE_BPE, folder: str = bpe.FOLDER) -> DataFrame:
    """``<id_col>, n_tokens BIGINT``: the length of :func:`encode`'s lists, without building them."""
    out = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(vocab, folder)
        for block in blocks(batches, 1):
            e = bpe.Encoded(block.column(1), words, want_ids=False)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(e.offsets))], [id_col, "n_tokens"])

    return out.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str = bpe.BYTE_BPE, folder: str = bpe.FOLDER) -> DataFrame:
    """``<id_col>, text``: the text of each list of ids; null lists give null, empty ones the empty text.

    Bytes that form no character (as when a list was cut within one) become U+FFFD.
    """
    out = df.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.vocabulary(vocab, folder)
        for batch in batches:
            texts = [None if x is None else words.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return out.mapInArrow(run, f"`{id_col}` {kind}, text string")
