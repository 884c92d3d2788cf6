"""Byte-level BPE over batches of texts: slices of the joined bytes, merged once each."""

from __future__ import annotations

import base64
import functools
import heapq
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from symbolarium.llm.pretokens import boundaries

#: Folder of the public vocabulary files where none is given.
FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Slices kept with their ids by each Python worker; when there are more, it begins anew.
CACHED = 1_000_000


class Vocabulary:
    """Tokens and their ranks; the rank is the id, and pairs of lower rank are merged first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token: the adjacent pair of lowest rank is joined, the leftmost first, until none is a token."""
        if len(piece) > 64:
            return self._merged_long(piece)
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == self.size:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], self.size)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], self.size)
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for long pre-tokens, in n log n: a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # where the part that begins at i ends; 0: i begins none
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of its parts has been joined to another since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            found = self.cache[piece] = self.merged(piece)
        return found

    def decode(self, ids) -> bytes:
        """The bytes of ids; exact for any text, as tokens cover it without gaps."""
        return b"".join([self.tokens[i] for i in ids])


@functools.cache
def vocabulary(name: str = BYTE_BPE, folder: str = FOLDER) -> Vocabulary:
    return Vocabulary(os.path.join(folder, name))


class Encoded:
    """Ids of a batch of texts, one behind the other.

    ``offsets``: where each text's ids begin, and the end of the last; ``ids``; ``ends()``: the
    byte in ``data`` at which each token ends. ``byte_offsets``: where each text's bytes begin.
    """

    def __init__(self, texts: pa.Array, vocab: Vocabulary, want_ids: bool = True):
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.byte_offsets = at - at[0]
        self.vocab = vocab
        if not len(self.data):
            self.offsets, self.ids = np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
            return
        if self.data.max() < 128:
            points, byte_of = self.data, None
        else:
            points = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            byte_of = np.flatnonzero((self.data & 0xC0) != 0x80)  # the byte at which each character begins
        filled = self.byte_offsets[:-1][np.diff(self.byte_offsets) > 0]
        starts = filled if byte_of is None else np.searchsorted(byte_of, filled)
        begins = np.flatnonzero(boundaries(points, starts))
        slices = np.append(begins if byte_of is None else byte_of[begins], len(self.data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(slices) - 1, [None, pa.py_buffer(slices), pa.py_buffer(np.ascontiguousarray(self.data))]).dictionary_encode()
        known = [vocab.ids(w) for w in words.dictionary.to_pylist()]
        length = np.fromiter(map(len, known), np.int64, len(known))
        which = words.indices.to_numpy()
        per_word = length[which]
        upto = np.zeros(len(which) + 1, np.int64)
        np.cumsum(per_word, out=upto[1:])
        self.offsets = upto[np.searchsorted(slices, self.byte_offsets)]
        if want_ids:
            flat = np.fromiter(chain.from_iterable(known), np.int32, int(length.sum()))
            first = np.zeros(len(known), np.int64)
            np.cumsum(length[:-1], out=first[1:])
            self.ids = flat[np.repeat(first[which] - upto[:-1], per_word) + np.arange(upto[-1])]

    def ends(self) -> np.ndarray:
        """Byte of ``data`` at which each token ends: tokens lie end to end, so lengths add up."""
        return np.cumsum(self.vocab.lengths[self.ids])
