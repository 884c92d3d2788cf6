import base64
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symbolarium.llm import bpe, encoding, packing, splitting

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(f"{bpe.FOLDER}/{bpe.BYTE_BPE}", "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoded(texts):
    e = bpe.Encoded(pa.array(texts, pa.string()), bpe.vocabulary())
    return [e.ids[a:b].tolist() for a, b in zip(e.offsets, e.offsets[1:])]


PIECES = ["'s", "'t", "'re", "'ll", "'", "r", "e", "l", " ", "  ", "\n", "\r\n", "\t", "1", "a", "B", "é", "中", "!", "?", "''", "'v", " ", " ", "<|endoftext|>", "😀", "́", "٠", "\x1c", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=6))
def test_same_ids_on_edges(reference, texts):
    assert encoded(texts) == [reference(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_on_any_text(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(texts) == [reference(t) for t in texts]


def test_long_slices(reference):
    rng = random.Random(1)
    texts = ["x" * 5000, " " * 5000, "ab" * 3000, "中文" * 2000, "".join(rng.choices("etaoins", k=5000)), "'s" * 500, "!?" * 2000]
    assert encoded(texts) == [reference(t) for t in texts]
    v = bpe.vocabulary()
    for n in (65, 100, 300):  # both ways of merging agree
        piece = "".join(rng.choices("etaoinsrh", k=n)).encode()
        parts = v._merged_long(piece)
        assert b"".join(v.tokens[i] for i in parts) == piece
        assert list(parts) == reference(piece.decode())


DOCS = "doc_id LONG, text STRING, ids STRING, n_tokens STRING"
TEXTS = [(1, "Hello world. It's fine"), (2, None), (3, ""), (4, "  \n"), (4, "again"), (None, "no id"), (6, "word " * 3000)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in rows], DOCS)


def test_encode_decode_counts(spark, reference):
    df = docs(spark)
    ids = sorted(((r.doc_id or 0, r.ids) for r in encoding.encode(df).collect()), key=str)
    assert ids == sorted(((i or 0, reference(t or "")) for i, t in TEXTS), key=str)
    assert sorted(r.n_tokens for r in encoding.token_counts(df).collect()) == sorted(len(reference(t or "")) for _, t in TEXTS)
    back = encoding.decode(encoding.encode(df.filter("doc_id <> 4")))
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in TEXTS if i and i != 4}
    assert encoding.encode(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id LONG, ids ARRAY<INT>")
    assert encoding.decode(nulls).head().text is None


def test_blocks_split_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aa", "b" * 50, None, "", "cc", "d"])], ["i", "t"])
    parts = list(encoding.blocks(iter([batch]), 1, 5))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) > 1
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))


def packed(spark, sizes, **more):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id LONG, n_tokens LONG, container STRING")
    return [r.asDict() for r in packing.pack(df, **more).collect()]


def test_containers_hold_everything_once(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 50, 99, 100, 101, 250, 300]) for _ in range(500)] + [None]
    rows = packed(spark, sizes, capacity=100, open_bins=8)
    spans = {}
    for r in rows:
        spans.setdefault(r["container"], []).append((r["place"], r["place"] + r["last"] - r["first"]))
    for s in spans.values():  # items lie side by side within the container
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    for i, size in enumerate(sizes):
        parts = sorted((r["part"], r["first"], r["last"]) for r in rows if r["doc_id"] == i)
        assert parts[0][1] == 0 and parts[-1][2] == (size or 0) and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
        assert (len(parts) > 1) == ((size or 0) > 100)
    used = sum(s or 0 for s in sizes)
    assert used / (len(spans) * 100) > 0.9


def test_packing_does_not_depend_on_input_order(spark):
    df = spark.createDataFrame([(i, i * 37 % 90) for i in range(200)], "doc_id LONG, n_tokens LONG")
    one = sorted(map(tuple, packing.pack(df.repartition(1), capacity=100, lanes=3).collect()))
    two = sorted(map(tuple, packing.pack(df.orderBy("n_tokens").repartition(7), capacity=100, lanes=3).collect()))
    assert one == two


def test_each_lane_is_a_task(spark):
    df = spark.createDataFrame([(i, 30) for i in range(600)], "doc_id LONG, n_tokens LONG")
    rows = packing.pack(df, capacity=100, lanes=12).select("lane", "lanes", "container", F.spark_partition_id().alias("task")).collect()
    assert len({r.lane for r in rows}) == len({r.task for r in rows}) == len({(r.lane, r.task) for r in rows}) == 12
    assert {r.lanes for r in rows} == {12} and all(r.container // packing.LANE == r.lane for r in rows)
    assert packing.lanes(df) == 1


def test_fullest_container_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(s)[0] for s in (6, 7, 9, 4, 3)] == [0, 1, 2, 0, 3]  # 9 closes container 1 (3 free), 4 fits container 0
    assert packing.OpenBins(10, 2).place(10) == (0, 0)


def test_packing_empty(spark):
    assert packed(spark, []) == []


def brute_cut(strength, n, limit, overlap):
    least, out, at = max(overlap + 1, limit // 2), [], 0
    while n - at > limit:
        window = range(at + least, at + limit + 1)
        end = max(window, key=lambda e: (strength[e - 1], e))
        out.append((at, end))
        at = end - overlap
    return [*out, (at, n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=5), st.sampled_from([(16, 3), (32, 0), (10, 9), (64, 40)]), st.integers(0, 99))
def test_cuts_same_as_search(sizes, shape, seed):
    import numpy as np

    limit, overlap = shape
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    strength = rng.integers(0, 7, int(offsets[-1])).astype(np.uint32)
    t, n, a, b = splitting.cut(strength, offsets, limit, overlap)
    for k, size in enumerate(sizes):
        own = [(int(x - offsets[k]), int(y - offsets[k])) for x, y in zip(a[t == k], b[t == k])]
        assert own == brute_cut(strength[offsets[k] : offsets[k + 1]], size, limit, overlap)


def test_pieces(spark, reference):
    text = "\n\n".join("A sentence here, with a clause. Another one! " * 6 for _ in range(40)) + "é中" * 900
    df = docs(spark, [(1, text), (2, None), (3, ""), (4, "short")])
    rows = [r.asDict() for r in splitting.split(df).collect()]
    own = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["piece"])
    ids, raw = reference(text), text.encode()
    assert own[0]["first"] == 0 and own[-1]["last"] == len(ids)
    assert all(r["last"] - r["first"] <= 512 for r in own) and all(a["last"] - b["first"] == 64 for a, b in zip(own, own[1:]))
    assert own[0]["text"].endswith("\n\n")
    joined = raw[: own[0]["last_byte"]] + b"".join(raw[a["last_byte"] : b["last_byte"]] for a, b in zip(own, own[1:]))
    assert joined == raw  # without the overlaps the pieces are the text
    assert all(raw[r["first_byte"] : r["last_byte"]].decode("utf-8", "ignore") == r["text"] for r in own)
    assert [(r["piece"], r["last"], r["text"]) for r in rows if r["doc_id"] in (2, 3)] == [(0, 0, "")] * 2
    assert splitting.split(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, limit=10, overlap=10)


def test_strengths():
    import numpy as np

    data = "a b, c. d\ne\n\nf。g".encode()
    ends = np.array([i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80])
    at = dict(zip(ends.tolist(), splitting.strengths(np.frombuffer(data, np.uint8), ends).tolist()))
    assert (at[1], at[4], at[7], at[10], at[13]) == (splitting.WORD, splitting.CLAUSE, splitting.SENTENCE, splitting.LINE, splitting.PARAGRAPH)
    assert at[data.index("g".encode())] == splitting.SENTENCE
    assert splitting.strengths(np.frombuffer("中".encode(), np.uint8), np.array([1]))[0] == splitting.WITHIN_CHARACTER
