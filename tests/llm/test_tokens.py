import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import blocks, bpe, token_files
from tests.llm import cases


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(bpe.tokenizer_path())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 100, 10**6])
def test_digests_equal_the_library(spark, plain, size):
    docs = cases.frame(spark)
    want = []
    for doc_id, text, *_ in cases.rows():
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.digests(docs, size=size).collect())


def test_encode_and_decode_round_trip(spark, plain):
    docs = cases.frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    encoded = bpe.encode(docs, size=50)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    for doc_id, text, *_ in cases.rows()[: len(cases.TEXTS)]:
        assert texts[doc_id] == plain.decode(plain.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_words_are_independent(text):
    t = Tokenizer.from_file(bpe.tokenizer_path()) if not hasattr(test_words_are_independent, "t") else test_words_are_independent.t
    test_words_are_independent.t = t
    words = getattr(test_words_are_independent, "w", None) or bpe.Words(bpe.tokenizer_path(), list, list.__add__)
    test_words_are_independent.w = words
    raw = text.encode("utf-8", "replace")
    assert [i for x in words(raw.split()) for i in x] == t.encode(raw.decode(), add_special_tokens=False).ids


def test_empty_tables(spark):
    assert bpe.digests(cases.empty(spark)).count() == 0
    assert token_files.read_ids(token_files.write_ids(cases.empty(spark))).count() == 0


def test_every_distinct_word_is_encoded_once(monkeypatch):
    """Three parts, many blocks: the tokenizer sees each word or part of a word once, wherever it stands."""
    seen = []
    whole, ids_of, probes = bpe.Words.whole, bpe.Words.ids_of, bpe.PROBES
    monkeypatch.setattr(bpe, "PROBES", ())
    monkeypatch.setattr(bpe.Words, "whole", lambda self, w: seen.append(w) or whole(self, w))
    monkeypatch.setattr(bpe.Words, "ids_of", lambda self, w: seen.append(w) or ids_of(self, w))
    assert probes
    texts = [(t or "").encode("utf-8", "replace") for t in cases.TEXTS] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)), pa.int64())], names=["text", "doc_id"])
    asked = [(p, k, x) for block in blocks.blocks(iter([batch]), ("doc_id",), 10) for p, k, x in bpe.ask(block, 3)]
    assert len({w for t in texts for w in t.split()}) > 20
    for part in range(3):
        seen.clear()
        rows = [blocks.batch_of([(part, 0, p, k, x)]) for p, k, x in asked if p == part and k == blocks.REQUEST]
        assert len(rows) > 3
        list(bpe.encoder(bpe.tokenizer_path())(iter(rows)))
        assert len(seen) == len(set(seen)) > 0


def test_a_long_text_is_joined_in_pieces(spark, plain):
    text = " ".join(f"w{i % 977}x" for i in range(600_000))
    got = bpe.digests(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    ids = plain.encode(text, add_special_tokens=False).ids
    assert sorted(r.n_tokens for r in got) == [0, len(ids), len(ids)]
    assert {r.ids_sha256 for r in got if r.doc_id == 1} == {sha(" ".join(map(str, ids)))}
    assert {r.decoded_sha256 for r in got if r.doc_id == 1} == {sha(plain.decode(ids, skip_special_tokens=False))}


def test_decode_of_awkward_ids(spark, plain):
    rows = [(1, [320, 49407]), (1, [320, 49407]), (2, []), (3, None), (None, [320, 10**6])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    both = plain.decode([320, 49407], skip_special_tokens=False)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, both), (1, both), (2, ""), (3, ""), (None, plain.decode([320]) + " ")]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=50), st.lists(st.booleans(), max_size=9))
def test_packing_round_trip(numbers, flags):
    arrays = [np.array(numbers, np.int64), np.array(flags), np.array(numbers, np.float64), np.array([], np.uint16), blocks.small(np.array(numbers, np.int64))]
    got = blocks.unpack(blocks.pack(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, got, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 49407), st.integers(0, 2**32 - 1)), max_size=1500))
def test_segment_gives_random_access(ids):
    segment = token_files.Segment(token_files.pack(np.array(ids, np.uint32)))
    assert segment.all().tolist() == ids
    assert [segment.at(i) for i in range(len(ids))] == ids


@pytest.mark.parametrize("each", [3, 2000])
def test_token_files(spark, plain, each):
    docs = cases.frame(spark)
    rows = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0]))
    want, at = [], 0
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.read_ids(token_files.write_ids(docs, each=each)).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_a_repeated_id_fills_several_ranges_in_order(spark, plain):
    texts = [f"word{i % 37} and more" for i in range(300)]
    rows = [(7, t) for t in texts] + [(i, "some text") for i in range(5)] + [(-(1 << 63), "least"), (None, "none"), ((1 << 63) - 1, "most")]
    bounds = np.array(token_files.ranges(spark.createDataFrame(rows, "doc_id long, text string"), 20))
    assert len({token_files.range_of(bounds, 7, zlib.crc32(t.encode())) for t in texts}) > 5
    got = sorted(token_files.read_ids(token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), each=20)).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    at = 0
    for r, (doc, text) in zip(got, order, strict=True):
        n = len(plain.encode(text, add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, n)
        at += n


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcXYZ'st.,!?;:*#$%&|<>0é \u0301\u0331\x1c\x85", max_size=30))
def test_parted_words(text):
    test_words_are_independent.hypothesis.inner_test(text)
