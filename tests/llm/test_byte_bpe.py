"""Byte-level BPE by tree against the library that defines its ids, in any bracketing, and as a round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm.byte_bpe import ByteBpe, decode, encode, fold

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = ByteBpe.from_file(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
#: Leaves so small that most joins meet a piece, a contraction or white space in two; tables so small that they turn over.
SMALL = [ByteBpe(CODEC.ranks, PATTERN, leaf_chars=a, leaf_bytes=b, cache=40) for a, b in ((1, 1), (2, 3), (5, 2), (13, 8))]
texts = st.text(st.sampled_from([*"aabbcc'strevmldST  \n\t\r12.!-é日本ß\U0001f600\x1c\x85 ́٠"]), max_size=80)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), codec.dtype).tolist()


@settings(max_examples=400, deadline=None)
@given(texts, st.text(max_size=30), st.sampled_from(["", " ", "a", "'", "ab"]), st.integers(0, 90))
def test_trees_equal_the_library(text, other, unit, times):
    text = text + other.encode("utf-8", "replace").decode() + unit * times
    want = LIBRARY.encode_ordinary(text)
    assert all(ids(c, text) == want for c in (CODEC, *SMALL))


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=5), st.integers(0, 4))
def test_the_product_is_associative(stretches, at):
    codec, want = SMALL[0], ids(CODEC, "".join(stretches))
    assert np.frombuffer(fold(codec, stretches), codec.dtype).tolist() == want
    left, right = [], []
    for part, held in ((stretches[:at], left), (stretches[at:], right)):
        e = ([], [])
        for s in reversed(part):  # from right to left
            e = codec.product(codec.leaf(s), e)
        held.append(e)
    assert np.frombuffer(b"".join(codec.product(left[0], right[0])[1]), codec.dtype).tolist() == want


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "'s", " " * 4097 + "x", "\n" * 999 + "a", "日" * 2000, "x" * 3001 + " y", "he'll " * 3000])
def test_long_pieces(text):
    assert all(ids(c, text) == LIBRARY.encode_ordinary(text) for c in (CODEC, SMALL[3]))


def test_a_token_that_merges_do_not_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257}
    codec, library = ByteBpe(ranks, PATTERN, leaf_chars=2, leaf_bytes=1), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ranks_far = {bytes([b]): b for b in range(256)} | {b"abcd": 256, b"cd": 257}
    far, library_far = ByteBpe(ranks_far, PATTERN, leaf_bytes=1), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_far, special_tokens={})
    for text in ("abc", "xabc", "abcabc", "abcd", "abcdabcd", "abcd abcd", "cdcd"):
        assert ids(codec, text) == library.encode_ordinary(text)
        assert ids(far, text) == library_far.encode_ordinary(text)


def test_frames_of_messy_rows(spark):
    rows = [(1, "Hello, wörld's  end\n"), (1, "Hello, wörld's  end\n"), (2, None), (3, ""), (None, "x"), (4, "a" * 70_000 + " b" * 70_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, ids string")
    found = decode(encode(docs, PATH, PATTERN), PATH, PATTERN)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found.collect()), key=str)
    assert got == sorted(((i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [72])], "doc_id long, ids array<int>")
    assert [r.decoded for r in decode(nothing, PATH, PATTERN).orderBy("doc_id").collect()] == [None, b"", LIBRARY.decode_bytes([72])]
    with pytest.raises(Exception, match="no token"):
        decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), PATH, PATTERN).collect()


def test_bytes_that_are_no_text(spark):
    found = encode(spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text"), PATH, PATTERN).first()
    assert list(found.ids) == LIBRARY.encode_ordinary("a�b")


def test_query_equals_the_library(spark):
    from docketry.llm.queries import op13_byte_bpe

    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        i = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(i), sha(",".join(map(str, i)).encode()), sha((r.text or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_byte_bpe(spark, sf).collect()} == want
