"""Periodic runs against a brute force over all periods and places."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import periodic
from docketry.llm.periodic import find, kept, numbers, runs


def brute(words, least=24, times=3):
    """All runs as (start, length, period): every period, every maximal stretch, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // times + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = 0
        for i, x in enumerate(same):
            if not x:
                if i > start and i + q - start >= max(least, times * q):
                    found.setdefault((start, i + q - start), q)
                start = i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


stretches = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 9), st.integers(0, 13)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(stretches, st.sampled_from([1, 7, 100, 1 << 20]))
def test_find_equals_brute_force(parts, pairs):
    words = [w for unit, times, more in parts for w in unit * times + unit[:more]][:200]
    assert [tuple(r) for r in find(np.array(words, np.int64), pairs=pairs).tolist()] == brute(words)


@pytest.mark.parametrize("least,times", [(6, 2), (10, 4), (24, 3)])
def test_other_limits(least, times):
    rng = np.random.default_rng(5)
    for _ in range(60):
        words = np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 7)), rng.integers(1, 6)) for _ in range(5)])
        assert [tuple(r) for r in find(words, least, times).tolist()] == brute(words.tolist(), least, times)


def test_stretches_are_compared_word_by_word(monkeypatch):
    """With extensions that claim too much, as if all hashes agreed, the result is the same."""
    words = np.array([*range(40), *([1, 2, 3] * 9), *range(50, 90), *([7] * 30)])
    want = find(words).tolist()
    monkeypatch.setattr(periodic, "_extensions", lambda prefix, power, a, q, room, forward: room)
    assert find(words).tolist() == want == [[40, 27, 3], [107, 30, 1]]


def test_long_texts():
    one, thue = np.zeros(60_000, np.int64), np.array([bin(i).count("1") & 1 for i in range(1 << 14)])
    assert find(one).tolist() == [[0, 60_000, 1]]
    assert find(thue).tolist() == []  # no stretch is three periods long, and sums of powers agree for many of its parts
    assert find(np.tile(np.arange(5000), 4)[:-1]).tolist() == [[0, 19_999, 5000]]


def test_kept():
    words = ["a", "b"] * 13 + ["c"] + ["d"] * 24
    found = find(numbers([w.encode() for w in words]))
    assert found.tolist() == [[0, 26, 2], [27, 24, 1]]
    assert [words[i] for i in np.flatnonzero(kept(len(words), found))] == ["a", "b", "c", "d"]


def test_frame_of_messy_rows(spark):
    text = "x " + "la li\t" * 20 + "  y"
    rows = [(1, text, "p"), (1, text, "q"), (2, None, None), (3, "", "r"), (None, "w " * 24, "s"), (4, "w " * 23, None), (5, "あ " * 30 + "z" * 100_000, None)]
    got = runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str)
    once = (1, [(1, 40, 2)], "x la li   y")
    assert found == sorted([once, once, (2, [], ""), (3, [], ""), (None, [(0, 24, 1)], "w"), (4, [], " ".join("w" * 23)), (5, [(0, 30, 1)], "あ " + "z" * 100_000)], key=str)
    assert runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_brute_force(spark, tmp_path):
    from docketry.llm.queries import op11_periodic_runs

    rows = [(i, " ".join(f"w{i * k * k % 41}" for k in range(i % 150)) + "\n " * (i % 3)) for i in range(400)]
    rows += [(400 + i, "la " * (20 + i) + "ra da " * (10 + i) + "b") for i in range(30)] + [(500, None), (501, ""), (502, " \t ")]
    rows += [(i, None if i % 2 else "  ") for i in range(503, 560)]  # some of them are to be repeated, but have no words
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 30
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected(*r) for r in rows)
