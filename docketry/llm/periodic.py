"""Periodic runs of words: a harmonic grid of places and periods, whose common extensions are found all at once.

A run is a stretch of words with smallest period q (words q apart are the same), at least ``least`` words and ``times``
periods long, that neither neighbouring word extends. For each period q, places are tested at a distance of
max(least, times * q) - q, the fewest places whose word and the one q later lie in the run, so every run has one on the
grid: some n / q places for a text of n words, n log n in all. Pairs whose words differ are dropped at once. For the rest,
prefix hashes of the text and binary searches over all pairs simultaneously give the extensions to either side. Each
stretch found is then compared word by word (a stretch whose hashes agreed by chance is searched again without them), and
one that is found for several periods or places counts once, with its smallest period: a stretch of two or more periods q
and q' has their greatest common divisor as a period as well, and is extended as far by it.

Pairs are dealt with by blocks of periods, so memory depends on ``PAIRS`` and on the longest single text.

Edge cases: a null or empty text has no runs and collapses to an empty text; rows that repeat an id are rows of their own;
an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORD_CLASS, trimmed

#: Words of the shortest run, and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Pairs of places that are held at once; the pairs of one period are never split.
PAIRS = 1 << 20
_PRIME = 0x9E3779B97F4A7C15

_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of the hash's base, 0 to n."""
    held = _POWERS[0]
    while len(held) <= n:
        held = np.concatenate([held, held * np.uint64(int(held[-1]) * _PRIME % (1 << 64))])
    _POWERS[0] = held if len(held) <= 1 << 20 else _POWERS[0]
    return held


def _extensions(prefix: np.ndarray, power: np.ndarray, a: np.ndarray, q: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
    """For all pairs of places a, a + q at once: how many words from there on (or before them) are the same, ``room`` at most."""
    low, high = np.zeros(len(a), np.int64), room.copy()
    shift = power[q]
    for _ in range(int(room.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        x, y = (a, a + mid) if forward else (a - mid, a)
        same = (prefix[y] - prefix[x]) * shift == prefix[y + q] - prefix[x + q]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _exact(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The stretch of period q around a place, without hashes."""
    differ = np.flatnonzero(words[:-q] != words[q:])
    k = int(np.searchsorted(differ, at))
    if k < len(differ) and differ[k] == at:
        return at, at
    return (int(differ[k - 1]) + 1 if k else 0), (int(differ[k]) if k < len(differ) else len(words) - q) + q


def find(words: np.ndarray, least: int = LEAST, times: int = TIMES, pairs: int = PAIRS) -> np.ndarray:
    """Runs of a text given by numbers that stand for its words: rows of start, length, period, by start, then period."""
    n, found = len(words), []
    longest = n // times
    if n < least or longest < 1:
        return np.zeros((0, 3), np.int64)
    power = _powers(n)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * power[:n], dtype=np.uint64)])
    periods = np.arange(1, longest + 1, dtype=np.int64)
    step = np.maximum(least - periods, (times - 1) * periods)
    places = (n - periods + step - 1) // step
    ends = np.cumsum(places)
    lo = 0
    while lo < longest:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + pairs, side="right")))
        count = places[lo:hi]
        q = np.repeat(periods[lo:hi], count)
        a = (np.arange(int(count.sum()), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)) * np.repeat(step[lo:hi], count)
        lo = hi
        some = words[a] == words[a + q]
        a, q = a[some], q[some]
        if not len(a):
            continue
        after = _extensions(prefix, power, a, q, n - q - a, True)
        start = a - _extensions(prefix, power, a, q, a, False)
        length = a + after + q - start
        some = length >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([start, length, q, a], 1)[some], axis=0))
    held: dict[tuple[int, int], int] = {}
    for start, length, q, a in np.concatenate(found).tolist() if found else []:
        end = start + length
        if held.get((start, end), q + 1) <= q:  # the same stretch by a smaller period, or found from another place
            continue
        if not np.array_equal(words[start : end - q], words[start + q : end]):  # hashes that agree by chance
            start, end = _exact(words, a, q)
            if end - start < max(least, times * q) or held.get((start, end), q + 1) <= q:
                continue
        held[start, end] = q
    return np.array(sorted((s, e - s, q) for (s, e), q in held.items()), np.int64).reshape(-1, 3)


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: not those that any run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    of: dict[bytes, int] = {}
    return np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, len(words))


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period), collapsed (text) of each row's whole ``text``.

    ``collapsed`` has each run's first period only, its words joined by one space. No shuffle: a text is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, ends, texts = [np.zeros((0, 3), np.int64)], [0], []
            for text in b.column(1).to_pylist():
                words = (text or b"").split()
                here = find(numbers(words), least, times)
                parts.append(here)
                ends.append(ends[-1] + len(here))
                if len(here):
                    words = [words[i] for i in np.flatnonzero(kept(len(words), here)).tolist()]
                texts.append(b" ".join(words))
            flat = np.concatenate(parts)
            entries = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries), pa.array(texts, pa.binary())], ["doc_id", "runs", "collapsed"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(trimmed(run), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated(doc_id: Column, text: Column) -> Column:
    """One text in ten, by the crc32 of its id h, becomes periodic: its words from a on repeat the p words from there, with
    a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10) for n words; the others stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD_CLASS})"))
    marked = F.struct(words.alias("w"), F.size(words).alias("n"), g.alias("g"))
    at = lambda m: F.struct(m["w"].alias("w"), F.pmod(m["g"], m["n"]).alias("a"), (1 + F.floor((m["n"] - F.pmod(m["g"], m["n"])) / (3 + m["g"] % 8))).alias("p"))
    copied = lambda m: F.transform(m["w"], lambda w, i: F.when(i < m["a"], w).otherwise(F.get(m["w"], (m["a"] + F.pmod(i - m["a"], m["p"])).cast("int"))))
    # a transform over one value binds it, so that the words are found once
    made = F.get(F.transform(F.array(marked), lambda m: F.array_join(F.get(F.transform(F.array(at(m)), copied), 0), " ")), 0)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.regexp_instr(text, F.lit(WORD_CLASS)) > 0), made).otherwise(text)
