"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``PASSAGE`` words. TF-IDF weighs the words of the benchmark (no other word can add to a
similarity with an item): document frequencies are those of all passages, words in more than ``MAX_DF`` of them (and ``PRIOR``
passages without them) are stop words. A = all passages and, as further rows that carry half of the mass, the items. The
space is that of the ``RANK`` leading right singular vectors of A, by a randomised decomposition that reads the passages once:
every task adds up A'(A omega) of its passages for one random omega, the sum is a Nystrom sketch of A'A, and the eigenvectors
of A'A in that sketch are the vectors sought. Every window of a text, in lengths that fit the items and at strides of a quarter, is
compared with the items by its cosine there. Candidates from ``CANDIDATE`` on are checked word by word: the longest common
subsequence of item and window, and of the item's answer (or its end, where there is no answer column) and window. A text is
contaminated by an item if

* the common subsequence holds 0.7 of the item's words, or
* it holds half of them and half of the answer's (a paraphrase).

Items of fewer than eight words must be there whole.

All items live in one space; windows are multiplied with ``ITEMS`` of them at a time. Driver and workers hold the benchmark's items and
its vocabulary times RANK; windows, counts and checks cover whole texts.
Edge cases: null and empty texts are clean, null or wordless items are skipped, repeated items and rows are each
reported; empty tables give an empty result; further columns are left out (``filter_clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, settle, trimmed
from docketry.llm.words import SLOTS, WORD_BITS, word_hashes

PASSAGE, MAX_DF, RANK, OVERSAMPLE = 32, 0.05, 128, 10
#: Passages without a word that are added to those counted, so that few passages make no stop words.
PRIOR = 400
#: Share of stop words from which on an item keeps all of its words.
MOST_STOPS = 0.6
CANDIDATE, WHOLE, PART, ANSWER, SHORT = 0.55, 0.7, 0.5, 0.5, 8
#: Items that windows are multiplied with at a time, and blocks of words whose sums are held.
ITEMS, BLOCKS = 512, 2048
#: Contaminated texts that may be broadcast as 16-byte hashes; beyond that the join shuffles.
SMALL = 1_000_000


@dataclass
class Space:
    vocabulary: np.ndarray  # 64-bit hashes of words, ascending
    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, columns of the words, columns of the answer's words
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # vocabulary x rank, weighed by idf


def columns(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Columns of words in the vocabulary, -1 for others."""
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words, at, -1).astype(np.int32)


def slot_table(vocabulary: np.ndarray) -> np.ndarray:
    """Column of a word of the vocabulary for each slot of a small table, -1 where none is."""
    out = np.full(SLOTS, -1, np.int32)
    out[(vocabulary >> np.uint64(64 - WORD_BITS)).astype(np.int64)] = np.arange(len(vocabulary))
    return out


def text_columns(text: bytes | None, vocabulary: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Columns of a text's words: that of their slot if the whole hashes agree, else they are sought; -1 for others."""
    words = word_hashes(text)
    out = table[(words >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    some = np.flatnonzero(out >= 0)
    other = some[vocabulary[out[some]] != words[some]]
    if len(other):
        out[other] = columns(words[other], vocabulary)
    return out


def read_items(rows: list) -> Space:
    """Items from rows (item_id, text, answer)."""
    words = [(r[0], word_hashes((r[1] or "").encode()), word_hashes(r[2].encode()) if r[2] else None) for r in rows]
    words = [w for w in words if len(w[1])]
    every = [x for w in words for x in (w[1], w[2]) if x is not None]
    vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
    items = []
    for i, text, answer in words:
        c = columns(text, vocabulary)
        items.append((i, c, columns(answer, vocabulary) if answer is not None and len(answer) else c[-max(3, len(c) // 5) :]))
    return Space(vocabulary, items)


def _sparse(cols: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and weights of the passages of a text: (1 + ln tf) idf, of length one."""
    row = np.arange(len(cols)) // PASSAGE
    known = cols >= 0
    known[known] = idf[cols[known]] > 0
    key, n = np.unique(row[known].astype(np.int64) * len(idf) + cols[known], return_counts=True)
    row, col = key // len(idf), key % len(idf)
    w = (1 + np.log(n)) * idf[col]
    norm = np.sqrt(np.bincount(row, w * w))
    return row, col, (w / norm[row]).astype(np.float32)


def _filled(texts: Iterator[np.ndarray], words: int = 20_000) -> Iterator[np.ndarray]:
    """Columns of several texts at a time, each filled up with words outside the vocabulary to whole passages."""
    held, n = [], 0
    for cols in texts:
        held += [cols, np.full(-len(cols) % PASSAGE, -1, np.int32)]
        n += len(cols)
        if n > words:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _frequencies(cols: np.ndarray, size: int) -> np.ndarray:
    """In how many passages each word of the vocabulary is."""
    at = np.flatnonzero(cols >= 0)
    return np.bincount(np.unique(at // PASSAGE * size + cols[at]) % size, minlength=size)


def _gram_times(row: np.ndarray, col: np.ndarray, w: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Add A'(A omega) of the passages to ``out``."""
    if not len(row):
        return
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    y = np.add.reduceat(omega[col] * w[:, None], starts, axis=0)
    nth = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
    order = np.argsort(col, kind="stable")
    c = col[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    out[c[first]] += np.add.reduceat(y[nth[order]] * w[order][:, None], first, axis=0)


_PART = "n long, array binary"


def added_up(parts: DataFrame, zero: np.ndarray) -> tuple[int, np.ndarray]:
    """Sum of the counts and arrays (as bytes) that each task gave, by a tree of two levels; the driver adds single rows."""
    parts = settle(parts.withColumn("group", F.spark_partition_id()), "parts")
    groups = max(1, int(parts.count() ** 0.5))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, some = 0, zero.copy(), False
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, total, some = n + k, total + np.frombuffer(packed, zero.dtype).reshape(zero.shape), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], ["n", "array"])

    n, total, sums = 0, zero.copy(), settle(parts.repartition(groups, "group").select("n", "array").mapInArrow(trimmed(add), _PART), "parts")
    for r in sums.toLocalIterator():
        n, total = n + r.n, total + np.frombuffer(r["array"], zero.dtype).reshape(zero.shape)
    discard(parts, sums)
    return n, total


def fit(space: Space, texts: DataFrame, counts: DataFrame, seed: int = 5) -> Space:
    """Fill in ``idf`` and ``axes`` from ``texts`` (cols) and the tasks' ``counts`` (n, array) of passages and frequencies."""
    size = len(space.vocabulary)
    spark = texts.sparkSession
    total, df = added_up(counts, np.zeros(size, np.int64))
    idf = np.log((1 + total) / (1 + df)) + 1
    stop = df > MAX_DF * (total + PRIOR)
    for _, c, _ in space.items:
        if stop[c].mean() > MOST_STOPS:  # an item of common words is looked for by these
            stop[c] = False
    idf[stop] = 0
    width = min(size, RANK + OVERSAMPLE)
    omega = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, omega))  # vocabulary of a block of items x width

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value
        out, rows = np.zeros((size, width), np.float32), 0
        for cols in _filled(np.frombuffer(x, np.int32) for b in batches for x in b.column(0).to_pylist()):
            row, col, w = _sparse(cols, weights)
            rows += len(cols) // PASSAGE
            _gram_times(row, col, w, start, out)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([out.tobytes()])], ["n", "array"])

    mass, y = added_up(texts.select("cols").mapInArrow(trimmed(passages), _PART), np.zeros((size, width), np.float32))
    shared.destroy()
    parts = []
    for k, (_, c, _) in enumerate(space.items):
        row, col, w = _sparse(c[: len(c)], idf)
        parts.append((np.full(len(row), k), col, w))
    own = np.zeros((size, width), np.float32)
    _gram_times(*(np.concatenate(x) for x in zip(*parts, strict=True)), omega, own)
    y = y / max(mass, 1) + own / len(parts)
    space.idf, space.axes = idf, (idf[:, None] * leading(y, omega)[:, : min(RANK, width)]).astype(np.float32)
    return space


def leading(sketch: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Eigenvectors, leading first, of the Nystrom approximation of a positive semidefinite M from M omega.

    M is about (M omega) (omega' M omega)^-1 (M omega)'; the small shift makes the middle one safe to factor.
    """
    sketch, omega = sketch.astype(np.float64), omega.astype(np.float64)
    shift = 1e-6 * np.sqrt((sketch * sketch).sum() / (omega * omega).sum()) + 1e-300
    shifted = sketch + shift * omega
    middle = omega.T @ shifted
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    keep = values > 1e-10 * max(values.max(), 0)
    return np.linalg.svd(shifted @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)[0]


def common(item: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``item``: bit masks of each word's places among ``n``."""
    full = (1 << n) - 1
    v = full
    for c in words:
        if m := item.get(c):
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(words.tolist()):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds the items of a space in texts."""

    def __init__(self, space: Space):
        self.space, self.axes = space, np.concatenate([space.axes, np.zeros((1, space.axes.shape[1]), np.float32)])
        self.masks = [(len(c), _masks(c), len(a), _masks(a)) for _, c, a in space.items]
        z = np.array([self.axes[c].sum(axis=0) for _, c, _ in space.items], np.float32)
        self.latent = z / np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-9)[:, None]
        lengths = np.array([len(c) for _, c, _ in space.items])
        steps = np.array([int(x * 2**k) for k in range(3, 40) for x in (1, 1.5)])
        size = steps[np.searchsorted(steps, np.maximum(lengths * 1.25, 8))]  # 8, 12, 16, 24, 32, 48 .. words
        self.classes = [(int(s), at[lo : lo + ITEMS]) for s in np.unique(size) for at in [np.flatnonzero(size == s)] for lo in range(0, len(at), ITEMS)]
        # words of a block: the largest power of two within a quarter of the shortest windows; all windows are multiples
        self.unit = 1 << max(0, (min(s for s, _ in self.classes) // 4).bit_length() - 1)

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, float, float, int, int]]]:
        """(item place, cosine, share of the item, share of the answer, first and last word) of each contaminating item, for each text."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        reach, pieces, held = self.classes[-1][0] // self.unit, [], 0
        for n, cols in enumerate(texts):
            blocks = -(-len(cols) // self.unit)
            for lo in range(0, blocks, BLOCKS):  # windows begin in the piece, the longest reach over
                pieces.append((n, lo, min(blocks - lo, BLOCKS), min(blocks - lo, BLOCKS + reach)))
                held += pieces[-1][3]
                if held > BLOCKS:
                    self._pieces(texts, pieces, best)
                    pieces, held = [], 0
        if pieces:
            self._pieces(texts, pieces, best)
        return [[(k, *v) for k, v in sorted(b.items())] for b in best]

    def _pieces(self, texts: list[np.ndarray], pieces: list[tuple[int, int, int, int]], best: list[dict[int, tuple]]) -> None:
        """Compare the windows of pieces (text, first block, blocks in which windows begin, blocks there) with the items."""
        unit = self.unit
        cols = np.full(sum(p[3] for p in pieces) * unit, -1, np.int32)
        _, los, own, there = map(np.array, zip(*pieces, strict=True))
        ends = np.cumsum(there)
        starts = ends - there
        for (n, lo, _, blocks), at in zip(pieces, (starts * unit).tolist(), strict=True):
            part = texts[n][lo * unit : (lo + blocks) * unit]
            cols[at : at + len(part)] = part
        used = np.flatnonzero(cols >= 0)
        used = used[self.space.idf[cols[used]] > 0]
        if not len(used):
            return
        # sums over the words that count, up to each of them
        sums = np.empty((len(used) + 1, self.axes.shape[1]), np.float32)
        sums[0] = 0
        np.take(self.axes, cols[used], axis=0, out=sums[1:], mode="clip")
        np.cumsum(sums, axis=0, out=sums)
        for s, items in self.classes:
            step = max(1, s // 4 // unit)
            n = -(-own // step)
            begin = np.repeat(starts - step * (np.cumsum(n) - n), n) + step * np.arange(int(n.sum()))
            end = np.minimum(begin + s // unit, np.repeat(ends, n))
            z = sums[np.searchsorted(used, end * unit)] - sums[np.searchsorted(used, begin * unit)]
            norm = np.sqrt(np.einsum("ij,ij->i", z, z))
            scores = z @ self.latent[items].T
            window, item = np.nonzero(scores >= CANDIDATE * np.maximum(norm, 1e-6)[:, None])
            piece = np.searchsorted(ends, begin[window], side="right")
            for w, k, p in zip(window.tolist(), items[item].tolist(), piece.tolist(), strict=True):
                at = (int(los[p]) + int(begin[w] - starts[p])) * unit
                self._check(texts[pieces[p][0]], k, float(scores[w, np.searchsorted(items, k)] / norm[w]), at, s, best[pieces[p][0]])

    def _check(self, cols: np.ndarray, k: int, cosine: float, start: int, size: int, best: dict[int, tuple]) -> None:
        if k in best and best[k][1] >= 1.0:
            return
        n, item, m, answer = self.masks[k]
        lo, hi = max(0, start - size // 4), min(len(cols), start + size + size // 4)
        words = cols[lo:hi].tolist()
        if sum(map(item.__contains__, words)) < PART * n:  # no subsequence can be as long
            return
        share = common(item, n, words) / n
        if share < (1.0 if n < SHORT else PART) or (k in best and best[k][1] >= share):
            return
        held = common(answer, m, words) / m
        if n < SHORT or share >= WHOLE or held >= ANSWER:
            best[k] = (cosine, share, held, lo, hi)


_FOUND = "doc_id long, print binary, item_id long, cosine double, lcs double, answer double, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text, perhaps answer) in it.

    doc_id, print (md5 of the text), item_id, cosine, lcs and answer (shares found), first_word and last_word (where).
    """
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    space = read_items(sorted(map(tuple, benchmark.select("item_id", "text", answer.alias("answer")).collect()), key=str))
    if not space.items:
        return spark.createDataFrame([], _FOUND)
    words = spark.sparkContext.broadcast(space.vocabulary)  # of the items

    size = len(space.vocabulary)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns of each text; a task's last row (n) has its passages and their frequencies."""
        table = slot_table(words.value)
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            found = [text_columns(t.as_py(), words.value, table) for t in b.column(2)]
            for cols in _filled(iter(found)):
                df += _frequencies(cols, size)
                n += len(cols) // PASSAGE
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(0), b.column(1), pa.array([c.tobytes() for c in found], pa.binary())], ["n", "doc_id", "print", "cols"])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()])], ["n", "doc_id", "print", "cols"])

    text = F.col("text").cast("binary")
    staged = settle(docs.where("text is not null").select("doc_id", F.unhex(F.md5(text)).alias("print"), text).mapInArrow(trimmed(stage), "n long, doc_id long, print binary, cols binary"), "columns")
    texts = staged.where("n is null").select("doc_id", "print", "cols")
    fitted = spark.sparkContext.broadcast(fit(space, texts, staged.where("n is not null").select("n", F.col("cols").alias("array"))))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(fitted.value)
        for b in batches:
            rows = []
            ids, marks, packed = (b.column(i).to_pylist() for i in range(3))
            for doc_id, mark, found in zip(ids, marks, matcher.find([np.frombuffer(x, np.int32) for x in packed]), strict=True):
                for k, cosine, share, held, lo, hi in found:
                    rows.append((doc_id, mark, fitted.value.items[k][0], cosine, share, held, lo, hi))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    out = settle(texts.mapInArrow(trimmed(match), _FOUND), "contaminated")
    discard(staged)
    return out


def filter_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) that no item contaminates."""
    marks = contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("print").alias("__print")).distinct()
    few = marks.limit(SMALL + 1).count() <= SMALL
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    return docs.withColumn("__own", own).join(F.broadcast(marks) if few else marks, F.col("__own") == F.col("__print"), "left_anti").select(*docs.columns)
