"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts have a model each, of word pairs. All counts are continuation counts: a pair (v, w) counts once for each word
that a class has seen before it, a word once for each such word v. So a passage counts once, however often it is copied.

    P_c(w | v) = (max(n_c(v w) - PAIR, 0) + freed_c(v) U_c(w | v)) / n_c(v .)
    U_c(w | v) = (max(N_c(. w) - WORD, 0) + freed_c P(w | v)) / N_c(. .)
    P(w | v)   = (max(n(v w) - PAIR, 0) + freed(v) P(w)) / n(v .)         of both classes together
    P(w)       = (N(. w) + 1/2) / (N(. .) + slots / 2)

freed is what the discounts PAIR and WORD take off. The lower two levels are shared, so that a rare expression says little for
either class. Pairs that both classes together have in PAIR contexts or fewer have no level of their own: what is freed for
them is taken to be alike in both classes, and their ratio is that of the words, U_1 / U_0 with P(w) as backoff. So is that of
pairs whose ratio is within ``PRUNE`` of it.

A text's evidence are its log-likelihood ratios by position, divided by length: the mean over the text, the largest mean of
``WINDOW`` words (toxic expressions are short, texts may be long) and the largest of a single word. These are calibrated to a
probability on labelled rows that the counts left out.

Counts are over all learning rows. Words are slots of a hashed table that grows with the counted vocabulary: ``SPARE`` slots
for each word, 2^WORD_BITS at least. Workers get four bytes a slot and twelve for each pair that is kept.

Edge cases: null and empty texts get the score of a text without evidence; an empty table gives an empty result; without
labelled rows of both classes every score is 0; repeated label rows count once (toxic if any says so), repeated
documents as often as they occur; further columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, settle, trimmed
from docketry.llm.words import WORD_BITS, word_hashes, word_slots

WINDOW, WORD, PAIR, PRUNE = 4, 1.5, 3.0, 0.25
#: Slots for each word of the learning rows.
SPARE = 4
#: Label rows that may be broadcast (16 bytes each); beyond that the join shuffles.
SMALL_LABELS = 2_000_000


def pair_keys(words: np.ndarray, bits: int = WORD_BITS) -> np.ndarray:
    """(word before, word) of each position as one number; slot 0 stands before the first."""
    return _before(words, 1) << bits | words


def _before(words: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.zeros(n, words.dtype), words])[: len(words)]


@dataclass
class Model:
    """``logs``: by slot, the log ratio of a word; ``keys`` and ``ratios``: the pairs with a ratio of their own, by key.

    ``weights``: of 1, the largest word, the largest window and the mean.
    """

    logs: np.ndarray  # a power of two
    keys: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    ready: bool = True

    def __post_init__(self) -> None:
        self.bits = len(self.logs).bit_length() - 1

    def positions(self, words: np.ndarray) -> np.ndarray:
        """log P_1 - log P_0 of each word after the one before it."""
        r = self.logs[words].astype(np.float64)
        if len(self.keys):
            pairs = pair_keys(words, self.bits)
            at = np.searchsorted(self.keys, pairs)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == pairs
            r[hit] = self.ratios[at[hit]]
        return r

    def evidence(self, words: np.ndarray) -> tuple[float, float, float]:
        """Largest ratio of a word, largest mean of a window, mean of the text; a short text counts as a full window."""
        if not len(words):
            return 0.0, 0.0, 0.0
        r = self.positions(words)
        total = np.concatenate([[0.0], np.cumsum(r)])
        k = min(WINDOW, len(r))
        return float(r.max()), float((total[k:] - total[:-k]).max() / WINDOW), float(total[-1] / max(len(r), WINDOW))

    def score(self, words: np.ndarray) -> float:
        if not self.ready:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.array([1.0, *self.evidence(words)]), -50, 50))))


_TRIPLE = "pair long, before int, classes int"


def _contexts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct words before each pair in each class, as far as the task's memory allows."""
    held: tuple[list, list] = ([], [])
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for c in (0, 1):
            if held[c]:
                pair, before = (np.concatenate(x) for x in zip(*held[c], strict=True))
                held[c].clear()
                order = np.lexsort((before, pair))
                pair, before = pair[order], before[order]
                new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (before[1:] != before[:-1])])[: len(pair)])
                for lo in range(0, len(new), 100_000):
                    k = new[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(pair[k]), pa.array(before[k].astype(np.int32)), pa.array(np.full(len(k), 1 << c, np.int32))], ["pair", "before", "classes"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = word_slots(text, bits)
            held[toxic].append((pair_keys(words, bits), _before(words, 2)))
            size += len(words) + 20
            if size > 2_000_000:
                yield from flush()
                size = 0
    yield from flush()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct word hashes of each batch."""
    for b in batches:
        found = [word_hashes(t) for t in b.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["word"])


def table_bits(words: int) -> int:
    """Bits of a table with ``SPARE`` slots for each word; a pair of slots fits a long up to 31."""
    return min(31, max(WORD_BITS, (SPARE * words - 1).bit_length()))


def counts(rows: DataFrame, bits: int) -> DataFrame:
    """pair, n0, n1, n for every pair in ``rows`` (text binary, toxic 0/1): words before it in either class and in both together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contexts(batches, bits)

    seen = rows.mapInArrow(trimmed(run), _TRIPLE).repartition("pair").groupBy("pair", "before").agg(F.bit_or("classes").alias("classes"))
    of = [F.count_if(F.col("classes").bitwiseAND(which) > 0).cast("int").alias(n) for n, which in (("n0", 1), ("n1", 2), ("n", 3))]
    return seen.groupBy("pair").agg(*of)


def gather(rows: DataFrame) -> Model:
    """Count over all ``rows`` (text binary, toxic 0/1). The driver gets a row for each slot that a word has and each pair that is kept."""
    bits = table_bits(rows.select("text").mapInArrow(trimmed(_vocabulary), "word long").agg(F.approx_count_distinct("word", 0.02)).first()[0])
    slots = 1 << bits
    pairs = settle(counts(rows, bits), "pairs")
    word, before = F.col("pair").bitwiseAND(F.lit(slots - 1)).alias("word"), F.shiftrightunsigned("pair", bits).alias("before")
    words = settle(pairs.groupBy(word).agg(F.count_if(F.col("n0") > 0).alias("w0"), F.count_if(F.col("n1") > 0).alias("w1"), F.count("*").alias("w")), "words")
    sums = words.agg(*(F.coalesce(F.sum(e), F.lit(0)).cast("double") for e in ("w0", "w1", "w", F.least(F.col("w0"), F.lit(WORD)), F.least(F.col("w1"), F.lit(WORD))))).first()
    if not (sums[0] and sums[1]):
        discard(pairs, words)
        return Model(np.zeros(slots, np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(4), False)
    every, freed = sums[:2], sums[3:]
    single = (F.col("w") + 0.5) / (sums[2] + 0.5 * slots)

    def unigram(c: int, backoff):
        return (F.greatest(F.col(f"w{c}") - WORD, F.lit(0.0)) + freed[c] * backoff) / every[c]

    alone = F.log(unigram(1, single)) - F.log(unigram(0, single))
    whole = words.select("word", alone.cast("float").alias("ratio")).toArrow()
    unseen = np.log(freed[1] / every[1]) - np.log(freed[0] / every[0])
    logs = np.full(slots, unseen, np.float32)
    logs[whole.column(0).to_numpy()] = whole.column(1).to_numpy()

    names = ("n0", "n1", "n")
    context = pairs.groupBy(before).agg(*(F.sum(x).alias(f"t_{x}") for x in names), *(F.sum(F.least(F.col(x), F.lit(PAIR))).alias(f"f_{x}") for x in names))
    apart = pairs.where(F.col("n") > PAIR).withColumn("before", before).withColumn("word", word).join(context, "before").join(words, "word")
    level = lambda x, lower: (F.greatest(F.col(x) - PAIR, F.lit(0.0)) + F.col(f"f_{x}") * lower) / F.col(f"t_{x}")
    both = level("n", single)
    of = [F.when(F.col(f"t_n{c}") > 0, level(f"n{c}", unigram(c, both))).otherwise(unigram(c, both)) for c in (0, 1)]
    ratio = F.log(of[1]) - F.log(of[0])
    kept = apart.select("pair", ratio.cast("float").alias("ratio"), alone.alias("alone")).where(F.abs(F.col("ratio") - F.col("alone")) > PRUNE).select("pair", "ratio").toArrow()
    keys, ratios = kept.column(0).to_numpy(), kept.column(1).to_numpy()
    order = np.argsort(keys)
    discard(pairs, words)
    return Model(logs, keys[order], ratios[order], np.zeros(4))


def calibrate(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    x, w = np.concatenate([np.ones((len(toxic), 1)), evidence], axis=1), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - 1e-3 * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4), slope)
    return w


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, calibration: int = 20_000) -> Model:
    """Count over the rows of ``docs`` (key, text) that ``learn_from`` (on key) admits and ``labels`` (key, toxic) mark.

    One row in five, chosen by a hash of its key, only calibrates; of these at most some ``calibration`` are taken.
    """
    marks = labels.where("toxic in (0, 1) and key is not null").groupBy("key").agg(F.max("toxic").cast("int").alias("toxic")).where(learn_from)
    few = marks.limit(SMALL_LABELS + 1).count()
    marked = docs.where(learn_from).select("key", "text").join(F.broadcast(marks) if few <= SMALL_LABELS else marks, "key")
    held = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(5)) == 0
    model = gather(marked.where(~held).select(F.col("text").cast("binary"), "toxic"))
    if not model.ready:
        return model
    share = min(1.0, 5 * calibration / max(few, 1)) if few <= SMALL_LABELS else 5 * calibration / marks.count()
    ticket = F.pmod(F.xxhash64("key", F.lit(12)), F.lit(1 << 20)) < int(share * (1 << 20))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([shared.value.evidence(word_slots(t, shared.value.bits)) for t in b.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(3)), b.column(1)], ["top", "window", "mean", "toxic"])

    seen = marked.where(held & ticket).select(F.col("text").cast("binary"), "toxic").mapInArrow(trimmed(weigh), "top double, window double, mean double, toxic int").toArrow()
    found = np.stack([seen.column(i).to_numpy() for i in range(3)], axis=1)
    toxic = seen.column(3).to_numpy()
    order = np.lexsort((toxic, *found.T))  # sums don't depend on the order of tasks
    # without rows to calibrate on, a word ten times likelier when toxic is the border
    model.weights = calibrate(found[order], toxic[order]) if len(toxic) else np.array([-2.3, 1.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """key, score of each row of ``docs`` (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ratios: four bytes a slot, which grow with the vocabulary, and twelve a pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(word_slots(t.as_py(), shared.value.bits)) for t in b.column(1)], pa.float64())], ["key", "score"])

    return docs.select("key", F.col("text").cast("binary")).mapInArrow(trimmed(run), "key long, score double")
