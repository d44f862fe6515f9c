"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams (2 to 4) of its lower-cased words, word borders included, hashed to a fixed
table of embeddings. The mean embedding goes through a linear softmax. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (``per_lang`` texts of each language, whole texts; this bound is
the only one, prediction covers all rows). Part of the sample calibrates: a temperature makes the softmax's
largest value a probability, and texts below a threshold are rejected. The threshold is what all but ``alpha`` of
the rightly predicted calibration texts reach, and one half at most.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; an empty table gives an empty
result; without any labelled text all is ``und``; ties go to the language that comes first by code point; repeated
rows and further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, settle, trimmed

SLOT_BITS, WIDTH = 16, 16
#: Languages whose shares may be broadcast (a name and a number each); beyond that the join shuffles.
SMALL = 100_000
_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))
_BLOCK = 1 << 18
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def slots(text: str) -> Iterator[np.ndarray]:
    """Slots of all n-grams of a text, in blocks."""
    joined = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    x = np.frombuffer(joined, np.uint8)
    for lo in range(0, max(1, len(x) - 3), _BLOCK):
        h = x[lo : lo + _BLOCK + 3].astype(np.uint32) + np.uint32(1)
        grown = h
        for n in (2, 3, 4):
            grown = grown[:-1] * _ODD[n - 2] + h[n - 1 :]
            part = grown[: max(0, min(_BLOCK, len(x) - lo - n + 1))]
            yield ((part ^ (part >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SLOT_BITS)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x languages: embeddings times the softmax's weights
    bias: np.ndarray
    heat: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for part in slots(text):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return softmax((total / max(n, 1) + self.bias) * self.heat)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.6, alpha: float = 0.002, seed: int = 7) -> Model:
    """Fit on (language, slots, counts) rows in the order given; every fifth row calibrates."""
    langs = sorted({r[0] for r in rows})
    place = {g: k for k, g in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((1 << SLOT_BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    draw = np.random.default_rng(seed)
    emb = draw.uniform(-1 / WIDTH, 1 / WIDTH, (1 << SLOT_BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    data = [(place[g], i, (c / max(c.sum(), 1)).astype(np.float32)) for g, i, c in rows]
    held, fit = data[::5], [d for k, d in enumerate(data) if k % 5] or data
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for k in draw.permutation(len(fit)):
            y, i, w = fit[k]
            mean = w @ emb[i]
            d = softmax((mean @ out + bias)[None])[0].astype(np.float32)
            d[y] -= 1
            r = rate * (1 - step / steps)
            back = out @ d
            out -= r * np.outer(mean, d)
            bias -= r * d * np.float32(0.1)
            emb[i] -= (r * len(i) ** 0.5) * w[:, None] * back  # frequent slots carry more, long texts not less
            step += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    logits = np.array([w @ model.table[i] + bias for _, i, w in held])
    y = np.array([d[0] for d in held])
    heats = 2.0 ** np.arange(-3, 5, 0.25)
    loss = [-np.log(np.maximum(softmax(logits * t)[np.arange(len(y)), y], 1e-12)).mean() for t in heats]
    model.heat = float(heats[int(np.argmin(loss))])
    p = softmax(logits * model.heat)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    model.threshold = float(min(0.5, right[int(alpha * len(right))])) if len(right) else 0.0
    return model


def learn(docs: DataFrame, per_lang: int = 600, alpha: float = 0.002) -> Model:
    """Train on rows (key, text, lang) of ``docs``: of each language some ``per_lang`` rows, chosen by a hash of key.

    The driver gets the hashed counts of the sample, per_lang rows of at most 2^16 entries for each language; all languages are learned.
    """
    docs = docs.where("lang is not null and text is not null")
    share = settle(docs.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(1.2 * per_lang) / F.col("count")).alias("share")), "shares")
    few = share.limit(SMALL + 1).count() <= SMALL
    ticket = (F.pmod(F.xxhash64("key"), F.lit(1 << 24)) / (1 << 24)).alias("ticket")
    chosen = docs.select("text", "lang", ticket).join(F.broadcast(share) if few else share, "lang").where("ticket < share").select("lang", "ticket", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, t, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if _LETTER.search(x):
                    full = np.zeros(1 << SLOT_BITS, np.int64)
                    for part in slots(x):
                        full += np.bincount(part, minlength=1 << SLOT_BITS)
                    at = np.flatnonzero(full)
                    rows.append((g, t, at.astype("<u2").tobytes(), full[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.binary(), pa.binary()))], ["lang", "ticket", "at", "n"])

    found = sorted(chosen.mapInArrow(trimmed(count), "lang string, ticket double, at binary, n binary").collect(), key=lambda r: (r.ticket, r.lang, bytes(r.at)))
    discard(share)
    rows, taken = [], dict[str, int]()
    for r in found:
        if taken.get(r.lang, 0) < per_lang:
            taken[r.lang] = taken.get(r.lang, 0) + 1
            rows.append((r.lang, np.frombuffer(r.at, "<u2"), np.frombuffer(r.n, "<u4")))
    return train(rows, alpha=alpha)


def predictor(docs: DataFrame, model: Model):
    """Column function: text -> struct(lang, score, rejected)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 floats for each language that is learned

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(text):
        import pandas as pd

        m, out = held.value, []
        for t in text:
            if not m.langs or not t or not _LETTER.search(t):
                out.append(("und", 0.0, True))
                continue
            p = m.probabilities(t)
            k = int(p.argmax())
            out.append((m.langs[k], float(min(1.0, p[k])), bool(p[k] < m.threshold)))
        return pd.DataFrame(out, columns=["lang", "score", "rejected"])

    return predict


def identify(docs: DataFrame, learn_from: Column, key: str = "doc_id", per_lang: int = 600) -> DataFrame:
    """``docs`` with a struct column ``found`` (lang, score, rejected), learned from its rows that fulfil ``learn_from``."""
    model = learn(docs.where(learn_from).select(F.col(key).alias("key"), "text", "lang"), per_lang)
    return docs.withColumn("found", predictor(docs, model)("text"))
