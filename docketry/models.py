"""What models are to the engine: injected callables with checked results, their caches, token budgets and batches.

No model is part of the package. Encoders, rerankers, predictors, servers and page fetchers come from outside.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.schemas import ConstraintError
from docketry.shared import settled


class Encoder(Protocol):
    """Texts to vectors; ``configuration`` names model and revision, ``max_tokens`` the most that a text may have."""

    configuration: dict
    max_tokens: int

    def token_lengths(self, texts: Sequence[str]) -> list[int]: ...

    def encode_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def encode_query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    def score(self, query: str, documents: Sequence[str]) -> list[float]: ...


#: A page of an address, as text.
Fetcher = Callable[[str], str]
#: Retrieval over a bundle: hypotheses (hypothesis_id, text) to hits (hypothesis_id, unit_id, rank, score).
Retriever = Callable[[DataFrame], DataFrame]


def encode(rows: DataFrame, encoder: Encoder, text: str = "text", output: str = "vector", batch: int = 64) -> DataFrame:
    """``rows`` with the encoder's vectors; a text of too many tokens is an error and is never cut."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[float]] = []
            for lo in range(0, len(texts), batch):
                part = texts.iloc[lo : lo + batch].tolist()
                if long := [t[:60] for t, n in zip(part, encoder.token_lengths(part), strict=True) if n > encoder.max_tokens]:
                    raise ConstraintError(f"texts of more than {encoder.max_tokens} tokens: {long[:3]}")
                vectors = encoder.encode_documents(part)
                if len(vectors) != len(part):
                    raise ConstraintError("an encoder has to return one vector for each text")
                out += vectors
            yield pd.Series(out)

    return rows.withColumn(output, run(text))


def rerank_scores(candidates: DataFrame, reranker: Reranker, query: str = "query", document: str = "document", output: str = "reranker_score") -> DataFrame:
    """Candidates with the reranker's scores; candidates of one query in a batch go to it together."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, documents in batches:
            out = pd.Series(0.0, index=queries.index)
            for q, at in queries.groupby(queries).groups.items():
                scores = reranker.score(q, documents.loc[at].tolist())
                if len(scores) != len(at):
                    raise ConstraintError("a reranker has to return one score for each document")
                out.loc[at] = [float(s) for s in scores]
            yield out

    return candidates.withColumn(output, run(query, document))


def retriever_for(factory: Callable[[dict, str], Retriever], bundle: dict, expected: dict, device: str = "cpu") -> Retriever:
    """A retriever of a bundle whose manifest has everything that is expected."""
    if gone := sorted(k for k, v in expected.items() if bundle.get(k) != v):
        raise ConstraintError(f"the bundle differs in {', '.join(gone)}")
    return factory(bundle, device)


def classify(pairs: DataFrame, logits: Callable[[list[str], list[str]], list[list[float]]], labels: Sequence[str], output: str = "prediction", batch: int = 32) -> DataFrame:
    """Pairs (premise, hypothesis) with the label of the largest logit, ties to the first label; deterministic batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for premises, hypotheses in batches:
            out = []
            for lo in range(0, len(premises), batch):
                rows = logits(premises.iloc[lo : lo + batch].tolist(), hypotheses.iloc[lo : lo + batch].tolist())
                out += [labels[max(range(len(labels)), key=lambda k: (row[k], -k))] for row in rows]
            yield pd.Series(out, index=premises.index)

    return pairs.withColumn(output, run("premise", "hypothesis"))


# servers


def payload_key(payload: dict) -> str:
    """Name of a request in the cache: SHA-256 of its canonical JSON."""
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_retry(send: Callable[[dict], dict], attempts: int = 3, wait: float = 0.5) -> Callable[[dict], dict]:
    """``send`` tried again after errors of the connection, waiting twice as long each time; the last error is raised."""

    def call(payload: dict) -> dict:
        for n in range(attempts):
            try:
                return send(payload)
            except (OSError, TimeoutError):
                if n + 1 == attempts:
                    raise
                time.sleep(wait * 2**n)
        raise ValueError("at least one attempt is needed")

    return call


def ask_server(requests: DataFrame, send: Callable[[dict], dict], payload: Callable[[str], dict], cache: DataFrame | None = None, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """``requests`` with key and response (JSON), and the answers that are new to the cache (key, response).

    Every distinct payload is sent once; one that the cache has is not sent. ``payload`` makes the request of a prompt. The answers are
    written to the shared folder before anything reads them, so only a task that is repeated sends again.
    """

    @F.pandas_udf("string")
    def name(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: payload_key(payload(p)))

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: json.dumps(send(payload(p)), ensure_ascii=False, sort_keys=True))

    asked = requests.withColumn("key", name(prompt))
    todo = asked.groupBy("key").agg(F.min(prompt).alias("__prompt"))
    known = cache.select("key", "response") if cache is not None else requests.sparkSession.createDataFrame([], "key string, response string")
    new = settled(todo.join(known, "key", "left_anti").select("key", answer("__prompt").alias("response")))
    return asked.join(known.unionByName(new), "key", "left"), new


def poll(fetch: Callable[[], dict], done: str = "content", polls: int = 12, wait: float = 0.5) -> dict:
    """What a search job gives once it has finished, asked at most ``polls`` times; an error if it hasn't by then."""
    for n in range(polls):
        if done in (found := fetch()):
            return found
        if n + 1 < polls:
            time.sleep(wait)
    raise TimeoutError(f"the job has not finished after {polls} polls")


# tokens


def longest_suffix(parts: Sequence[str], fits: Callable[[Sequence[str]], bool]) -> Sequence[str]:
    """The longest run of last parts that fits, by bisection; what fits has to fit without its first parts, too."""
    lo, hi = 0, len(parts)
    while lo < hi:
        mid = (lo + hi) // 2
        if fits(parts[mid:]):
            hi = mid
        else:
            lo = mid + 1
    return parts[lo:]


def plan_batches(lengths: Sequence[int], most: int, padded: int) -> list[list[int]]:
    """Places of texts in batches, longest first: ``most`` texts and ``padded`` tokens at most, each counted as the batch's longest.

    A text that is longer than ``padded`` by itself is a batch of its own.
    """
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if out and len(out[-1]) < most and lengths[out[-1][0]] * (len(out[-1]) + 1) <= padded:
            out[-1].append(i)
        else:
            out.append([i])
    return out


IGNORED = -100


def supervised_row(prompt: list[int], whole: list[int], most: int) -> dict[str, list[int]]:
    """input_ids and labels of a prompt with its answer: the prompt is masked, the answer stays.

    The tokens of the prompt have to begin those of the whole, an answer has to follow, and nothing is cut.
    """
    if whole[: len(prompt)] != prompt:
        raise ConstraintError("the prompt's tokens don't begin those of the whole")
    if len(whole) == len(prompt):
        raise ConstraintError("there is no answer to learn")
    if len(whole) > most:
        raise ConstraintError(f"{len(whole)} tokens are more than {most}")
    return {"input_ids": whole, "labels": [IGNORED] * len(prompt) + whole[len(prompt) :]}
