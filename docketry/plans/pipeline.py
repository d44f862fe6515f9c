"""From documents to scored pairs: the end-to-end plan with an injected predictor.

Sections and sentences, the audited filter, citations, exact lookup before vectors, prediction of each pair, and one
label for each hypothesis. Everything is one lazy plan; a document that fails a stage is a row of the error table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.citations import extract_citations
from docketry.functions.keys import digest_id
from docketry.functions.text import LEGAL, Lexicon, documents_without_section, extract_hypotheses, model_premise
from docketry.operators.retrieval import exact_lookup, route_rules_first, score_pairs
from docketry.operators.scoring import hypothesis_rows
from docketry.schemas import LABELS


@dataclass
class Outcome:
    pairs: DataFrame
    hypotheses: DataFrame
    errors: DataFrame
    audit: DataFrame


def keyword_predictor(contradicting: tuple[str, ...], supporting: tuple[str, ...]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A stand-in for a model: contradiction or entailment by keywords of the premise, else not mentioned."""

    def predict(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
        low = premise.str.lower()
        out = pd.Series(LABELS[2], index=premise.index)
        for words, label in ((supporting, LABELS[1]), (contradicting, LABELS[0])):
            for w in words:
                out[low.str.contains(w, regex=False)] = label
        return out

    return predict


def run(docs: DataFrame, units: DataFrame, predict: Callable, semantic: DataFrame | None = None, lexicon: Lexicon = LEGAL, aliases: dict[str, str] | None = None) -> Outcome:
    """``docs``: doc_id, text. ``units``: unit_id, text, source, code, article, part, point.

    ``semantic``: hypothesis_id, unit_id, rank, score, for hypotheses without an exact hit; none if it isn't given.
    """
    sentences = extract_hypotheses(docs, lexicon)
    hypotheses = sentences.where("kept").withColumn("hypothesis_id", digest_id("doc_id", "start", "sentence"))
    cited = hypotheses.select("hypothesis_id", F.posexplode(extract_citations(aliases)("sentence")).alias("citation_no", "c")).select("hypothesis_id", "citation_no", "c.*")
    exact = exact_lookup(cited.where("code is not null and article is not null"), units.select("unit_id", "code", "article", "part", "point"))
    if semantic is None:
        semantic = docs.sparkSession.createDataFrame([], f"hypothesis_id string, unit_id {units.schema['unit_id'].dataType.simpleString()}, rank int, score double")
    routed = route_rules_first(hypotheses, exact, semantic)
    pairs = routed.join(units.select("unit_id", F.col("text").alias("unit_text"), "source"), "unit_id").join(hypotheses.select("hypothesis_id", "doc_id", "index", F.col("sentence").alias("hypothesis")), "hypothesis_id")
    pairs = score_pairs(pairs.withColumn("premise", model_premise("unit_text", "source")), predict)
    errors = documents_without_section(docs, lexicon).select("doc_id", F.lit("section").alias("stage"), F.lit("no final section").alias("error"))
    return Outcome(pairs, hypothesis_rows(pairs), errors, sentences)
