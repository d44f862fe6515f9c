"""A corpus pipeline of five stages, each one of the operators of docketry.llm.

Every stage is a function of (spark, docs, sf_dir), where docs has the columns of ``documents``; all but the last
return these columns. ``run`` applies them to the whole table, each stage's result being written before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import crc_bucket, discard, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go; the others keep their labels."""
    from docketry.llm.langid import identify

    found = identify(docs, crc_bucket("doc_id", 4) != 2)
    return found.where(~F.col("found.rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of near copies the document with the smallest id stays, once."""
    from docketry.llm.simhash import keep_one

    return keep_one(docs, "doc_id").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item of the benchmark go."""
    from docketry.llm.decontamination import filter_clean

    return filter_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix takes it."""
    from docketry.llm.mixing import mix

    return mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: the store of all that is left; doc_id, start, n_tokens and ids_crc32 as read back from it."""
    import public_tokenizers

    from docketry.llm.token_store import token_digests

    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither the trained stages nor the rounding; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        discard(*held)
        held = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads the token store that it has written, no longer the documents
    discard(*held)
    return out
