"""Labels, struct types and violation reports shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The three labels in their fixed order, which is also their precedence.
LABELS = ("contradiction", "entailment", "not mentioned")
INVALID = "invalid"
RAG_MISS = "rag_miss"
SPLITS = ("train", "val", "test")
STATUSES = ("pending", "proposed", "approved", "excluded")
RELEVANCE = ("related", "unrelated")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CITATION = _strings("code", "article", "part", "point")
SENTENCE = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PORTABLE_ROW = _strings("id", "hypothesis", "premise", "article_number", "context", "label", "error_type", "document", "text_path")
EDIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])


class ConstraintError(ValueError):
    """Data that break a declared rule."""


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    if gone := missing_columns(df, required):
        raise ConstraintError(f"columns are missing: {', '.join(gone)}")
    return df


def require_exact_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    if tuple(df.columns) != tuple(columns):
        raise ConstraintError(f"columns have to be {', '.join(columns)} in this order")
    return df


def violations(df: DataFrame, key: str | Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row and rule whose condition (true where broken) holds; one scan for all rules."""
    key = F.col(key) if isinstance(key, str) else key
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def reject(*reports: DataFrame, limit: int = 5) -> None:
    """Raise once, on the driver, if any violation report has a row."""
    found = reduce(DataFrame.unionByName, reports).limit(limit).collect()
    if found:
        raise ConstraintError("; ".join(f"{r.rule}: {r.key}" for r in found))


def label_domain(column: str, allowed: tuple[str, ...] = LABELS) -> Column:
    """True where a label is null or outside its domain."""
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
