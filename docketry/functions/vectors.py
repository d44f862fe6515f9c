"""Vectors held in array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: str | Column) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: str | Column) -> Column:
    """Unit vector; null where it isn't a vector of finite numbers other than zero."""
    return F.when(is_vector(v), F.transform(_doubles(v), lambda x: x / norm(v)))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_vector(v: str | Column) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def clip_unit(x: str | Column) -> Column:
    return F.least(F.greatest(F.col(x) if isinstance(x, str) else x, F.lit(0.0)), F.lit(1.0))
