"""Identity keys on which rows are joined and rows are told apart."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = chr(0x241F)
_NBSP = " "


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def text_key(text: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded, white space collapsed. Neither NFKC nor case folding is built in."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def loose_key(text: str | Column) -> Column:
    """No-break space as space, white space collapsed, lower case; null reads as blank."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[\s" + _NBSP + "]+", " ")))


def article_key(text: str | Column) -> Column:
    """Loose key, colons as spaces, no dot after a last digit."""
    flat = F.regexp_replace(F.replace(loose_key(text), F.lit(":"), F.lit(" ")), " +", " ")
    return F.regexp_replace(F.trim(flat), r"([0-9])\.$", "$1")


def pair_key(hypothesis: str, premise: str, article: str | None = None) -> Column:
    parts = [loose_key(hypothesis).alias("hypothesis"), loose_key(premise).alias("premise")]
    return F.struct(*parts, *([article_key(article).alias("article")] if article else []))


def diff_key(*columns: str) -> Column:
    return F.concat_ws(SEPARATOR, *map(loose_key, columns))


def occurrence(key: str, order: str) -> Column:
    """0-based count within a key in the given order."""
    return F.row_number().over(W.partitionBy(key).orderBy(order)) - 1


def citation_key(citation: str) -> Column:
    """Four collapsed lower-case strings; null reads as blank."""
    return F.struct(*(loose_key(F.col(citation)[f]).alias(f) for f in ("code", "article", "part", "point")))


def citation_article_key(citation: str) -> Column:
    return F.struct(*(loose_key(F.col(citation)[f]).alias(f) for f in ("code", "article")))


def canonical_code(code: str | Column) -> Column:
    """Collapsed spaces; a volume suffix ("часть первая" and so on) is folded into the code."""
    flat = F.trim(F.regexp_replace(_col(code), r"[\s" + _NBSP + "]+", " "))
    return F.regexp_replace(flat, r"(?iu)[,.]? *\(?часть (первая|вторая|третья|четвертая|четвёртая)\)?$", "")


def same_code(a: str, b: str) -> Column:
    """Canonical, case-insensitive comparison; null is never equal."""
    return F.coalesce(F.lower(canonical_code(a)) == F.lower(canonical_code(b)), F.lit(False))


def digest_id(*columns: str | Column, length: int = 16) -> Column:
    """Prefix of the SHA-256 of the columns' canonical JSON array; null stays null in it."""
    return F.substring(F.sha2(F.to_json(F.array(*(_col(c).cast("string") for c in columns))), 256), 1, length)


def text_digest(text: str | Column) -> Column:
    return F.sha2(F.encode(_col(text), "UTF-8"), 256)


def unit_id(**levels: str | Column) -> Column:
    """code:article:..:part:..:point:.. over the levels that aren't blank."""
    parts = []
    for name, value in levels.items():
        value = F.nullif(F.trim(_col(value)), F.lit(""))
        parts.append(value if name == "code" else F.concat(F.lit(f"{name}:"), value))
    return F.concat_ws(":", *parts)


def subject_key(filename: str | Column, stops: tuple[str, ...] = ("решение", "постановление", "копия", "copy", "review")) -> Column:
    """First token of a file name that isn't a stop word, lower case, underscores being spaces."""
    stem = F.regexp_replace(F.regexp_replace(_col(filename), r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")
    tokens = F.split(F.trim(F.regexp_replace(F.lower(stem), r"[_\s]+", " ")), " ")
    return F.try_element_at(F.filter(tokens, lambda t: (t != "") & ~t.isin(*stops)), F.lit(1))


def example_id(stem: str, row: str | Column) -> Column:
    return F.format_string(f"{stem}:%06d", _col(row))


def source_reference(file: str | Column, row: str | Column) -> Column:
    """file:row, counting from the header as row 1."""
    return F.concat_ws(":", _col(file), (_col(row) + 2).cast("string"))


def permanent_id(split: str | Column, number: str | Column) -> Column:
    return F.concat(_col(split), F.lit("_"), F.lpad(_col(number).cast("string"), 6, "0"))


def safe_name(name: str | Column, fallback: str = "unnamed", most: int = 80) -> Column:
    """A file name without unsafe characters, cut to ``most``; the fallback if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(_col(name), r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(flat, 1, most), F.lit("")), F.lit(fallback))
