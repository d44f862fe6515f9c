"""Citations of provisions in Russian legal texts.

A citation is a struct (code, article, part, point) of strings; numbers stay strings, so that 18.8 isn't 18.80. The
grammar, in order: groups of article numbers with their word ("ст. 5.35, 5.36", "статья 12.8", "ст.ст. 20.1 - 20.3"), a part
and a point right before or after them, and the code named nearest, on either side, within ``REACH`` characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.schemas import CITATION

REACH, NEAR = 180, 100

# Names of codes in all their forms, instruments that aren't codes, and how articles, parts and points are written.
_RF = r"(?:\s+(?:Российской\s+Федерации|РФ))?"
CODES = {
    "КоАП РФ": (
        r"КоАП(?:\s*РФ)?|КРФ\s*о\s*АП|КРФ\s*об\s*АП|КРФоАП|Кодекс(?:а|ом|у|е)?\s+(?:Российской\s+Федерации|РФ)\s+об\s+"
        r"административных\s+правонарушениях|Кодекс(?:а|ом|у|е)?\s+РФ\s+об\s+АП"
    ),
    "УПК РФ": r"УПК(?:\s*РФ)?|Уголовно[-\s]процессуальн\w*\s+кодекс\w*" + _RF,
    "УИК РФ": r"УИК(?:\s*РФ)?|Уголовно[-\s]исполнительн\w*\s+кодекс\w*" + _RF,
    "УК РФ": r"УК(?:\s*РФ)?|Уголовн\w*\s+кодекс\w*" + _RF,
    "ГПК РФ": r"ГПК(?:\s*РФ)?|Гражданск\w*\s+процессуальн\w*\s+кодекс\w*" + _RF,
    "ГК РФ": r"ГК(?:\s*РФ)?|Гражданск\w*\s+кодекс\w*" + _RF,
    "КАС РФ": r"КАС(?:\s*РФ)?|Кодекс\w*\s+административного\s+судопроизводства" + _RF,
    "ТК": r"ТК(?:\s*РФ)?|Трудов\w*\s+кодекс\w*" + _RF,
}
OTHER = r"\b(?:Федеральн\w*\s+закон\w*|ФЗ(?:\s*[-№])?|закон\w*\s+РФ)"
_NUMBER = r"[0-9]+(?:\.[0-9]+)*"
_WORD = r"\bст(?:атья|атьи|атью|атье|атьей|атьёй|атьями)?\.?(?:\s*ст\.?)?\s*"
_LIST = rf"{_NUMBER}(?:\s*(?:,|;|\bи\b|[-–—])\s*(?:ст\.?)?\s*{_NUMBER})*"
_PART = rf"(?:ч\.?|часть|части|частью|частей|частями)\s*(?P<part>{_NUMBER})"
_POINT = rf"(?:п\.?|пункт|пункта|пунктом|пункте)\s*(?P<point>{_NUMBER})"

_ARTICLES = re.compile(f"{_WORD}(?P<list>{_LIST})", re.IGNORECASE)
#: What may stand right before a group of articles, and right after it.
_BEFORE = re.compile(rf"(?:{_POINT}\s*)?(?:{_PART}\s*)?[,;:()\s]*\Z", re.IGNORECASE)
_AFTER = re.compile(rf"[()\s]*(?:{_PART}\s*)?(?:{_POINT}\s*)?", re.IGNORECASE)


def expand_numbers(group: str, single: bool = False) -> list[str] | None:
    """Article numbers of a list with ranges, in order, each once; None if a range can't be read.

    The ends of a range have to agree but for their last component and rise; without ``single`` they need two components,
    with it they are 100 apart at most.
    """
    out: list[str] = []
    joined = False
    for token in re.findall(rf"{_NUMBER}|[-–—]", group):
        if token in "-–—":
            joined = True
            continue
        if joined and out:
            (*head, first), (*tail, last) = out[-1].split("."), token.split(".")
            if head != tail or not (head or single) or not 0 <= int(last) - int(first) <= (100 if single else 1 << 30):
                return None
            out += [".".join([*head, str(n)]) for n in range(int(first) + 1, int(last) + 1)]
        else:
            out.append(token)
        joined = False
    return list(dict.fromkeys(out))


def expand_ranges(text: str) -> list[str]:
    """The numbers of parts that a remark lists; a range that can't be read is an error, to be annotated by hand."""
    found = expand_numbers(text, single=True)
    if found is None:
        raise ValueError(f"The range in {text!r} has to be annotated by hand")
    return found


class Extractor:
    """Citations of texts; ``aliases`` maps further names of codes, taken literally, to their code."""

    def __init__(self, aliases: dict[str, str] | None = None):
        named = [*CODES.items(), *((code, r"\s*".join(map(re.escape, alias.split()))) for alias, code in (aliases or {}).items())]
        self.codes = [(canonical(code), re.compile(rf"(?<!\w)(?:{p})(?!\w)", re.IGNORECASE)) for code, p in named]
        self.other = re.compile(OTHER, re.IGNORECASE)

    def markers(self, text: str) -> list[tuple[int, int, str]]:
        """Names of codes by place, the longer of two that start together first."""
        found = {(m.start(), m.end(), code) for code, p in self.codes for m in p.finditer(text)}
        return sorted(found, key=lambda x: (x[0], -x[1], x[2]))

    def __call__(self, text: str | None) -> list[dict]:
        text = text or ""
        groups = [(m.start(), m.end(), m.group("list")) for m in _ARTICLES.finditer(text)]
        if not groups:
            return []
        markers, blocks = self.markers(text), [m.span() for m in self.other.finditer(text)]
        out: list[dict] = []
        for k, (start, end, numbers) in enumerate(groups):
            articles = expand_numbers(numbers)
            if not articles:
                continue
            left = groups[k - 1][1] if k else 0
            right = groups[k + 1][0] if k + 1 < len(groups) else len(text)
            before = _BEFORE.search(text[max(left, start - NEAR) : start]).groupdict()
            after = _AFTER.match(text[end : min(right, end + NEAR)]).groupdict()
            code = self._code(start, end, left, right, markers, blocks)
            out += [{"code": code, "article": a} | {x: before[x] or after[x] for x in ("part", "point")} for a in articles]
        return [dict(x) for x in dict.fromkeys(tuple(c.items()) for c in out)]

    @staticmethod
    def _code(start: int, end: int, left: int, right: int, markers: list, blocks: list[tuple[int, int]]) -> str | None:
        """The nearest code within REACH between the neighbouring groups (ties by name), unless another instrument stands between."""
        found = []
        for a, b, code in markers:
            lo, hi = (b, start) if b <= start else (end, a)
            if (b <= start and b >= left) or (a >= end and a <= right):
                found.append((hi - lo, code, lo, hi))
        for gap, code, lo, hi in sorted(found):
            i = bisect_left(blocks, (lo, 0))
            if gap <= REACH and not any(y <= hi for _, y in blocks[i : i + 1]):
                return code
        return None


def canonical(code: str) -> str:
    """One name for the parts of a code that is split into parts."""
    name = " ".join(code.split())
    return "ГК РФ" if re.fullmatch(r"ГК РФ ч\.\s*\d+", name, re.IGNORECASE) else name


def extract_citations(aliases: dict[str, str] | None = None):
    """Column function: text -> array of citations, in order, each once. Names and numbers: see ``Extractor``."""
    extractor = Extractor(aliases)

    @F.pandas_udf(T.ArrayType(CITATION))
    def run(text: pd.Series) -> pd.Series:
        return text.map(extractor)

    return run


def first_citation(citations: str | Column) -> Column:
    return F.try_element_at(F.col(citations) if isinstance(citations, str) else citations, F.lit(1))


def parse_source(source: str | Column) -> Column:
    """Citation of a source line "<code>: Статья <article>. ч. <part> п. <point>."; null where it has no article."""
    c = F.col(source) if isinstance(source, str) else source
    get = lambda p: F.nullif(F.regexp_extract(c, "(?iu)" + p, 1), F.lit(""))
    article = get(r"стать[яи]\s+([0-9]+(?:\.[0-9]+)*)")
    code = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, r"(?iu)^(.*?)[:,]?\s*стать[яи]\s+[0-9]", 1), r"\s+", " ")), F.lit(""))
    rest = F.regexp_extract(c, r"(?iu)стать[яи]\s+[0-9]+(?:\.[0-9]+)*(.*)$", 1)
    after = lambda p: F.nullif(F.regexp_extract(rest, "(?iu)" + p, 1), F.lit(""))
    part, point = after(r"(?:^|[\s.,])ч(?:\.|асть)\s*([0-9]+(?:\.[0-9]+)*)"), after(r"(?:^|[\s.,])п(?:\.|ункт)\s*([0-9]+(?:\.[0-9]+)*|[а-я])")
    return F.when(article.isNotNull(), F.struct(code.alias("code"), article.alias("article"), part.alias("part"), point.alias("point")))


def article_reference(source: str, citation: str) -> Column:
    """Label of a source line, or of a citation where the line can't be read; blank without an article."""
    c = F.coalesce(parse_source(source), F.col(citation))
    part, point = F.when(c["part"].isNotNull(), F.concat(F.lit("ч. "), c["part"])), F.when(c["point"].isNotNull(), F.concat(F.lit("п. "), c["point"]))
    return F.when(c["article"].isNotNull(), F.concat_ws(" ", c["code"], F.concat(F.lit("ст. "), c["article"]), part, point)).otherwise("")


def resolved_citations(retrieved: str, sources: str = "source", citation: str = "citation") -> Column:
    """Distinct citations of retrieved records (array of structs) that have code and article: parsed source, else the record's own."""
    each = F.transform(F.col(retrieved), lambda r: F.coalesce(parse_source(r[sources]), r[citation]))
    return F.array_distinct(F.filter(each, lambda c: c["code"].isNotNull() & c["article"].isNotNull()))


def citations_json(citations: str) -> Column:
    return F.to_json(F.col(citations))


def by_article(citations: str) -> Column:
    """Map from article to its citations."""
    c = F.col(citations)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(c, lambda x: x["article"])), lambda a: F.struct(a, F.filter(c, lambda x: x["article"].eqNullSafe(a)))))


def article_pattern(article: str) -> str:
    """Pattern of one exact decimal article: 5.35 is neither in 5.35.1 nor in 15.35."""
    return r"(?iu)(?:ст(?:\.|ать[а-яё]+)\s*)" + re.escape(article) + r"(?![0-9]|\.[0-9])"


def cited_in_context(text: str, article: str, code: str, before: int = 300, after: int = 400) -> Column:
    """Whether an exact article is cited with the code's name within the given surroundings."""
    return F.col(text).rlike(rf"(?su)(?:{code}).{{0,{before}}}?{article_pattern(article)[5:]}|{article_pattern(article)[5:]}.{{0,{after}}}?(?:{code})")


def law_numbers(text: str) -> Column:
    """Distinct law numbers in both notations ("№ 123-ФЗ", "N 123-ФЗ"), ascending by value."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?u)[№N]\s*([0-9]+)\s*-\s*ФЗ"), F.lit(1))
    return F.transform(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int")))), lambda n: F.concat(n.cast("string"), F.lit("-ФЗ")))


def register_functions(spark) -> None:
    """Named SQL functions of the engine."""
    from docketry.functions import text, keys

    spark.udf.register("extract_citations", extract_citations())
    spark.udf.register("text_key", keys.text_key)
    spark.udf.register("sentence_records", text.sentence_records)
    spark.udf.register("visible_text", text.visible_text)
    spark.udf.register("strip_tags", text.strip_tags)
