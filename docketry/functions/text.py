"""Texts: sections, sentences with offsets, audited filters, pages, snippets, prompts."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import rules
from docketry.schemas import LABELS, SENTENCE

NBSP = " "


@dataclass(frozen=True)
class Reason:
    """Why a sentence is dropped: the pattern it has to hold, or to be ``whole``; substantive wording may keep it."""

    name: str
    pattern: str
    whole: bool = False
    overridable: bool = False


@dataclass(frozen=True)
class Lexicon:
    """Wording that the filters look for; patterns ignore case unless noted.

    Every operator takes a lexicon, so that they run on other texts than rulings as well.
    """

    section_marker: str = "(?iu)" + rules.OPERATIVE
    substantive: str = rules.SUBSTANTIVE
    reasons: tuple[Reason, ...] = (
        Reason("judge_signature", f"{rules.SIGNATURE}|{rules.SIGNATURE_CONTINUED}", whole=True, overridable=True),
        Reason("masked_only", rules.MASKED, whole=True),
        Reason("numeric_only", rules.NUMERIC, whole=True),
        Reason("non_legal_boilerplate", rules.BOILERPLATE, whole=True),
        Reason("bank_or_payment_details", rules.PAYMENT_TITLE),
        Reason("bank_or_payment_details", f"{rules.BANK_SIGN}|{rules.BANK_START}", overridable=True),
        Reason("payment_receipt_instruction", rules.RECEIPT, overridable=True),
    )
    #: Reasons after which a sentence may carry a block on, and what such a sentence is as a whole.
    opening: tuple[str, ...] = ("bank_or_payment_details", "numeric_only", "masked_only")
    continuation: str = rules.BANK_CONTINUED
    #: Parts of the lower-cased sentence, and patterns with regard to case, that make it irrelevant.
    irrelevant_parts: tuple[str, ...] = rules.IRRELEVANT_PARTS
    irrelevant_signs: str = rules.IRRELEVANT_SIGNS
    irrelevant_numbers: str = rules.IRRELEVANT_NUMBERS
    hints: dict[str, tuple[str, ...]] = field(default_factory=dict)


LEGAL = Lexicon()
ENGLISH = Lexicon(
    section_marker=r"R\s*U\s*L\s*I\s*N\s*G\s*:", substantive=r"orders|dismiss|grant|deny",
    reasons=(
        Reason("judge_signature", r"^\s*(judge|clerk)\b|signed", overridable=True), Reason("masked_only", r"[\s*_.<>\[\]-]{3,}|\[redacted\]", whole=True), Reason("numeric_only", rules.NUMERIC, whole=True),
        Reason("bank_or_payment_details", r"(?<!\w)(?:IBAN|BIC|SWIFT|ACCT)(?!\w)", overridable=True), Reason("payment_receipt_instruction", r"receipt|payment details", overridable=True),
    ), continuation=r"(account|bank|code|number)\b.*", irrelevant_parts=("licensed", "copyright"), irrelevant_signs=r"(?<!\w)(?:IBAN|BIC|SWIFT|ACCT)(?!\w)",
)


def _ci(pattern: str) -> str:
    """Java needs both flags: case folding is ASCII-only without the second."""
    return "(?iu)" + pattern


# sections and sentences


def final_section(text: str | Column, marker: str) -> Column:
    """Text after the last marker, or null."""
    pattern, text = r"(?s)^.*(?:" + marker + r")(.*)$", F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("(?s)(?:" + marker + ")"), F.regexp_extract(text, pattern, 1))


def operative_section(text: str | Column, lexicon: Lexicon = LEGAL) -> Column:
    """The final section without blanks around it; null if there is none or nothing in it."""
    section = F.regexp_replace(final_section(text, lexicon.section_marker), r"(?U)^\s+|\s+$", "")
    return F.nullif(section, F.lit(""))


_ABBREVIATIONS = {"отд", "ст", "ч", "п", "пп", "г", "гг", "руб", "коп", "т", "д", "др", "см", "рис", "стр", "ред", "им", "ул", "кв", "no", "art", "mr", "mrs", "dr", "vs", "etc", "e", "i", "p"}
_LINES = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_END = re.compile(rf"[.!?…]+[»\")\]]*\s+|[{_LINES}]+")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: cut between lines, and after final marks before a new start, never after an abbreviation or initial."""
    out, start = [], 0
    for m in _END.finditer(text):
        if not any(c in _LINES for c in m.group()):
            before = re.search(r"(\w+)$", text[start : m.start()])
            word = before.group(1) if before else ""
            after = text[m.end() : m.end() + 1]
            if text[m.start()] == "." and (word.casefold() in _ABBREVIATIONS or (len(word) == 1 and word.isalpha() and word.isupper())):
                continue
            if after and after.islower():
                continue
        out.append((start, m.end()))
        start = m.end()
    out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        piece = text[a:b]
        body = piece.strip()
        if body:
            a += len(piece) - len(piece.lstrip())
            trimmed.append((a, a + len(body)))
    return trimmed


@F.pandas_udf(T.ArrayType(SENTENCE))
def sentence_records(text: pd.Series) -> pd.Series:
    """Sentences with half-open code-point offsets: text[start:end] is the sentence. Null for null."""
    return text.map(lambda t: None if t is None else [{"index": k, "text": t[a:b], "start": a, "end": b} for k, (a, b) in enumerate(split_sentences(t))])


def simple_sentences(text: str | Column) -> Column:
    """Sentences cut after . ! ? before white space only; what SQL can express."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])[ \t\r\n]+", "$1\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")


# filters


def irrelevant(sentence: str | Column, lexicon: Lexicon = LEGAL) -> Column:
    """Parts of words, signs that aren't part of a word (with regard to case), or nothing but numbers."""
    c = F.col(sentence) if isinstance(sentence, str) else sentence
    parts = F.exists(F.array(*map(F.lit, lexicon.irrelevant_parts)), lambda m: F.contains(F.lower(c), m))
    numbers = F.regexp_replace(c, r"(?U)^\s+|\s+$", "").rlike(rules.java(lexicon.irrelevant_numbers, whole=True, cased=True))
    return parts | c.rlike(rules.java(lexicon.irrelevant_signs, cased=True)) | numbers


def collapsed(c: Column) -> Column:
    """White space as single blanks, none around."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def drop_reason(sentence: str | Column, lexicon: Lexicon = LEGAL) -> Column:
    """First reason to drop a sentence, null to keep it; blanks are collapsed first."""
    c = collapsed(F.col(sentence) if isinstance(sentence, str) else sentence)
    plain = ~c.rlike(rules.java(lexicon.substantive))
    out = F.when(c == "", "empty")
    for r in lexicon.reasons:
        here = c.rlike(rules.java(r.pattern, r.whole))
        out = out.when(here & plain if r.overridable else here, r.name)
    return out


def block_continuation(
    rows: DataFrame, by: str, order: str, reason: str = "reason", sentence: str = "sentence", continuation: str = rules.java(LEGAL.continuation, whole=True), opening: tuple[str, ...] = LEGAL.opening, name: str = "bank_block_continuation",
) -> DataFrame:
    """After a sentence dropped for an ``opening`` reason, sentences that carry it on are dropped too, for the reason ``name``.

    One window: a kept sentence that matches ``continuation`` goes if the nearest sentence before it that isn't such a one was
    a drop of these kinds.
    """
    kind = F.when(F.col(reason).isin(*opening), "D").when(F.col(reason).isNotNull(), "O").when(collapsed(F.col(sentence)).rlike(continuation), "C").otherwise("K")
    df = rows.withColumn("__k", kind)
    last = F.last(F.when(F.col("__k") != "C", F.col("__k")), ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("__l", last).withColumn(reason, F.when((F.col("__k") == "C") & (F.col("__l") == "D"), name).otherwise(F.col(reason))).drop("__k", "__l")


def extract_hypotheses(docs: DataFrame, lexicon: Lexicon = LEGAL) -> DataFrame:
    """doc_id, index, sentence, start, end, kept, reason of the final section's sentences; offsets are those of the whole text.

    A document without a marker gives no row; ``documents_without_section`` lists these.
    """
    pattern = re.compile(lexicon.section_marker)

    @F.pandas_udf("array<struct<index:int,text:string,start:int,end:int>>")
    def tail(text: pd.Series) -> pd.Series:
        def one(t):
            last = None
            for m in pattern.finditer(t or ""):
                last = m
            if last is None:
                return None
            return [{"index": k, "text": t[last.end() + a : last.end() + b], "start": last.end() + a, "end": last.end() + b} for k, (a, b) in enumerate(split_sentences(t[last.end() :]))]

        return text.map(one)

    rows = docs.select("doc_id", F.explode(tail("text")).alias("s")).select("doc_id", "s.index", F.col("s.text").alias("sentence"), "s.start", "s.end")
    rows = block_continuation(rows.withColumn("reason", drop_reason("sentence", lexicon)), "doc_id", "index", continuation=rules.java(lexicon.continuation, whole=True), opening=lexicon.opening)
    return rows.withColumn("kept", F.col("reason").isNull())


def documents_without_section(docs: DataFrame, lexicon: Lexicon = LEGAL) -> DataFrame:
    return docs.where(~F.coalesce(F.col("text").rlike("(?s)(?:" + lexicon.section_marker + ")"), F.lit(False))).select("doc_id")


# pages


_BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer hr td th title".split())
_UNSEEN = frozenset(("script", "style"))


class _Events(HTMLParser):
    """A page as a list of (kind, value): tags that open or close, and text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.handle_data = lambda data: self.found.append(("text", data))
        self.handle_starttag = lambda tag, attrs: self.found.append(("open", tag))
        self.handle_endtag = lambda tag: self.found.append(("close", tag))


def visible(page: str | None) -> str | None:
    """Visible text: no scripts and styles, a line for each block, blanks collapsed."""
    if page is None:
        return None
    events = _Events()
    events.feed(page)
    events.close()
    lines, depth = [""], 0
    for kind, value in events.found:
        if kind == "text":
            lines[-1] += value if depth == 0 else ""
            continue
        if value in _UNSEEN:
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif value in _BLOCKS:
            lines.append("")
    folded = (" ".join(line.replace(NBSP, " ").split()) for text in lines for line in text.split("\n"))
    return "\n".join(line for line in folded if line)


@F.pandas_udf(T.StringType())
def visible_text(page: pd.Series) -> pd.Series:
    return page.map(visible)


def visible_text_sql(page: str | Column) -> Column:
    """Like ``visible_text`` by patterns alone: entities other than five stay, and all on one line."""
    c = F.col(page) if isinstance(page, str) else page
    c = F.regexp_replace(c, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def page_body(page: str, start_marker: str, end_markers: tuple[str, ...]) -> Column:
    """Between the first start marker and the earliest end marker after it; null without start marker."""
    c = F.col(page)
    after = F.substring(c, F.locate(start_marker, c) + len(start_marker), F.length(c))
    ends = [F.when(F.locate(m, after) > 0, F.locate(m, after)) for m in end_markers]
    end = F.least(*ends, F.length(after) + 1) if ends else F.length(after) + 1
    return F.when(F.locate(start_marker, c) > 0, F.substring(after, F.lit(1), end - 1))


@F.pandas_udf(T.StringType())
def strip_tags(fragment: pd.Series) -> pd.Series:
    """Without tags, entities resolved, white space collapsed."""
    return fragment.map(lambda t: None if t is None else " ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).replace(NBSP, " ").split()))


def concordance(text: str | Column, pattern: str, before: int, after: int, behind: str | None = None, reach: int = 0, cased: bool = False) -> Column:
    """array of struct(hit, passage): every match with the characters around it; ``behind`` has to match in the ``reach`` characters before it."""
    found, led = (re.compile(x, 0 if cased else re.IGNORECASE) if x else None for x in (pattern, behind))

    def lines(t: str | None) -> list[dict]:
        hits = (m for m in found.finditer(t or "") if not led or led.search(t, max(0, m.start() - reach), m.start()))
        return [{"hit": m.group(), "passage": t[max(0, m.start() - before) : m.end() + after]} for m in hits]

    return F.pandas_udf(lambda texts: texts.map(lines), "array<struct<hit:string,passage:string>>")(text)


def snippet(text: str, start: Column, end: Column, radius: int) -> Column:
    """The surroundings of [start, end), with ellipses where text is left out."""
    lo, hi = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(F.col(text)))
    return F.concat(F.when(lo > 0, "…").otherwise(""), F.substring(F.col(text), lo + 1, hi - lo), F.when(hi < F.length(F.col(text)), "…").otherwise(""))


def fold_yo(text: str | Column) -> Column:
    """Ё and ё as Е and е, white space collapsed."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.translate(c, "Ёё" + NBSP, "Ее "), r"\s+", " "))


def case_number(text: str) -> Column:
    """First of two notations of a case number, without final punctuation; blank if none."""
    c = F.col(text)
    first = F.regexp_extract(c, _ci(r"дело\s*№?\s*([0-9А-ЯA-Z][0-9А-ЯA-Z./-]*)"), 1)
    second = F.regexp_extract(c, r"№\s*([0-9][0-9А-ЯA-Z./-]*)", 1)
    return F.regexp_replace(F.when(first != "", first).otherwise(second), r"[./-]+$", "")


# prompts and labels


def chat_messages(system: str | Column, user: str | Column, context: str | Column | None = None, answer: str | Column | None = None) -> Column:
    """array<struct<role, content>>: system, user (with context before it), and the answer where it is given."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    text = col(user) if context is None else F.when(F.coalesce(col(context), F.lit("")) != "", F.concat(col(context), F.lit("\n\n"), col(user))).otherwise(col(user))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    out = F.array(turn("system", col(system)), turn("user", text))
    return out if answer is None else F.when(col(answer).isNull(), out).otherwise(F.concat(out, F.array(turn("assistant", col(answer)))))


def parse_label(raw: str | Column) -> Column:
    """The one label that a model's output names outside its thinking, null if none or several."""
    c = F.col(raw) if isinstance(raw, str) else raw
    c = F.regexp_replace(F.lower(c), r"(?s)<think>.*?</think>", " ")
    there = [c.rlike(r"(^|[^a-z])" + label.replace(" ", r"\s+") + r"($|[^a-z])") for label in LABELS]
    count = sum((t.cast("int") for t in there), F.lit(0))
    out = F.when(there[0], LABELS[0])
    for t, label in zip(there[1:], LABELS[1:], strict=True):
        out = out.when(t, label)
    return F.when(count == 1, out)


def model_premise(premise: str, source: str) -> Column:
    """Premise with its source before it, once."""
    return F.when(F.startswith(F.col(premise), F.col(source)), F.col(premise)).otherwise(F.concat_ws("\n", F.nullif(F.col(source), F.lit("")), F.col(premise)))


def without_prefix(text: str, prefix: str) -> Column:
    """Text without a repeated article prefix, whatever its case."""
    t, p = F.col(text), F.col(prefix)
    return F.when((F.length(p) > 0) & F.startswith(F.lower(t), F.lower(p)), F.ltrim(F.substring(t, F.length(p) + 1, F.length(t)))).otherwise(t)


def hint_terms(text: str, hints: dict[str, tuple[str, ...]]) -> Column:
    """Tokens whose trigger phrases the text holds, in order of the table."""
    c = F.lower(F.col(text))
    out = [F.when(F.contains(c, F.lit(k)), F.array(*map(F.lit, v))) for k, v in hints.items()]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*out)))) if out else F.array().cast("array<string>")


def chunks(text: str, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters that overlap by ``overlap``; one for a short text, none for an empty one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be less than size")
    n = F.length(F.col(text))
    starts = F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def query_text(instruction: str, query: str) -> Column:
    """A query with its instruction once in front; null for a blank one (to be rejected)."""
    q = F.trim(F.col(query))
    return F.when(q == "", F.lit(None)).when(F.startswith(q, F.lit(instruction)), q).otherwise(F.concat(F.lit(instruction), q))


def numbers_named(text: str, pattern: str, group: int = 1) -> Column:
    """Distinct numbers that a pattern finds, ascending by value."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(found))
