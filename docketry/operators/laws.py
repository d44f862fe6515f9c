"""Federal laws that texts mention: extraction, identity by number, date and title, one representative sentence for each.

Identity is decided on distinct citations, however often a law is cited. Similar titles are found by an exact join: titles
whose sequence ratio reaches 0.8 share a pair of neighbouring letters among the rarest of the shorter one, so pairs meet by
such a pair of letters, and only these are compared. What a reader who goes through the mentions in order would decide
from what came before becomes a pointer to an earlier title (followed by doubling) or a round of decisions on titles
whose earlier likes are all decided; both take few rounds of joins, and no group of titles meets in one task.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.dates import MONTHS
from docketry.functions.text import sentence_records
from docketry.shared import discard, settled

# How laws, their numbers, dates and titles are written.
MENTION = r"федеральн[а-яё]*\s+закон[а-яё]*|(?<!\w)Ф\s*З(?!\w)"
NUMBER = r"(?<![\w.])(?:(?:№|[NН](?:o|о)?\.?)\s*(\d+)\s*[-‐‑‒–—−]?\s*|(\d+)\s*[-‐‑‒–—−]\s*)Ф\s*З(?!\w)"
LAW_WORD = r"закон[а-яё]*|(?<!\w)ФЗ(?!\w)"
DATE = r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)|(?<!\d)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})(?!\d)"
QUOTED = r"[«\"]([^»\"]+)[»\"]"
TITLE_AFTER = r"\s*(?:(?:года|г)\.?\s*)?" + QUOTED
DATE_AFTER, DATE_REACH = r"\s*от\s+", 70
NAMED = r"(?:федеральн[а-яё]*\s+закон[а-яё]*|(?<!\w)ФЗ(?!\w))(?:(?!приказ|указ|постановлен)[^«\"\n]){0,100}[«\"](О[б]?\s+[^»\"\n]+)[»\"]"
NUMBER_BEHIND = r"ФЗ\s*[-№]*\s*(\d+)"
#: Titles that many laws have.
GENERIC = "о внесении"
#: Least ratio of similar titles, and characters from which a title may be known by a part of it.
SIMILAR, LONG = 0.8, 20

_CITED = T.ArrayType(T.StructType().add("at", T.IntegerType()).add("number", T.StringType()).add("date", T.StringType()).add("title", T.StringType()).add("named", T.BooleanType()))


def normal_title(title: str) -> str:
    """Lower case, yo as ye, the country's name written out; letters and digits only."""
    t = re.sub(r"\bрф\b", "российской федерации", title.casefold().replace("ё", "е"))
    return " ".join(re.sub(r"[^а-я0-9 ]", " ", t).split())


def cited(sentence: str | None) -> list[dict]:
    """The laws of a sentence, in order: those with a number (date and title may be blank), then titles without one.

    A number's date and title are sought between the last law named before it and the number: the last date, the first
    title. A date announced right after the number counts before these, a title right after number and date does too.
    """
    s, found = sentence or "", []
    places = {k: list(re.finditer(p, s, re.IGNORECASE)) for k, p in (("law", LAW_WORD), ("date", DATE), ("title", QUOTED))}
    for n, m in enumerate(re.finditer(NUMBER, s, re.IGNORECASE)):
        since = max((x.start() for x in places["law"] if x.end() <= m.start()), default=len(s))
        inside = {k: [x for x in places[k] if since <= x.start() and x.end() <= m.start()] for k in ("date", "title")}
        end, date = m.end(), inside["date"][-1:]
        if re.compile(DATE_AFTER, re.IGNORECASE).match(s, end):
            after = [x for x in places["date"] if end <= x.start() and x.end() <= end + DATE_REACH][:1]
            date, end = after or date, after[0].end() if after else end
        title = re.compile(TITLE_AFTER, re.IGNORECASE).match(s, end) or next(iter(inside["title"]), None)
        day = ""
        for d in date:
            parts = d.groups()
            when = parts[:3] if parts[0] else (parts[3], MONTHS.index(parts[4].lower()) + 1, parts[5])
            day = f"{int(when[0]):02}.{int(when[1]):02}.{when[2]}"
        found.append({"at": n, "number": str(int(m.group(1) or m.group(2))), "date": day, "title": normal_title(title.group(1)) if title else "", "named": False})
    for n, m in enumerate(re.finditer(NAMED, s, re.IGNORECASE)):
        behind = re.search(NUMBER_BEHIND, m.group(), re.IGNORECASE)
        found.append({"at": n, "number": str(int(behind.group(1))) if behind else "", "date": "", "title": normal_title(m.group(1)), "named": True})
    return found


@F.pandas_udf(_CITED)
def laws_cited(sentence: pd.Series) -> pd.Series:
    return sentence.map(cited)


def federal_numbers(text: str | Column) -> Column:
    """Distinct numbers of federal laws in a text, ascending; without a number's dates or titles."""
    pattern = F.lit("(?iuU)" + NUMBER.replace("[NН]", "[NНнn]"))
    digits = F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, pattern, F.lit(0)), lambda x: F.regexp_extract(x, r"\d+", 0).cast("decimal(38,0)"))
    return F.transform(F.array_sort(F.array_distinct(digits)), lambda x: x.cast("string"))


def law_mentions(docs: DataFrame) -> DataFrame:
    """source, sentence_index, sentence, numbers of every sentence of ``docs`` (source, text) that mentions a federal law, repeats included.

    Sentences are numbered from 1 through the whole text; runs of white space are read as one blank.
    """
    each = docs.select("source", F.explode(sentence_records("text")).alias("s")).where(F.col("s.text").rlike("(?iuU)" + MENTION))
    flat = F.trim(F.regexp_replace("s.text", r"(?U)\s+", " "))
    return each.select("source", (F.col("s.index") + 1).alias("sentence_index"), flat.alias("sentence")).withColumn("numbers", federal_numbers("sentence"))


def number_counts(mentions: DataFrame, supplied: DataFrame) -> DataFrame:
    """number, sentences, supplied: sentences that name each law number, and whether ``supplied`` (number) has it."""
    n = mentions.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("sentences"))
    return n.join(supplied.select("number", F.lit(True).alias("supplied")).distinct(), "number", "left").withColumn("supplied", F.coalesce("supplied", F.lit(False)))


# similar titles


@F.pandas_udf(T.BooleanType())
def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the sequence ratio of two texts is at least ``SIMILAR``; bounds from lengths and letters come first."""

    def one(x: str, y: str) -> bool:
        m = difflib.SequenceMatcher(None, x, y)
        return m.real_quick_ratio() >= SIMILAR and m.quick_ratio() >= SIMILAR and m.ratio() >= SIMILAR

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


def _grams(title: Column) -> Column:
    """Each pair of neighbouring letters of a title, repeats included."""
    return F.transform(F.sequence(F.lit(1), F.length(title) - 1), lambda i: F.substring(title, i, F.lit(2)))


def _probes(titles: DataFrame, by: list[str]) -> DataFrame:
    """by, title, gram: the pairs of letters of which a title shares at least one with any similar title that is no shorter.

    With a ratio of 0.8, at most a fifth of the letters of both (L in all) are unmatched, and each gap between matched blocks
    has one of them; so at least 0.2 L - 1 places of pairs are matched, 0.4 l - 1 for a shorter length l. The rarest of its
    l - 1 places, all but so many and one, hold one of these. Titles of two letters or less go by single letters.
    """
    each = titles.select(*by, "title", F.explode(_grams(F.col("title"))).alias("gram")).where(F.length("title") > 2)
    rare = each.groupBy("gram").agg(F.count("*").alias("df"))
    # pairs of an alphabet of 43 signs: fewer than 2,000 rows
    ranked = each.join(F.broadcast(rare), "gram").groupBy(*by, "title").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    n = F.length("title") - F.greatest(F.lit(1), F.ceil(F.length("title") * (2 * SIMILAR - 1.2) - 1).cast("int"))
    some = ranked.select(*by, "title", F.explode(F.array_distinct(F.slice("g", F.lit(1), n)["gram"])).alias("gram"))
    letters = titles.where(F.length("title") <= 2).select(*by, "title", F.explode(F.array_distinct(F.split("title", ""))).alias("gram"))
    return some.unionByName(letters.where("gram <> ''"))


def similar_pairs(a: DataFrame, b: DataFrame, by: list[str], contained: int = 0) -> DataFrame:
    """by, x, y: titles x of ``a`` and y of ``b`` (by, title) that are similar, or of which one holds the other (x of ``contained`` letters or more)."""
    a, b = (t.select(*by, "title").where(F.col("title") != "").distinct() for t in (a, b))

    def index(t: DataFrame, name: str) -> DataFrame:
        short = F.when(F.length("title") > 1, _grams(F.col("title"))).otherwise(F.array().cast("array<string>"))
        return t.select(*by, F.col("title").alias(name), F.explode(F.array_distinct(F.concat(short, F.split("title", "")))).alias("gram"))

    inside = lambda long, short: F.col(long).contains(F.col(short)) & (F.length("x") >= contained)

    def met(probes: DataFrame, name: str, held: DataFrame, other: str, shorter: Column) -> DataFrame:
        both = probes.withColumnRenamed("title", name).join(held, [*by, "gram"])
        near = (F.length(other) <= F.length(name) * (2 / SIMILAR - 1) + 1e-9) | inside(other, name)
        return both.where(shorter & near).select(*by, "x", "y")

    up = met(_probes(a, by), "x", index(b, "y"), "y", F.length("x") <= F.length("y"))
    down = met(_probes(b, by), "y", index(a, "x"), "x", F.length("y") < F.length("x"))
    pairs = up.unionByName(down).distinct()
    return pairs.where(inside("y", "x") | inside("x", "y") | reaches("x", "y"))


def followed(pointers: DataFrame) -> DataFrame:
    """id, root of ``pointers`` (id, to): where each leads in the end; ``to`` is null at a root. Each round doubles the way."""
    now = settled(pointers.select("id", F.coalesce("to", "id").alias("root")))
    if now.where("id <> root").isEmpty():
        return now
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("__next"))
        then = settled(now.join(ahead, "root").select("id", F.col("__next").alias("root"), (F.col("root") != F.col("__next")).alias("moved")))
        discard(now)
        if then.where("moved").isEmpty():
            return then.drop("moved")
        now = settled(then.drop("moved"))
        discard(then)


def leaders(nodes: DataFrame, earlier: DataFrame) -> DataFrame:
    """The ids that somebody who takes ``nodes`` (id) in order would keep, each unless an earlier one that is like it was kept.

    ``earlier``: id, before. In each round those without an undecided earlier like are kept, and their later likes go.
    """
    open_, links, kept = settled(nodes.select("id").distinct()), settled(earlier.select("id", "before").distinct()), []
    if links.isEmpty():
        return open_
    while not open_.isEmpty():
        free = settled(open_.join(links, "id", "left_anti"))
        gone = links.join(free.select(F.col("id").alias("before")), "before", "left_semi").select("id").distinct()
        left = settled(open_.join(free, "id", "left_anti").join(gone, "id", "left_anti"))
        # links to those that went don't count any more
        rest = settled(links.join(left, "id", "left_semi").join(left.select(F.col("id").alias("before")), "before", "left_semi").select("id", "before"))
        discard(open_, links)
        open_, links = left, rest
        kept.append(free)
    discard(links)
    out = open_
    for k in kept:
        out = out.unionByName(k)
    return out


# representatives


def representative_mentions(mentions: DataFrame) -> DataFrame:
    """source, sentence_index, sentence, law_labels: one sentence of ``mentions`` (source, sentence_index, sentence) for each law.

    A law is a number within a year. Dates of one number whose citations have similar titles are one law, as are citations
    without a date if the number has one date, or one named law, only; of several, a bare number names none. Titles
    without a number are laws of their own unless they are like a numbered or an earlier one. Dated citations represent a law
    before others, then the first one does. Mentions that name no law are left out.
    """
    pos = F.struct("source", "sentence_index", "c.at")
    found = settled(mentions.select("source", "sentence_index", F.explode(laws_cited("sentence")).alias("c")).select(pos.alias("pos"), "c.number", "c.date", "c.title", "c.named"))
    told = found.where("not named").groupBy("number", "date", "title").agg(F.min("pos").alias("pos"))
    # the order in which citations are gone through: dated ones first
    told = settled(told.withColumn("turn", F.struct((F.col("date") == "").alias("undated"), "pos")))

    # dates of a number that are one law by their titles
    titled = told.where((F.col("title") != "") & ~F.startswith("title", F.lit(GENERIC)))
    law = titled.groupBy("number", "date").agg(F.min("pos").alias("first")).withColumn("turn", F.struct((F.col("date") == "").alias("undated"), F.col("first").alias("pos")))
    law = law.withColumn("id", F.concat_ws(" ", "number", "date"))
    of = titled.join(law.select("number", "date", "id", "first", F.col("turn").alias("law_turn")), ["number", "date"])
    x, y = (of.select("number", F.col("title").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("id", "first", "law_turn"))) for k in "xy")
    several = law.groupBy("number").count().where("count > 1").select("number")  # only these have anything to compare
    pairs = similar_pairs(*(titled.join(several, "number", "left_semi") for _ in range(2)), ["number"])
    before = pairs.join(x, ["number", "x"]).join(y, ["number", "y"]).where(F.col("y_law_turn") < F.col("x_law_turn"))
    parent = before.groupBy(F.col("x_id").alias("id")).agg(F.min_by("y_id", "y_first").alias("to"))
    roots = followed(law.select("id").join(parent, "id", "left"))
    canonical = settled(law.select("number", "date", "id").join(roots, "id").select("number", "date", F.split("root", " ", 2)[1].alias("law_date")))

    dates = told.where("date <> ''").groupBy("number").agg(F.count_distinct("date").alias("dates"), F.min("date").alias("only_date"))
    names = canonical.groupBy("number").agg(F.count_distinct("law_date").alias("names"), F.min("law_date").alias("only_law"))
    cites = told.join(canonical, ["number", "date"], "left").join(dates, "number", "left").join(names, "number", "left")
    by_name = F.coalesce("law_date", F.when((F.col("names") == 1) & (F.col("title") == ""), F.col("only_law")))
    cites = cites.where(~((F.col("date") == "") & (F.coalesce("dates", F.lit(0)) > 1) & by_name.isNull()))
    filled = F.when(F.col("date") != "", F.col("date")).when(F.col("dates") == 1, F.col("only_date")).otherwise("")
    cites = settled(cites.select("number", "title", "turn", F.coalesce(by_name, filled).alias("law_date")))
    # a number is one law within a year, under the date that comes first; without a date it is one of its own
    year = F.right("law_date", F.lit(4))
    laws = cites.groupBy("number", year.alias("year")).agg(F.min_by("law_date", "turn").alias("law_date"), F.min("turn").alias("turn"))
    label = F.concat("number", F.lit("-ФЗ"), F.when(F.col("law_date") != "", F.concat(F.lit(" от "), "law_date")).otherwise(""))
    numbered = laws.select(label.alias("label"), F.struct(F.lit(0).alias("stage"), F.col("turn.undated").alias("undated"), F.col("turn.pos").alias("pos")).alias("order"))

    # titles without a number
    alias = cites.where("title <> ''").select("title").distinct()
    bare = found.where("named").join(cites.select("number").distinct(), "number", "left_anti").join(alias, "title", "left_anti")
    bare = settled(bare.groupBy("title").agg(F.min("pos").alias("pos")))
    own = bare.where(~F.startswith("title", F.lit(GENERIC)))
    plain = alias.where(~F.startswith("title", F.lit(GENERIC)))
    known = similar_pairs(own, plain, [], LONG).select(F.col("x").alias("title")).distinct()
    fresh = settled(own.join(known, "title", "left_anti"))
    each = [fresh.select(F.col("title").alias(k), F.col("pos").alias(f"{k}_pos")) for k in "xy"]
    like = similar_pairs(fresh, fresh, [], LONG).where("x <> y").join(each[0], "x").join(each[1], "y").where(F.col("y_pos") < F.col("x_pos"))
    first = leaders(fresh.select(F.col("title").alias("id")), like.select(F.col("x").alias("id"), F.col("y").alias("before")))
    chosen = bare.where(F.startswith("title", F.lit(GENERIC))).unionByName(fresh.join(first.withColumnRenamed("id", "title"), "title"))
    titles = chosen.select(F.col("title").alias("label"), F.struct(F.lit(1).alias("stage"), F.lit(False).alias("undated"), "pos").alias("order"))

    both = numbered.unionByName(titles).withColumn("at", F.col("order.pos"))
    labels = both.groupBy(F.col("at.source").alias("source"), F.col("at.sentence_index").alias("sentence_index")).agg(F.array_sort(F.collect_list(F.struct("order", "label")))["label"].alias("law_labels"))
    return mentions.join(labels, ["source", "sentence_index"]).select("source", "sentence_index", "sentence", "law_labels")
