"""Provisions of large structured texts: which section, chapter, article, part, point or note each paragraph belongs to.

Everything that reading in order would keep in mind is here "the last paragraph of a kind so far": the last article heading, the last
part, the last note. What is open at a paragraph follows from comparing these places: a part is open if it came after the article's
heading, an article if it came after the chapter's. Last places are maxima, and maxima of ranges combine, so paragraphs are dealt in
ranges of (path, index), whatever the documents' lengths, and each range takes one row over from those before it (``carried``).

``place`` gives one narrow row for each paragraph; ``units``, ``notes``, ``audit`` and ``faults`` are joins and aggregations of these rows,
and only ``units`` and ``notes`` read texts.

Edge cases: a null path is the document ''; null and blank texts are of kind ``blank``; repeated (path, index) and negative or null
indices are faults and the former keep a row each; an empty table gives empty results; further columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.functions import rules
from docketry.functions.keys import unit_id
from docketry.schemas import violations
from docketry.shared import settled

# Forms of headings and markers, on text with single blanks.
_NUMBER = r"\d+(?:[.-]\d+)*"
_SECTION = r"(?iu)^раздел ([ivxlc]+|\d+)\."
_CHAPTER = rf"(?iu)^глава ({_NUMBER})\."
_ARTICLE = rf"(?iu)^статья ({_NUMBER}(?: \d+)*)\.(?: |(?=[^\d ])|$)"
_PART, _POINT = rf"^({_NUMBER})\.\s+", rf"^({_NUMBER})\)\s+"
_NOTE = r"(?iu)^\s*примечани(е|я)\s*[.:]\s*"
_LETTER = r"(?iu)^[а-я]\) "
_INACTIVE = r"(?:утратил[аои]?\s+силу|не\s+применяется(?![\p{L}\d_]))"
_CHANGE, _CLOSING = "информация об изменениях", "Президент"
_VERSION = ("Информация о версии", "Информация об изменениях")
_SHARED, _OF_THE_LAST = "Кроме того,", "данное обстоятельство"

_KEY = ["path", "index"]
_NODE = ["path", "article_at", "part_at", "point_at"]
_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def carried(df: DataFrame, order: list[str], events: dict[str, Column], strict: bool = False) -> DataFrame:
    """``df`` with, for each event, its last value so far in ``order`` (``strict``: before the row).

    An event is a struct that begins with the columns of ``order``, null where it doesn't happen. Rows are dealt in ranges; of
    each range one row of last values goes to the ranges after it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, event in events.items():
        df = df.withColumn(f"__{name}", event)
    dealt = settled(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    last = dealt.groupBy("__p").agg(*(F.max(f"__{e}").alias(e) for e in events))  # a row for each range: at most n
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    start = last.select("__p", *(F.max(e).over(before).alias(f"__from_{e}") for e in events))
    here = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    rows = dealt.select("*", *(F.max(f"__{e}").over(here).alias(f"__here_{e}") for e in events)).join(F.broadcast(start), "__p")
    return rows.select(*(c for c in df.columns if not c.startswith("__")), *(F.coalesce(f"__here_{e}", f"__from_{e}").alias(e) for e in events))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def _marked(paragraphs: DataFrame) -> DataFrame:
    """What a paragraph is by its own text and style alone."""
    x, own = F.col("__x"), lambda p: F.regexp_extract("__x", p, 1)
    mark = (
        F.when(x == "", "blank").when(x == _CLOSING, "closing").when(F.lower(x).startswith(_CHANGE), "change").when(F.col("style").isin(*_VERSION), "version").when(F.col("style").isin(*rules.EDITORIAL), "comment")
        .when(x.rlike(_SECTION), "section").when(x.rlike(_CHAPTER), "chapter").when(x.rlike(_ARTICLE), "article").when(x.rlike(_NOTE), "note").when(x.rlike(_PART), "part").when(x.rlike(_POINT), "point").otherwise("text")
    )
    body = F.regexp_replace("__x", _NOTE, "")
    m = F.col("mark")
    number = F.when(m == "section", own(_SECTION)).when(m == "chapter", own(_CHAPTER)).when(m == "article", F.replace(own(_ARTICLE), F.lit(" "), F.lit("."))).when(m == "part", own(_PART)).when(m == "point", own(_POINT))
    number = number.when((m == "note") & (F.lower(own(_NOTE)) == "я"), F.regexp_extract(body, _PART, 1)).otherwise("")
    idle = lambda before: x.rlike(f"(?iu)^{before}{_INACTIVE}")
    rows = paragraphs.select(F.coalesce("path", F.lit("")).alias("path"), F.col("index").cast("long").alias("index"), F.coalesce("style", F.lit("")).alias("style"), F.coalesce(_plain(F.col("text")), F.lit("")).alias("__x"))
    rows = rows.withColumn("mark", mark)
    return rows.select(
        *_KEY, "style", "mark", number.alias("number"),
        F.when(m == "article", F.regexp_replace("__x", _ARTICLE, "").rlike(f"(?iu)^{_INACTIVE}")).when(m == "note", body.rlike(rf"(?iu)^(?:{_NUMBER}\.\s+)?{_INACTIVE}"))
        .otherwise(idle(rf"(?:{_NUMBER}[.)]\s+)?") & m.isin("part", "point") | idle("")).alias("idle"),
        (F.lower(own(_NOTE)) == "я").alias("plural"), ((m == "note") & (body != "")).alias("body"),
        F.when(x.startswith(_SHARED), "shared").when(x.rlike(_LETTER), "letter").when(F.contains(F.lower(x), F.lit(_OF_THE_LAST)), "last").otherwise("").alias("tail"),
    )


def place(paragraphs: DataFrame) -> DataFrame:
    """One row for each of ``paragraphs`` (path, index, text, style), written to the shared folder.

    kind, context_assignment, fault (null: none) and idle (its own words say it is repealed); section_at .. point_at and note_at, block_at are the indices of
    the paragraphs that open what this one belongs to, -1 for none, and section .. note their numbers; notice_at of amendments.
    """
    rows, m = _marked(paragraphs), F.col("mark")
    happens = lambda cond, *more: F.when(cond, F.struct(*_KEY, *more))
    texts = ("section", "chapter", "article", "note", "part", "point", "text")
    c = carried(rows, _KEY, {
        **{f"c_{k}": happens(m == k, "number") for k in ("section", "chapter")}, **{f"c_{k}": happens(m == k, "number", "idle") for k in ("article", "part", "point")},
        "c_note": happens(m == "note", "number", "idle", "plural", "body"), "c_change": happens(m == "change"), "c_text": happens(m.isin(*texts)), "c_closing": happens(m == "closing"),
    })
    for k in ("section", "chapter", "article", "part", "point", "note", "change", "text", "closing"):
        c = c.withColumn(f"{k}_at", F.when(F.col(f"c_{k}.path") == F.col("path"), F.col(f"c_{k}.index")).otherwise(-1).cast("long"))
    at = lambda k: F.col(f"{k}_at")
    c = c.withColumn("chapter_at", F.when(at("chapter") > at("section"), at("chapter")).otherwise(-1)).withColumn("article_at", F.when(at("article") > F.greatest("section_at", "chapter_at"), at("article")).otherwise(-1))
    open_, notes = at("article") >= 0, F.col("in_notes")
    c = c.withColumn("in_notes", open_ & (at("note") > at("article"))).withColumn("numbered", notes & F.col("c_note.plural") & (at("part") > at("note")))
    c = c.withColumn("note_on", F.when(F.col("numbered"), at("part")).when(notes & F.col("c_note.body"), at("note")).otherwise(-1))
    c = c.withColumn("part_on", F.when(open_ & ~notes & (at("part") > at("article")), at("part")).otherwise(-1)).withColumn("point_on", F.when(open_ & ~notes & (at("point") > F.greatest("article_at", "part_on")), at("point")).otherwise(-1))
    kind = (
        F.when(m == "blank", "blank").when(at("closing") >= 0, "signature").when((m == "change") | (m == "version") & (at("change") > at("text")), "amendment")
        .when(m.isin("version", "comment"), F.when(open_ | (at("section") >= 0), "commentary").otherwise("front_matter"))
        .when((m == "article") & F.col("idle"), "inactive_article_heading").when(m.isin("section", "chapter", "article"), F.concat(m, F.lit("_heading")))
        .when(~open_, "front_matter").when((m == "note") & ~F.col("body"), "note_heading").when(notes, "note").otherwise("legal_text")
    )
    c = c.withColumn("kind", kind)
    legal, note = F.col("kind") == "legal_text", F.col("kind") == "note"
    after = legal & (F.col("point_on") >= 0) & (m == "text")
    tail = F.when(after, F.col("tail"))
    number = lambda k, cond: F.when(cond, F.col(f"c_{k}.number")).otherwise("").alias(k)
    out = c.select(
        *_KEY, "style", "kind", "mark", "idle", F.when(tail == "shared", "shared_list_closing_rule").when(tail == "last", "point_specific_continuation").alias("context_assignment"),
        F.when(tail == "", "a paragraph after a list may belong to all points or to the last").when(note & (F.col("note_on") < 0), "a numbered note has to follow").alias("fault"),
        "section_at", number("section", at("section") >= 0), "chapter_at", number("chapter", at("chapter") >= 0), "article_at", number("article", open_),
        F.when(legal, F.col("part_on")).otherwise(-1).alias("part_at"), number("part", legal & (F.col("part_on") >= 0)),
        F.when(legal & ~F.coalesce(tail == "shared", F.lit(False)), F.col("point_on")).otherwise(-1).alias("point_at"), number("point", legal & (F.col("point_on") >= 0) & ~F.coalesce(tail == "shared", F.lit(False))),
        F.when(note, F.col("note_on")).otherwise(-1).alias("note_at"), F.when(note, F.when(F.col("numbered"), F.col("c_part.number")).otherwise(F.col("c_note.number"))).otherwise("").alias("note"),
        F.when(notes, at("note")).otherwise(-1).alias("block_at"), F.when(F.col("kind") == "amendment", at("change")).otherwise(-1).alias("notice_at"),
        (open_ & F.col("c_article.idle")).alias("article_idle"), (legal & (F.col("part_on") >= 0) & F.col("c_part.idle")).alias("part_idle"), (legal & (F.col("point_on") >= 0) & F.col("c_point.idle")).alias("point_idle"),
        (note & F.when(F.col("numbered"), F.col("c_part.idle")).otherwise(F.col("c_note.idle"))).alias("note_idle"),
    )
    return settled(out)


def _legal(placed: DataFrame) -> DataFrame:
    """Paragraphs of the law with ``gone``: they stand in something that is repealed."""
    legal = placed.where("kind = 'legal_text'")
    first = legal.where("part_at < 0 AND point_at < 0").groupBy("path", "article_at").agg(F.min_by("idle", "index").alias("__gone")).where("__gone")
    own = F.col("article_idle") | F.col("part_idle") | F.col("point_idle") & (F.col("point_at") >= 0)
    return legal.join(first, ["path", "article_at"], "left").withColumn("gone", own | F.coalesce("__gone", F.lit(False))).drop("__gone")


def _leaves(legal: DataFrame, code: str) -> DataFrame:
    """The smallest numbered units that are in force: their node's key, numbers, places and first paragraph."""
    facts = ["article", "part", "point", "section", "section_at", "chapter", "chapter_at", "gone"]
    nodes = legal.groupBy(*_NODE).agg(F.min("index").alias("first"), *(F.first(c).alias(c) for c in facts))
    listed = nodes.where("point_at >= 0").select("path", "article_at", "part_at").distinct()
    split = nodes.where("part_at >= 0 OR point_at >= 0").select("path", "article_at").distinct()
    points, parts = nodes.where("point_at >= 0"), nodes.where("point_at < 0 AND part_at >= 0").join(listed, ["path", "article_at", "part_at"], "left_anti")
    whole = nodes.where("point_at < 0 AND part_at < 0").join(split, ["path", "article_at"], "left_anti")
    all_ = points.unionByName(parts.select(*nodes.columns)).unionByName(whole.select(*nodes.columns))
    return all_.where(~F.col("gone")).drop("gone").withColumn("unit_id", unit_id(code=F.lit(code), article="article", part="part", point="point"))


def _members(legal: DataFrame, leaves: DataFrame) -> DataFrame:
    """Paragraphs of each unit: its own and those of the part and the article above it; ``turn`` 0 before, 1 own, 2 after."""
    rows = legal.where(~F.col("gone")).select(*_NODE, "index", "mark")
    unit = leaves.select(*_NODE, "unit_id", "first")
    above = lambda level, on: unit.where(level).join(rows.where("point_at < 0" + ("" if "part_at" in on else " AND part_at < 0")).drop(*(c for c in _NODE if c not in on)), on)
    own = unit.join(rows, _NODE).withColumn("turn", F.lit(1))
    turn = F.when(F.col("index") < F.col("first"), 0).otherwise(2)
    parts = above("point_at >= 0 AND part_at >= 0", ["path", "article_at", "part_at"])
    articles = above("point_at >= 0 OR part_at >= 0", ["path", "article_at"])
    names = [*_NODE, "unit_id", "first", "index", "mark", "turn"]
    return reduce(DataFrame.unionByName, (own.select(*names), *(d.withColumn("turn", turn).select(*names) for d in (parts, articles))))


def _notices(paragraphs: DataFrame, placed: DataFrame) -> DataFrame:
    """Notices of changes with what they are about: path, scope, at, notice_at, said, ids.

    A notice is about the next heading, note or paragraph of the law; both have the same such paragraph before them, which is what they
    are joined on.
    """
    takes = F.col("kind").isin("section_heading", "chapter_heading", "article_heading", "inactive_article_heading", "note", "note_heading", "legal_text")
    k = F.col("kind")
    scope = F.when(k == "section_heading", "section").when(k == "chapter_heading", "chapter").when(k == "note", "note").when(k == "note_heading", "block").when(F.col("point_at") >= 0, "point").when(F.col("part_at") >= 0, "part").otherwise("article")
    where = reduce(lambda a, s: a.when(F.col("scope") == s, F.col(f"{s}_at")), ("section", "chapter", "note", "block", "point", "part"), F.when(F.col("scope") == "article", F.col("article_at")))
    slim = placed.where(takes | (k == "amendment")).withColumn("scope", scope).select(*_KEY, takes.alias("takes"), "scope", where.alias("at"), "notice_at")
    c = carried(slim, _KEY, {"c_taker": F.when(F.col("takes"), F.struct(*_KEY))}, strict=True)
    c = c.withColumn("since", F.when(F.col("c_taker.path") == F.col("path"), F.col("c_taker.index")).otherwise(-1))
    said = placed.where("notice_at >= 0").select(*_KEY, "notice_at").join(_texts(paragraphs), _KEY).groupBy("path", "notice_at").agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("s"))
    heads = c.where("NOT takes AND notice_at = index").select("path", "since", "notice_at")
    found = heads.join(c.where("takes").select("path", "since", "scope", "at"), ["path", "since"])
    return found.join(said, ["path", "notice_at"]).select("path", "scope", "at", "notice_at", F.array_join(F.col("s.text"), "\n").alias("said"), F.col("s.index").alias("ids"))


def _changes(of: DataFrame, notices: DataFrame, key: list[str], scopes: list[str]) -> DataFrame:
    """key, changes, amendment_paragraph_ids: notices of all that ``of`` stands in, from the outermost, each wording once."""
    each = of.select(*key, F.posexplode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(f"{s}_at").alias("at")) for s in scopes)))).select(*key, "pos", "col.*").where("at >= 0")
    got = each.join(notices, ["path", "scope", "at"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "notice_at", "said", "ids"))).alias("n"))
    return got.select(*key, F.array_join(F.array_distinct("n.said"), "\n\n").alias("changes"), F.array_sort(F.array_distinct(F.flatten("n.ids"))).alias("amendment_paragraph_ids"))


def _texts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select(F.coalesce("path", F.lit("")).alias("path"), F.col("index").cast("long").alias("index"), F.coalesce("text", F.lit("")).alias("text"))


def _arabic(number: Column) -> Column:
    """Value of a Roman numeral of I V X L C, as text; digits pass through."""
    value = F.create_map(*(F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100)) for x in pair))
    digits = F.transform(F.filter(F.reverse(F.split(F.upper(number), "")), lambda x: x != ""), lambda x: F.coalesce(F.element_at(value, x), F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("right"))
    add = lambda a, v: F.struct((a["sum"] + F.when(v < a["right"], -v).otherwise(v)).alias("sum"), v.alias("right"))
    return F.when(number.rlike(r"^\d*$"), number).otherwise(F.aggregate(digits, start, add)["sum"].cast("string"))


def units(paragraphs: DataFrame, placed: DataFrame, code: str) -> DataFrame:
    """unit_id, text, source, hierarchy, changes, numbers of all levels, paragraph_ids, amendment_paragraph_ids of the units in force."""
    legal = _legal(placed)
    leaves = _leaves(legal, code)
    numbered = F.when(F.col("turn") != 1, F.regexp_replace("t", f"(?U){_PART}", "")).when((F.col("index") == F.col("first")) & F.col("mark").isin("part", "point"), F.regexp_replace("t", rf"(?U)^{_NUMBER}[.)]\s+", "")).otherwise(F.col("t"))
    members = _members(legal, leaves).join(_texts(paragraphs), _KEY).withColumn("t", F.regexp_replace("text", rf"^{_SPACE}|{_SPACE}$", ""))
    body = members.groupBy(*_NODE).agg(F.array_sort(F.collect_list(F.struct("turn", "index", numbered.alias("t")))).alias("b")).select(*_NODE, F.array_join("b.t", "\n").alias("text"), F.col("b.index").alias("paragraph_ids"))
    changes = _changes(leaves, _notices(paragraphs, placed), _NODE, ["section", "chapter", "article", "part", "point"])
    heads = placed.where(F.col("kind").endswith("_heading")).select(*_KEY).join(_texts(paragraphs), _KEY).select("path", F.col("index").alias("__at"), _plain(F.col("text")).alias("__head"))
    out = leaves.join(body, _NODE).join(changes, _NODE, "left")
    for level in ("section", "chapter", "article"):
        out = out.join(heads.withColumnsRenamed({"__at": f"{level}_at", "__head": f"{level}_head"}), ["path", f"{level}_at"], "left")
    label = lambda c, n: F.when(F.col(c) != "", F.concat(F.lit(n + " "), F.col(c)))
    return out.select(
        "path", "unit_id", "text", F.concat_ws(" ", label("point", "п."), label("part", "ч."), label("article", "ст.")).alias("source"), F.concat_ws("\n", "chapter_head", "section_head").alias("hierarchy"), F.coalesce("changes", F.lit("")).alias("changes"),
        "article", "part", "point", F.regexp_replace("article_head", _ARTICLE, "").alias("article_title"), "chapter", _arabic(F.col("section")).alias("section"), "paragraph_ids", F.coalesce("amendment_paragraph_ids", F.array().cast("array<bigint>")).alias("amendment_paragraph_ids"),
    )


def _live_notes(placed: DataFrame, code: str) -> DataFrame:
    key = F.concat(F.lit(f"{code}:article:"), F.col("article"), F.lit(":note:"), F.when(F.col("note") == "", "unnumbered").otherwise(F.col("note")))
    return placed.where("kind = 'note' AND note_at >= 0 AND NOT article_idle AND NOT note_idle").withColumn("unit_id", key)


def notes(paragraphs: DataFrame, placed: DataFrame, code: str) -> DataFrame:
    """unit_id, text (as it stands), position, changes and paragraph_ids of the notes in force."""
    key = ["path", "article_at", "note_at"]
    live = _live_notes(placed, code)
    said = F.when((F.col("mark") == "note") & (F.col("note") != ""), F.regexp_replace("text", f"(?U){_NOTE}", "")).otherwise(F.col("text"))
    facts = ["unit_id", "article", "chapter", "section", "block_at"]
    got = live.join(_texts(paragraphs), _KEY).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("index", said.alias("t")))).alias("b"), *(F.first(c).alias(c) for c in facts))
    out = got.join(_changes(got, _notices(paragraphs, placed), key, ["block", "note"]), key, "left")
    position = F.concat(F.lit("ст. "), "article", F.lit(" глава "), "chapter", F.lit(" раздел "), _arabic(F.col("section")))
    return out.select("path", "unit_id", F.array_join("b.t", "\n").alias("text"), position.alias("position"), F.coalesce("changes", F.lit("")).alias("changes"), F.col("b.index").alias("paragraph_ids"))


def audit(placed: DataFrame, code: str) -> DataFrame:
    """One row for each paragraph: path, index, style, kind, context_assignment, unit_ids (of all units and notes that hold it, in order)."""
    legal = _legal(placed)
    held = _members(legal, _leaves(legal, code)).select(*_KEY, "unit_id").unionByName(_live_notes(placed, code).select(*_KEY, "unit_id"))
    ids = held.groupBy(*_KEY).agg(F.array_sort(F.collect_set("unit_id")).alias("unit_ids"))
    gone = legal.where("gone").select(*_KEY).unionByName(placed.where("kind = 'note' AND (article_idle OR note_idle)").select(*_KEY)).distinct().withColumn("__gone", F.lit(True))
    kind = F.when(F.col("__gone"), "inactive_placeholder").otherwise(F.col("kind"))
    rows = placed.select(*_KEY, "style", "kind", "context_assignment").join(gone, _KEY, "left").join(ids, _KEY, "left")
    return rows.select(*_KEY, "style", kind.alias("kind"), "context_assignment", F.coalesce("unit_ids", F.array().cast("array<string>")).alias("unit_ids"))


def faults(placed: DataFrame, code: str) -> DataFrame:
    """(rule, key) of what a corpus must not have, for ``schemas.reject``.

    Paragraphs that can't be placed, paragraphs of the law or of notes in no unit, articles in force without a paragraph, indices that
    are negative, null or repeated, identities of two units or notes of one document.
    """
    key = F.concat_ws(":", "path", "index")
    own = placed.where(F.col("fault").isNotNull()).select(F.col("fault").alias("rule"), key.alias("key"))
    bare = violations(audit(placed, code), key, {"in no unit": F.col("kind").isin("legal_text", "note") & (F.size("unit_ids") == 0), "index": F.coalesce(F.col("index") < 0, F.lit(True))})
    twice = placed.groupBy(*_KEY).count().where("count > 1").select(F.lit("repeated index").alias("rule"), key.alias("key"))
    legal = _legal(placed)
    empty = placed.where("kind = 'article_heading'").select(*_KEY).join(legal.select("path", F.col("article_at").alias("index")).distinct(), _KEY, "left_anti").select(F.lit("an article without text").alias("rule"), key.alias("key"))
    notes_ = _live_notes(placed, code).select("path", "unit_id", "note_at").distinct()
    same = _leaves(legal, code).select("path", "unit_id").unionByName(notes_.select("path", "unit_id")).groupBy("path", "unit_id").count().where("count > 1")
    return reduce(DataFrame.unionByName, (own, bare, twice, empty, same.select(F.lit("two units of one identity").alias("rule"), F.concat_ws(":", "path", "unit_id").alias("key"))))
