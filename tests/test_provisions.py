"""Provisions: named cases, and any cut into ranges against a reader who goes through the paragraphs one after another."""

import random

import pytest

from docketry.operators import provisions
from docketry.schemas import ConstraintError, reject

SCHEMA = "path string, index int, text string, style string"


def placed(spark, texts, styles=None, path="d"):
    df = spark.createDataFrame([(path, i, x, (styles or {}).get(i, "Normal")) for i, x in enumerate(texts, 1)], SCHEMA)
    return df, provisions.place(df)


def units(spark, texts, styles=None):
    df, p = placed(spark, texts, styles)
    return {r.source: r for r in provisions.units(df, p, "c").collect()}


def kinds(p):
    return [(r.kind, r.unit_ids) for r in provisions.audit(p, "c").orderBy("path", "index").collect()]


def test_points_of_parts_and_of_articles(spark):
    texts = [
        "Раздел IV. Производство", "Глава 26. Доказательства", "Статья 26.4. Экспертиза", "1. Первое правило.", "2. В определении указываются:", "1) основания;", "2) вопросы:", "а) первый;", "б) второй.",
        "Кроме того, требуется подпись.", "3. Следующее правило.", "Статья 26.5. Другое", "Нужно выяснить:", "1) событие;", "2) участников.", "Статья 26.6. Без частей", "Правило -", "влечет наложение штрафа.",
    ]
    got = units(spark, texts)
    assert len(got) == 7
    assert got["п. 1 ч. 2 ст. 26.4"].text == "В определении указываются:\nоснования;\nКроме того, требуется подпись."
    assert got["п. 1 ч. 2 ст. 26.4"].unit_id == "c:article:26.4:part:2:point:1"
    assert "а) первый;\nб) второй." in got["п. 2 ч. 2 ст. 26.4"].text
    assert got["п. 1 ст. 26.5"].text == "Нужно выяснить:\nсобытие;"
    assert got["ст. 26.6"].text == "Правило -\nвлечет наложение штрафа."
    first = got["ч. 1 ст. 26.4"]
    assert (first.section, first.chapter, first.hierarchy, first.article_title) == ("4", "26", "Глава 26. Доказательства\nРаздел IV. Производство", "Экспертиза")
    df, p = placed(spark, texts)
    assert provisions.faults(p, "c").count() == 0
    assert kinds(p)[9] == ("legal_text", ["c:article:26.4:part:2:point:1", "c:article:26.4:part:2:point:2"])


def test_what_follows_a_list(spark):
    base = ["Статья 4.3. Правило", "1. Обстоятельства:", "1) первое;", "6) опьянение."]
    got = units(spark, [*base, "Судья может не признать данное обстоятельство отягчающим."])
    assert "Судья" not in got["п. 1 ч. 1 ст. 4.3"].text and "Судья" in got["п. 6 ч. 1 ст. 4.3"].text
    with pytest.raises(ConstraintError, match="after a list"):
        reject(provisions.faults(placed(spark, [*base, "Неясное общее правило."])[1], "c"))


def test_notices_belong_to_what_follows_and_are_inherited(spark):
    texts = [
        "Информация об изменениях:", "Раздел изменен.", "Раздел I. Общие", "Глава 1. Правила", "Информация об изменениях:", "Статья 1.3 изменена законом.", "Статья 1.3. Полномочия", "ГАРАНТ:", "См. комментарии к статье 1.3",
        "Информация об изменениях:", "Часть 1 изменена законом.", "1. Относится:", "1) первый вопрос;", "Информация об изменениях:", "Часть 1 дополнена пунктом 2.", "2) второй вопрос.", "2. Иное.", "Информация об изменениях:",
    ]
    styles = dict.fromkeys((2, 6, 11, 15), "Информация о версии") | dict.fromkeys((8, 9), "Комментарий")
    got = units(spark, texts, styles)
    one, two, other = got["п. 1 ч. 1 ст. 1.3"], got["п. 2 ч. 1 ст. 1.3"], got["ч. 2 ст. 1.3"]
    assert one.changes == "\n\n".join("Информация об изменениях:\n" + x for x in ("Раздел изменен.", "Статья 1.3 изменена законом.", "Часть 1 изменена законом."))
    assert one.amendment_paragraph_ids == [1, 2, 5, 6, 10, 11] and two.amendment_paragraph_ids == [1, 2, 5, 6, 10, 11, 14, 15]
    assert "Часть 1 изменена" not in other.changes and "Раздел изменен." in other.changes
    assert all("ГАРАНТ" not in r.text and "См." not in r.text for r in got.values())


def test_notes_repealed_and_signature(spark):
    texts = [
        "Предисловие", "Раздел II. Особенная часть", "Глава 12. Правила", "Статья 12.1. Норма", "1. Основное правило.", "2. Утратила силу.", "Примечания:", "1.  Текст с пробелами.", "  Продолжение.  ", "1) список;", "2. Утратило силу.", "3. Иное правило.",
        "Статья 12.2. Утратила силу с 2020 года.", "Статья 12.3. Не применяется с 2018 года.", "1. Прежнее.", "Статья 12.4. Иное", "Правило о законе, который утратил силу.", "Примечание.  Исходный текст.", None, "Президент", "Российской Федерации",
    ]
    df, p = placed(spark, texts)
    assert {r.source for r in provisions.units(df, p, "c").collect()} == {"ч. 1 ст. 12.1", "ст. 12.4"}
    notes = {r.unit_id: r for r in provisions.notes(df, p, "c").collect()}
    assert set(notes) == {"c:article:12.1:note:1", "c:article:12.1:note:3", "c:article:12.4:note:unnumbered"}
    assert notes["c:article:12.1:note:1"].text == "1.  Текст с пробелами.\n  Продолжение.  \n1) список;"
    assert notes["c:article:12.1:note:1"].position == "ст. 12.1 глава 12 раздел 2"
    assert notes["c:article:12.4:note:unnumbered"].text == "Примечание.  Исходный текст."
    assert [k for k, _ in kinds(p)] == [
        "front_matter", "section_heading", "chapter_heading", "article_heading", "legal_text", "inactive_placeholder", "note_heading", "note", "note", "note", "inactive_placeholder", "note",
        "inactive_article_heading", "inactive_article_heading", "inactive_placeholder", "article_heading", "legal_text", "note", "blank", "signature", "signature",
    ]
    assert provisions.faults(p, "c").count() == 0


def test_plural_notes_whose_first_stands_with_the_heading(spark):
    df, p = placed(spark, ["Статья 1. А", "Правило.", "Информация об изменениях:", "Примечания: 1. Первое.", "2. Второе."])
    notes = {r.unit_id: (r.text, r.changes) for r in provisions.notes(df, p, "c").collect()}
    assert notes == {"c:article:1:note:1": ("1. Первое.", "Информация об изменениях:"), "c:article:1:note:2": ("2. Второе.", "")}


def test_faults(spark):
    rule = lambda texts: sorted(r.rule for r in provisions.faults(placed(spark, texts)[1], "c").collect())
    assert rule(["Статья 1. А", "Статья 2. Б", "Правило."]) == ["an article without text"]
    assert rule(["Статья 1. А", "Правило.", "Статья 1. Б", "Правило."]) == ["two units of one identity"]
    assert "a numbered note has to follow" in rule(["Статья 1. А", "Правило.", "Примечания:", "Текст."])
    assert rule(["Статья 1. А", "Общее:", "1. Утратила силу."]) == ["in no unit"]
    df = spark.createDataFrame([("d", 1, "x", None), ("d", 1, "x", None), (None, None, None, None)], SCHEMA)
    assert sorted(r.rule for r in provisions.faults(provisions.place(df), "c").collect()) == ["index", "repeated index"]
    empty = provisions.place(spark.createDataFrame([], SCHEMA))
    assert provisions.audit(empty, "c").count() == 0 and provisions.faults(empty, "c").count() == 0


def reader(texts):
    """(kind, owner) of each paragraph by one pass with everything in memory; owner: (article, part, point) or (article, note) places."""
    art = part = point = note = None
    plural = inside = False
    out = []
    for i, (mark, x) in enumerate(texts):
        if mark in ("section", "chapter"):
            art = None
            out.append((mark + "_heading", None))
        elif mark == "article":
            art, part, point, note, inside = i, None, None, None, False
            out.append(("article_heading", None))
        elif art is None:
            out.append(("front_matter", None))
        elif mark == "note":
            inside, plural, note = True, x.startswith("Примечания"), i
            out.append(("note", (art, note)))
        elif inside:
            note = i if plural and mark == "part" else note
            out.append(("note", (art, note)))
        else:
            if mark == "part":
                part, point = i, None
            elif mark == "point":
                point = i
            shared = mark == "shared" and point is not None
            out.append(("legal_text", (art, part, None if shared else point)))
    return out


def test_any_cut_into_ranges_gives_what_a_reader_sees(spark):
    rng = random.Random(5)
    forms = {"section": "Раздел X. А", "chapter": "Глава 3. Б", "article": "Статья 7. В", "note": ["Примечание. Г", "Примечания: 1. Г"], "part": "4. Д", "point": "5) Е", "shared": "Кроме того, ж", "letter": "а) з"}
    marks = ["section", "chapter", *["article"] * 4, *["note"] * 2, *["part"] * 6, *["point"] * 6, *["shared"] * 2, *["letter"] * 4]
    docs = {f"d{k}": [(m, rng.choice(forms[m]) if isinstance(forms[m], list) else forms[m]) for m in rng.choices(marks, k=n)] for k, n in enumerate((300, 1, 40, 2, 9, 90))}
    rows = [(d, i, x, None) for d, texts in docs.items() for i, (_, x) in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    none = lambda v: None if v < 0 else v
    wanted = {(d, i): r for d, texts in docs.items() for i, r in enumerate(reader(texts))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen = {}
            for r in provisions.place(df).collect():
                owner = (r.article_at, none(r.part_at), none(r.point_at)) if r.kind == "legal_text" else (r.article_at, none(r.note_at)) if r.kind == "note" else None
                seen[r.path, r["index"]] = (r.kind, owner)
            assert seen == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
