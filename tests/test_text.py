import datetime

import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, keys, text
from docketry.operators import annotations, collect, corpus
from docketry.schemas import ConstraintError


def col(spark, values, expr, kind="string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(expr.alias("x")).collect()]


def test_sentences_keep_offsets(spark):
    t = "Согласно ст. 5.35 КоАП РФ и п. 2 суд решил. Иванов И. И. признан виновным! \n Вторая строка.\n\nТретья"
    got = col(spark, [t, None, ""], text.sentence_records("t"))
    assert [t[s.start : s.end] for s in got[0]] == [s.text for s in got[0]] == ["Согласно ст. 5.35 КоАП РФ и п. 2 суд решил.", "Иванов И. И. признан виновным!", "Вторая строка.", "Третья"]
    assert got[1] is None and got[2] == []


def test_sections_and_filters(spark):
    doc = "ПОСТАНОВИЛ: первое. П О С Т А Н О В И Л : Признать Иванова виновным. Реквизиты для уплаты штрафа. 40101810045250010041. В банк получателя. Счет получателя. Судья Петров. Копия верна не была."
    df = spark.createDataFrame([(1, doc), (2, "нет раздела"), (3, None)], "doc_id long, text string")
    rows = text.extract_hypotheses(df).orderBy("index").collect()
    assert {r.doc_id for r in rows} == {1} and all(doc[r.start : r.end] == r.sentence for r in rows)
    assert rows[0].kept and "Признать" in rows[0].sentence
    assert [(r.sentence, r.reason) for r in rows[1:]] == [("Реквизиты для уплаты штрафа.", "bank_or_payment_details"), ("40101810045250010041.", "numeric_only"), ("В банк получателя.", "bank_or_payment_details"), ("Счет получателя.", None), ("Судья Петров.", "judge_signature"), ("Копия верна не была.", None)]
    assert {r.doc_id for r in text.documents_without_section(df).collect()} == {2, 3}
    assert col(spark, ["a RULING: b RULING: c", "none", None], text.final_section("t", "RULING:")) == [" c", None, None]


def test_reasons_and_continuation(spark):
    said = {
        "УФК по г. Москве (ОМВД)": "bank_or_payment_details", "ИНН 7701, признать виновным ООО": None, "Назначение платежа: штраф, ст. 18.8 КоАП": "bank_or_payment_details", "Мировой судья (подпись) А.Б. Иванов": "judge_signature", "Районного суда: А. Б. Иванов": "judge_signature",
        "<ФИО1> [изъято] (данные изъяты)": "masked_only", "№ 5-12/2020": "numeric_only", "Подлинный документ подшит.": "non_legal_boilerplate", "Копию квитанции представить": "payment_receipt_instruction", "Квитанция: жалоба в течение 10 дней": None, " \t ": "empty", "Суд решил иначе": None,
    }
    assert dict(zip(said, col(spark, list(said), text.drop_reason("t")), strict=True)) == said
    doc = "ПОСТАНОВИЛ: Признать виновным.\nБанк получателя: ГУ\n(ОМВД по району)\nУМВД по области\nОМВД обжаловать вправе. Обычное слово\nУМВД по краю"
    rows = text.extract_hypotheses(spark.createDataFrame([(1, doc)], "doc_id long, text string")).orderBy("index").collect()
    assert [r.reason for r in rows] == [None, "bank_or_payment_details", "bank_block_continuation", "bank_block_continuation", "bank_block_continuation", None, None]
    sections = ["а ПОСТАНОВИЛ:  б  Постановил в. ", "п о с т а н о в и л", "решил: нет", None]
    df = spark.createDataFrame([(x,) for x in sections], "t string").select(text.operative_section("t").alias("x"))
    assert [r.x for r in df.collect()] == ["в.", None, None, None]


def test_continuation_by_brute_force(spark):
    import random

    rng, rows, want = random.Random(1), [], {}
    for d in range(40):
        block = False
        for i in range(rng.randint(1, 15)):
            reason, sentence = rng.choice(["bank", "numeric", "masked", "appeal", None, None, None]), rng.choice(["счет 1", "иное"])
            rows.append((d, i, reason, sentence))
            if reason:
                block = reason != "appeal"
            elif sentence.startswith("счет") and block:
                reason = "continuation"
            else:
                block = False
            want[d, i] = reason
    got = text.block_continuation(spark.createDataFrame(rows, "d long, i int, reason string, sentence string"), "d", "i", continuation="^счет", opening=("bank", "numeric", "masked"), name="continuation").collect()
    assert {(r.d, r.i): r.reason for r in got} == want


def test_irrelevant(spark):
    assert col(spark, ["БИК 044525000", "БИКини", "12 345 67.", "12 345, 67", "обычное", "Реквизиты", "Ре...изиты", "Судья Петров", "КПП 77", "бик 04"], text.irrelevant("t")) == [True, False, True, False, False, True, True, True, False, False]


def test_pages(spark):
    page = "<html><script>var a='</p>';</script><h1>A&amp;B</h1><p>one&nbsp; two<br>three</p><style>x{}</style></html>"
    assert col(spark, [page, None], text.visible_text("t")) == ["A&B\none two\nthree", None]
    assert col(spark, ["<a>x</a> &lt;i&gt;  y"], text.strip_tags("t")) == ["x <i> y"]
    assert col(spark, ["..[[abc]]def", "[[abc", "abc"], text.page_body("t", "[[", ("]]", "%%"))) == ["abc", "abc", None]
    assert col(spark, ["0123456789"], text.snippet("t", F.lit(4), F.lit(6), 2)) == ["…234567…"]
    assert col(spark, ["Ёлка  ещё"], text.fold_yo("t")) == ["Елка еще"]
    assert col(spark, ["Дело № 5-123/2020.", "№ 7-1/20", "нет"], text.case_number("t")) == ["5-123/2020", "7-1/20", ""]


def test_prompts_and_labels(spark):
    outs = ["Contradiction", "<think>entailment</think> Not   mentioned.", "entailment or contradiction", "", None, "noncontradictions"]
    assert col(spark, outs, text.parse_label("t")) == ["contradiction", "not mentioned", None, None, None, None]
    m = spark.createDataFrame([("s", "q", "ctx", None), ("s", "q", "", "a")], "s string, q string, c string, a string").select(text.chat_messages("s", "q", "c", "a").alias("m")).collect()
    assert [x.content for x in m[0].m] == ["s", "ctx\n\nq"] and [x.role for x in m[1].m] == ["system", "user", "assistant"] and m[1].m[1].content == "q"
    p = spark.createDataFrame([("text", "src"), ("src text", "src")], "p string, s string").select(text.model_premise("p", "s").alias("x"))
    assert [r.x for r in p.collect()] == ["src\ntext", "src text"]
    assert col(spark, ["abcdefghij", "", "abc"], text.chunks("t", 4, 1)) == [["abcd", "defg", "ghij"], [], ["abc"]]
    assert col(spark, ["q", " ", "I: q"], text.query_text("I: ", "t")) == ["I: q", None, "I: q"]
    assert col(spark, ["the fine print"], text.hint_terms("t", {"fine": ("штраф",), "none": ("x",)})) == [["штраф"]]


def test_keys(spark):
    assert col(spark, ["ﬁ STRASSE  ß", None], keys.text_key("t")) == ["fi strasse ss", None]
    assert col(spark, [" A \n b ", None], keys.loose_key("t")) == ["a b", ""]
    assert col(spark, ["КоАП РФ: Статья 5.35.", "a : b 3"], keys.article_key("t")) == ["коап рф статья 5.35", "a b 3"]
    assert col(spark, ["/x/Решение_по_делу Ivanov.docx"], keys.subject_key("t", ("решение", "по", "делу"))) == ["ivanov"]
    assert col(spark, ["a/b:c*", "...", ""], keys.safe_name("t")) == ["a_b_c", "unnamed", "unnamed"]
    assert col(spark, ["ГК РФ,  часть вторая"], keys.canonical_code("t")) == ["ГК РФ"]
    one = spark.createDataFrame([("КоАП", "5.1", None, "2")], "c string, a string, p string, q string")
    assert one.select(keys.unit_id(code="c", article="a", part="p", point="q").alias("x")).first().x == "КоАП:article:5.1:point:2"


def test_dates(spark):
    t = "20 мая 2020 года, 31.02.2021, 01.03.2021, 02/04/2021, 5 мая 1999 и 5 Марта 2022"
    got = col(spark, [t, None], dates.dates_in("t"))
    assert [d.date for d in got[0]] == [datetime.date(2020, 5, 20), datetime.date(2021, 3, 1), datetime.date(2021, 4, 2), datetime.date(2022, 3, 5)] and got[1] == []
    assert got[0][0].passage == t[:92] and "31.02.2021" in got[0][3].passage
    rows = [("Решение от 1 мая 2021", "г. Москва 3 июня 2021. Судья 4 июня 2021"), ("Решение от 1 мая 2020", "3 июня 2021, рассмотрев"), ("Решение от 1 мая 2020", "Судья 1 июня 2022"), ("x", "1 мая 2021 и 2 мая 2021"), ("№ 5-1/2021", "без даты"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(dates.decision_date("a", "b").alias("x")).select("x.*", dates.cutoff("x", "2021-01-01").alias("c"), dates.passages_json("x.evidence").alias("j"))
    day = datetime.date
    assert [(r.date, r.method, r.year_disagreement, r.c.action, r.c.pending) for r in df.collect()] == [
        (day(2021, 6, 3), "published_opening", False, "keep", []), (day(2021, 6, 3), "published_opening", True, "keep", ["date_year_disagreement"]), (day(2020, 5, 1), "archive_title", False, "exclude", []),
        (None, "ambiguous_opening", False, "keep", ["unresolved_decision_date"]), (None, "unresolved", False, "keep", ["unresolved_decision_date"]), (None, "unresolved", False, "keep", ["unresolved_decision_date"]),
    ]
    assert "3 июня 2021" in df.first().j
    assert col(spark, ["КоАП_редакция 01.10.2026.docx", "x.docx"], dates.edition_label("t")) == ["01.10.2026", None]
    assert col(spark, ["12,5 %", "7", "нет"], dates.percent("t")) == [12.5, 7.0, None]


def parse(*texts, styles=None):
    return corpus.parse_provisions([(i, t, (styles or {}).get(i, "")) for i, t in enumerate(texts, 1)])


def test_provision_tree():
    units, _ = parse("Раздел IV. Производство", "Глава 26. Доказательства", "Статья 26.4. Экспертиза", "1. Первое правило.", "2. В определении указываются:", "1) основания;", "2) вопросы:", "а) первый;", "б) второй.",
                     "Кроме того, требуется подпись.", "3. Следующее правило.", "Статья 26.5. Другое", "Нужно выяснить:", "1) событие;", "2) участников.", "Статья 26.6. Без частей", "Правило -", "влечет наложение штрафа.")
    by = {u["source"]: u for u in units}
    assert len(units) == len(by) == 7
    assert by["п. 1 ч. 2 ст. 26.4"]["text"] == "В определении указываются:\nоснования;\nКроме того, требуется подпись."
    assert "а) первый;\nб) второй." in by["п. 2 ч. 2 ст. 26.4"]["text"] and by["п. 1 ст. 26.5"]["text"] == "Нужно выяснить:\nсобытие;"
    assert by["ст. 26.6"]["text"] == "Правило -\nвлечет наложение штрафа." and by["ч. 1 ст. 26.4"]["section"] == "4"


def test_tails_and_changes():
    base = ["Статья 4.3. Правило", "1. Обстоятельства:", "1) первое;", "6) опьянение."]
    units, _ = parse(*base, "Судья может не признать данное обстоятельство отягчающим.")
    assert "Судья" not in units[0]["text"] and "Судья" in units[1]["text"]
    with pytest.raises(ValueError, match="may belong to all of its points"):
        parse(*base, "Неясное общее правило.")
    units, _ = parse("Раздел I. Общие", "Глава 1. Правила", "Информация об изменениях:", "Статья 1.3 изменена законом.", "Статья 1.3. Полномочия", "ГАРАНТ:", "См. комментарии к статье 1.3", "Информация об изменениях:", "Часть 1 изменена законом.",
                     "1. Относится:", "1) первый вопрос;", "Информация об изменениях:", "Часть 1 дополнена пунктом 2.", "2) второй вопрос.", "2. Иное.",
                     styles={4: "Информация о версии", 9: "Информация о версии", 13: "Информация о версии", 6: "Комментарий", 7: "Комментарий"})
    assert "Статья 1.3 изменена" in units[0]["changes"] and "Часть 1 изменена" in units[0]["changes"] and "дополнена пунктом 2" not in units[0]["changes"]
    assert "дополнена пунктом 2" in units[1]["changes"] and "Часть 1 изменена" not in units[2]["changes"]
    assert all("ГАРАНТ" not in u["text"] and "См." not in u["text"] for u in units)


def test_notes_and_inactive(spark):
    lines = ["Раздел II. Особенная часть", "Глава 12. Правила", "Статья 12.1. Норма", "1. Основное правило.", "2. Утратила силу.", "Примечания:", "1.  Текст с пробелами.", "  Продолжение.  ", "1) список;", "2. Утратило силу.", "3. Иное правило.",
             "Статья 12.2. Утратила силу с 2020 года.", "Статья 12.3. Не применяется с 2018 года.", "Статья 12.4. Иное", "Правило о законе, который утратил силу.", "Примечание.  Исходный текст.", "Президент", "Российской Федерации"]
    units, notes = parse(*lines)
    assert len(units) == 2 and len(notes) == 3
    assert notes[0]["text"] == "1.  Текст с пробелами.\n  Продолжение.  \n1) список;" and notes[0]["position"] == "ст. 12.1 глава 12 раздел 2"
    assert notes[-1]["text"] == "Примечание.  Исходный текст." and all("Президент" not in r["text"] for r in units + notes)
    df = spark.createDataFrame([("d", i, t, "") for i, t in enumerate(lines, 1)], "path string, index int, text string, style string")
    assert {r.unit_id for r in corpus.provision_units(df, "КоАП").collect()} == {"КоАП:article:12.1:part:1", "КоАП:article:12.4"}
    assert corpus.provision_notes(df).count() == 3
    assert {r.kind: r.n for r in corpus.paragraph_kinds(df).collect()}["article"] == 4
    assert [corpus.arabic(x) for x in ("IV", "IX", "XLII", "7")] == [4, 9, 42, 7]


def test_remarks(spark):
    lines = [("Раздел I. Общие", ""), ("Глава 5. Права", ""), ("Статья 5.1. Норма", ""), ("Примечание. Для целей настоящего Кодекса слово узко.", ""), ("Продолжение.", ""), ("Справка", "Комментарий"), ("Ещё.", ""), ("Статья 5 2. Иная", ""), ("Примечания:", ""),
             ("1. Указанное в частях 1 и 3 настоящей статьи.", ""), ("1) внутри", ""), ("2. Утратило силу.", ""), ("Глава 6. Иное", ""), ("обычный текст", ""), ("Статья 6.1. Ещё", ""), ("Примечания: 1. В настоящей главе так.", "")]
    found = corpus.parse_remarks([(n, t, s) for n, (t, s) in enumerate(lines, 1)])
    assert [(r["article"], r["remark_number"], r["block_index"], r["paragraph_start"], r["paragraph_end"]) for r in found] == [("5.1", "", 1, 4, 7), ("5.2", "1", 2, 10, 11), ("5.2", "2", 2, 12, 12), ("6.1", "1", 3, 16, 16)]
    assert found[0]["remark_text"].endswith("\nПродолжение.\nЕщё.") and found[3]["chapter"] == "Глава 6. Иное"
    with pytest.raises(ValueError, match="outside"):
        corpus.parse_remarks([(1, "Примечание. Текст", "")])
    with pytest.raises(ValueError, match="has to follow"):
        corpus.parse_remarks([(1, "Статья 1. Т", ""), (2, "Примечания:", ""), (3, "без номера", "")])
    df = spark.createDataFrame([("d", n, t, s) for n, (t, s) in enumerate(lines, 1)], "path string, index int, text string, style string")
    scoped = corpus.suggested_scopes(corpus.remarks(df)).orderBy("remark_id")
    assert [(r.category, r.targets) for r in scoped.collect()] == [(0, ["koap_rf"]), (2, ["koap_rf:article:5.2:part:1", "koap_rf:article:5.2:part:3"]), (9, []), (4, ["koap_rf:chapter:6"])]
    assert sorted((r.remark_id, r.position) for r in corpus.remark_targets(scoped).collect()) == [("remark_001", 0), ("remark_002", 0), ("remark_002", 1), ("remark_004", 0)]
    counts = {r.category: r.n for r in corpus.category_counts(scoped).collect()}
    assert len(counts) == 10 and counts[2] == 1 and counts[3] == 0
    text_hash = scoped.collect()[0]["remark_text"].encode()
    import hashlib

    given = [("remark_001", hashlib.sha256(text_hash).hexdigest(), 3, ["koap_rf:article:7.1"])]
    kind = "remark_id string, text_sha256 string, category int, targets array<string>"
    merged = annotations.merge_overrides(scoped.select("remark_id", "remark_text", "category", "targets"), spark.createDataFrame(given, kind))
    assert {r.remark_id: r.category for r in merged.collect()} == {"remark_001": 3, "remark_002": 2, "remark_003": 9, "remark_004": 4}
    for bad, rule in (([("remark_001", "x", 3, ["a"])], "stale_annotation"), ([("other", "x", 3, ["a"])], "unknown_remark")):
        with pytest.raises(ConstraintError, match=rule):
            annotations.merge_overrides(scoped.select("remark_id", "remark_text", "category", "targets"), spark.createDataFrame(bad, kind))


def test_coverage_and_hierarchy(spark):
    lines = ["Глава 1. Правила", "Статья 1.1. Норма", "1. Одно:", "1) первое;", "2) второе.", "2. Утратила силу.", "Статья 1.2. Иная", "Правило."]
    df = spark.createDataFrame([("d", n, t, "") for n, t in enumerate(["вне статьи", *lines], 1)], "path string, index int, text string, style string")
    units, notes = corpus.provision_units(df, "К"), corpus.provision_notes(df)
    assert [(r["index"], r.text) for r in corpus.coverage(df, units, notes).collect()] == [(1, "вне статьи")]
    assert {(r.article, r.parts, r.points, r.units) for r in corpus.hierarchy(units).collect()} == {("1.1", 1, 2, 2), ("1.2", 0, 0, 1)}


RULING = (
    "Дело № 5-1/2020. Рассмотрев дело об административном правонарушении в отношении Ф., " + "суд изучил обстоятельства дела. " * 40 + "Деяние предусмотрено ст. 18.8 КоАП РФ. ПОСТАНОВИЛ: Признать Ф. виновным по ч. 1 ст. 18.8 КоАП РФ и назначить наказание в виде "
    "административного штрафа в размере 2000 рублей. Штраф уплатить по указанным реквизитам не позднее шестидесяти дней со дня вступления в силу. Постановление может быть обжаловано в суд. Судья А. Иванов"
)


def test_original_rulings(spark):
    cases = {
        None: RULING, "incomplete_or_too_short": RULING[-300:], "not_administrative_offence_proceeding": RULING.replace("дело об административном правонарушении", "дело"),
        "complaint_or_protest_review_opening": RULING.replace("Рассмотрев дело", "Рассмотрев жалобу на постановление по делу; дело"), "missing_final_operative_marker": RULING.replace("ПОСТАНОВИЛ", "сказал"), "incomplete_operative_section": RULING.partition("в виде")[0],
        "review_outcome": RULING.replace("Штраф уплатить", "Постановление оставить без изменения. Штраф уплатить"), "target_article_absent_from_body": RULING.replace("предусмотрено ст. 18.8", "предусмотрено ст. 18.9"),
        "target_article_absent_from_operative": RULING.replace("ч. 1 ст. 18.8", "ч. 1 ст. 18.9"), "missing_adjudication": RULING.replace("Признать Ф. виновным", "Решено"),
        "incomplete_after_operative": RULING.replace("обжаловано", "оспорено").replace("Судья А. Иванов", ""),
    }
    df = spark.createDataFrame([(str(k), "Постановление", v, "18.8") for k, v in cases.items()], "want string, title string, text string, article string")
    assert {r.want: r.reason for r in collect.validate_original(df).collect()} == {str(k): k for k in cases}
    bare = collect.judge_original("", RULING.replace("назначить наказание в виде административного штрафа", "определить меру").replace("Штраф уплатить", "Уплатить"), "18.8")
    assert bare["reason"] == "missing_penalty" and collect.judge_original(None, None, "18.8")["reason"] == "incomplete_or_too_short"
    assert any("18.8" in x for x in collect.judge_original("", RULING, "18.8")["evidence"])


APPEAL = (
    "РЕШЕНИЕ. Рассмотрев дело по жалобе Ф. на постановление судьи районного суда, которым постановлением от 1 мая Ф. признан виновным по ч. 1 ст. 18.8 КоАП РФ, У С Т А Н О В И Л: " + "доводы жалобы проверены полностью. " * 25
    + "Руководствуясь ст. 30.7 КоАП РФ, Р Е Ш И Л: постановление судьи оставить без изменения, жалобу Ф. без удовлетворения."
)


def test_appeals(spark):
    cases = {
        None: APPEAL, "published body is too short": APPEAL[:200], "no final operative section": APPEAL.replace("Р Е Ш И Л", "сказал"), "Chapter 30 review is not established": APPEAL.replace("ст. 30.7", "ст. 29.7"),
        "current complaint challenges a prior review decision": APPEAL.replace("на постановление судьи", "на решение судьи"), "complaint against the ruling is not established": APPEAL.replace("по жалобе Ф.", "по делу Ф."),
        "challenged administrative-offence ruling is not established": APPEAL.replace("признан виновным", "наказан"), "operative charge conflicts with article 18.8": APPEAL.replace("оставить", "по ст. 18.9 КоАП РФ оставить"),
        "substantive offence finding conflicts with article 18.8": APPEAL.replace("доводы", "факт совершения правонарушения, предусмотренного ч. 1 ст. 18.10, доводы", 1),
        "article 18.8 is not tied to the current complaint or operative outcome": APPEAL.replace("ст. 18.8", "ст. 18.9"), "operative section has no allowed final disposition": APPEAL.replace("оставить без изменения", "рассмотреть"),
    }
    df = spark.createDataFrame([(str(k), v, "18.8") for k, v in cases.items()], "want string, text string, article string")
    ok, bad = collect.revalidate(df)
    assert [(r.want, r.disposition) for r in ok.collect()] == [("None", "upheld_denied")]
    assert {r.want: r.reason for r in bad.collect()} == {k: k for k in cases if k}


def test_exclusions(spark):
    head = "Дело в отношении индивидуального предпринимателя Ф. УСТАНОВИЛ: ПОСТАНОВИЛ:\n"
    docs = {
        1: "ПОСТАНОВИЛ:\nПризнать Ф. виновным по ч. 1 ст. 18.8 КоАП РФ и назначить штраф с административным выдворением.", 2: head + "Признать виновным по ст. 18.8 КоАП РФ.", 3: "ПОСТАНОВИЛ:\nНа основании ст. 5 ФЗ обязать явиться.",
        4: "ПОСТАНОВИЛ:\nПризнать Ф. виновным по ст. 18.8 КоАП РФ.\nНазначить штраф.\nВыдворить за пределы РФ.", 5: "ПОСТАНОВИЛ:\nПризнать Ф. виновным по ч. 1 ст. 18.8, ч. 2 ст. 19.3 КоАП РФ.", 6: "нет раздела", 7: "ПОСТАНОВИЛ:\nСодержать в специальном учреждении по КоАП РФ согласно федеральному закону.",
        8: "ПОСТАНОВИЛ:\nВыдворить за пределы.\nФ. обязан самостоятельно выехать.", 9: "ПОСТАНОВИЛ:\nОбычное.",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = collect.exclusion_reasons(df, spark.createDataFrame([(9, "named_by_experts")], "doc_id long, reason string"))
    got = {r.doc_id: r for r in found.collect()}
    assert {k: r.reasons for k, r in got.items()} == {
        1: [], 2: ["entrepreneur_mention"], 3: ["direct_federal_law"], 4: ["split_penalty"], 5: ["multiple_offences"], 6: [], 7: [], 8: ["split_departure_explanation"], 9: ["named_by_experts"],
    }
    assert "missing_operative" in got[6].flags and got[7].protected and got[3].evidence["direct_federal_law"] == ["На основании ст. 5 ФЗ обязать явиться."]
    said = ["Выдворить за пределы.", "Разъяснить: выдворить можно.", "Назначить штраф без выдворения.", "Назначить штраф с административным выдворением.", "О выдворении просили.", None]
    assert col(spark, said, collect.imposes_expulsion("t")) == [True, False, False, True, False, False]
    ruled = "ПОСТАНОВИЛ:\nПризнать ИП Ф. виновным.\nПризнать Ф., работающего у ИП Г., виновным."
    assert col(spark, [ruled, None], collect.party_evidence("t")) == [["Признать ИП Ф. виновным."], []]
    reasons = found.select("doc_id", "reasons")
    manual = spark.createDataFrame([(4, None, ["split_penalty"], "проверено"), (9, ["manual"], None, None)], "doc_id long, add array<string>, remove array<string>, note string")
    after, bad = collect.override(reasons, manual)
    left = {r.doc_id: r.reasons for r in after.collect()}
    assert left[4] == [] and left[9] == ["manual", "named_by_experts"] and [r.key for r in bad.collect()] == ["9"]
    assert {r.reason: r.n for r in collect.reason_counts(reasons).collect()}["split_penalty"] == 1


def test_search_results_and_integrity(spark):
    pages = spark.createDataFrame([(1, '<a id="7">Решение № 5-1/20</a><a id="8">Решение № 7-1/20</a><a id="7">Решение № 5-1/20</a><a id="9">Новость</a>')], "page_id long, html string")
    assert [r.result_id for r in collect.search_results(pages, '<a id="([0-9]+)">([^<]*)</a>').collect()] == ["7"]
    m = spark.createDataFrame([(1, "u1", "h1", "g", "1", "g/a"), (2, "u1", "h2", "g", "1", "x/b"), (3, "u3", "h1", "q", "2", "q/c")], "seq int, url string, content_sha256 string, group string, article string, location string")
    got = {(r.rule, r.key) for r in collect.integrity_report(m, ("g",), ("1",)).collect()}
    assert got == {("unknown_group", "q/c"), ("unknown_article", "q/c"), ("wrong_folder", "x/b"), ("repeated_url", "x/b after g/a"), ("repeated_content_sha256", "q/c after g/a")}
