import pytest
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.operators import citation_audit, retrieval


def tuples(text, **aliases):
    return [tuple(c.values()) for c in C.Extractor(aliases or None)(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("п. 2 ч. 1 ст. 32.9 КоАП РФ", [("КоАП РФ", "32.9", "1", "2")]), ("ст. 32.9 ч. 1 п. 2 КоАП РФ", [("КоАП РФ", "32.9", "1", "2")]), ("ст. 27.19.1 ч 1 КоАП РФ", [("КоАП РФ", "27.19.1", "1", None)]),
    ("Частью 3 статьи 18.8 Кодекса Российской Федерации об административных правонарушениях", [("КоАП РФ", "18.8", "3", None)]),
    ("ч. 2 ст. 5 Федерального закона № 115-ФЗ, то есть ч. 3.1 ст. 18.8 КоАП РФ", [(None, "5", "2", None), ("КоАП РФ", "18.8", "3.1", None)]),
    ("руководствуясь ст.ст. 3.5, 29.9-29.11 КоАП РФ", [("КоАП РФ", a, None, None) for a in ("3.5", "29.9", "29.10", "29.11")]),
    ("ст. 1 Трудового кодекса Российской Федерации", [("ТК", "1", None, None)]), ("ст. 1 Уголовно-исполнительного кодекса РФ", [("УИК РФ", "1", None, None)]),
    ("ст. 1 Уголовно-процессуального кодекса РФ", [("УПК РФ", "1", None, None)]), ("ст. 1 Гражданского процессуального кодекса РФ", [("ГПК РФ", "1", None, None)]), ("нет ссылок", []), ("", []), (None, []),
    ("ст. 1 УК", [("УК РФ", "1", None, None)]), ("ст 2 ГК", [("ГК РФ", "2", None, None)]), ("ст. 3.1 КРФ об АП", [("КоАП РФ", "3.1", None, None)]), ("ст. 3.1 КРФоАП", [("КоАП РФ", "3.1", None, None)]), ("ст. 3.1 КоАПРФ", [("КоАП РФ", "3.1", None, None)]),
    ("ст. 1 Уголовно процессуального кодекса", [("УПК РФ", "1", None, None)]), ("ст. 1 Кодекса РФ об АП", [("КоАП РФ", "1", None, None)]), ("ст. 7 ФЗ и ст. 8.1 ГПК", [(None, "7", None, None), ("ГПК РФ", "8.1", None, None)]), ("ст. 7 ФЗ, КоАП РФ", [(None, "7", None, None)]),
    ("статьями 1.1, ст. 1.2 КАС РФ", [("КАС РФ", "1.1", None, None), ("КАС РФ", "1.2", None, None)]), ("п. 1 ч. 2 ст. 5.1 УИК", [("УИК РФ", "5.1", "2", "1")]),
    ("ст. 5-7 КоАП РФ", []), ("ст. 12.8 КоАП РФ и ст. 12.8 КоАП РФ", [("КоАП РФ", "12.8", None, None)]),
])
def test_grammar(text, want):
    assert tuples(text) == want


def test_aliases_come_from_data():
    assert tuples("ст. 4 Закона города N", **{"Закона города N": "ЗГN"}) == [("ЗГN", "4", None, None)]


@pytest.mark.parametrize(("group", "single", "want"), [("5.35, 5.36", False, ["5.35", "5.36"]), ("29.9-29.11", False, ["29.9", "29.10", "29.11"]), ("5-7", False, None), ("5-7", True, ["5", "6", "7"]), ("5.1-6.2", False, None), ("1.9-1.8", True, None), ("1.1 - 1.500", True, None)])
def test_number_groups(group, single, want):
    assert C.expand_numbers(group, single) == want


def test_sources_and_labels(spark):
    rows = [("КоАП РФ: Статья 32.9. ч. 1 п. 2.",), ("ТК: Статья 58. п. 1.",), ("ГК РФ ч.4: Статья 1225. ч. 1 п. 1.",), ("Иное",), (None,)]
    df = spark.createDataFrame(rows, "source string").select("source", C.parse_source("source").alias("c"))
    got = [tuple(r.c) if r.c else None for r in df.collect()]
    assert got == [("КоАП РФ", "32.9", "1", "2"), ("ТК", "58", None, "1"), ("ГК РФ ч.4", "1225", "1", "1"), None, None]
    label = spark.createDataFrame(rows[:1], "source string").withColumn("citation", F.lit(None).cast("struct<code:string,article:string,part:string,point:string>")).select(C.article_reference("source", "citation").alias("x")).first().x
    assert label == "КоАП РФ ст. 32.9 ч. 1 п. 2"


def units(spark):
    lines = ["5.35|1|1", "5.35|1|2", "5.35|2|", "5.35.1|1|1", "5.36||", "5.37|3|", "5.37|3.1|"]
    rows = [(i, "КоАП РФ", *(x or None for x in line.split("|"))) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "unit_id long, code string, article string, part string, point string")


def cited(spark, *rows):
    return spark.createDataFrame([(h, n, "КоАП РФ", a, p, q) for h, n, a, p, q in rows], "hypothesis_id long, citation_no int, code string, article string, part string, point string")


def test_exact_lookup_and_routing(spark):
    c = cited(spark, (1, 0, "5.35", "1", "1"), (2, 0, "5.35", "1", None), (3, 0, "5.35", None, None), (4, 0, "5.36", None, None), (5, 0, "5.37", "3", None), (6, 0, "9.9", None, None), (7, 0, "5.35", None, "1"))
    got = {}
    for r in retrieval.exact_lookup(c, units(spark)).collect():
        got.setdefault(r.hypothesis_id, set()).add(r.unit_id)
    assert got == {1: {0}, 2: {0, 1}, 4: {4}, 5: {5}, 7: {0}}
    h = spark.range(1, 9).withColumnRenamed("id", "hypothesis_id")
    semantic = h.select("hypothesis_id", F.lit(99).cast("long").alias("unit_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))
    routed = {(r.hypothesis_id, r.unit_id, r.method) for r in retrieval.route_rules_first(h, retrieval.exact_lookup(c, units(spark)), semantic).collect()}
    assert routed == {(1, 0, "exact"), (2, 0, "exact"), (2, 1, "exact"), (4, 4, "exact"), (5, 5, "exact"), (7, 0, "exact"), (3, 99, "semantic"), (6, 99, "semantic"), (8, 99, "semantic")}


def test_citations_meet_units_by_equality_alone(spark):
    c, u = cited(spark, (1, 0, "5.35", None, None)), units(spark)
    for found in (retrieval.exact_lookup(c, u), citation_audit.unit_lookup(u, c.withColumnRenamed("hypothesis_id", "key"))):
        assert " OR " not in found._jdf.queryExecution().optimizedPlan().toString()  # no candidates of a whole article that a condition thins


def test_exact_lookup_counts_all_hits_of_a_citation_number(spark):
    c = cited(spark, (1, 0, "5.36", None, None), (1, 0, "5.35", "1", "1"), (2, 0, "5.36", None, None), (None, 0, "5.36", None, None))
    got = sorted((str(r.hypothesis_id), r.article, r.unit_id) for r in retrieval.exact_lookup(c, units(spark)).collect())
    assert got == [("1", "5.35", 0), ("2", "5.36", 4), ("None", "5.36", 4)]


def test_unit_classes_hold_all_pairs(spark):
    rows = [(1, "5.35", "1", None), (2, "5.35", "1", None), (3, "5.35", None, None), (4, "5.35", None, None), (5, "9.9", None, None), (6, "5.35", None, "1"), (7, "5.35", "1", None)]
    c = spark.createDataFrame([(k, "КоАП РФ", a, p, q) for k, a, p, q in rows], "key long, code string, article string, part string, point string")
    classes = [(r.key, r.same_as, r.unit_id) for r in citation_audit.unit_classes(units(spark), c).collect()]
    assert sorted((k, s) for k, s, u in classes if u is None) == [(2, 1), (4, 3), (7, 1)]
    own = {}
    for k, s, u in classes:
        if u is not None:
            assert k == s
            own.setdefault(k, []).append(u)
    pairs = sorted((k, u) for k, s in {(k, s) for k, s, _ in classes} for u in own[s])
    assert pairs == sorted((r.key, r.unit_id) for r in citation_audit.unit_lookup(units(spark), c).collect())


def test_fill_after_exact(spark):
    e = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "hypothesis_id long, citation_no int, unit_id long")
    s = spark.createDataFrame([(1, 8, 1, 0.9), (1, 5, 2, 0.8), (1, 6, 3, 0.7), (2, 4, 1, 0.6)], "hypothesis_id long, unit_id long, rank int, score double")
    got = [(r.hypothesis_id, r.unit_id, r["rank"], r.methods, r.overflow) for r in retrieval.fill_after_exact(e, s, 3, 1).orderBy("hypothesis_id", "rank").collect()]
    assert got == [(1, 7, 1, ["exact"], True), (1, 8, 2, ["exact", "semantic"], True), (1, 5, 3, ["semantic"], True), (2, 4, 1, ["semantic"], False)]


def test_sql_functions(spark):
    C.register_functions(spark)
    assert spark.sql("SELECT extract_citations('ст. 1 УК РФ')[0].code AS c, text_key('  Ⅷ  STRAßE ') AS k").first().asDict() == {"c": "УК РФ", "k": "viii strasse"}
    assert spark.sql("SELECT size(sentence_records('Раз. Два.')) AS n").first().n == 2


def test_law_numbers_and_articles(spark):
    df = spark.createDataFrame([("по закону № 115-ФЗ и N 7-ФЗ, № 115 - ФЗ",)], "t string").select(C.law_numbers("t").alias("x"))
    assert df.first().x == ["7-ФЗ", "115-ФЗ"]
    t = spark.createDataFrame([("ст. 5.35 КоАП",), ("ст. 5.35.1 КоАП",), ("статьи 5.35.",), ("ст. 15.35",)], "t string")
    assert [r.x for r in t.select(F.col("t").rlike(C.article_pattern("5.35")).alias("x")).collect()] == [True, False, True, False]


def test_sql_of_visible_text_reads_entities_without_semicolon():
    import hashlib

    import duckdb

    from docketry.functions.text import visible
    from docketry.plans.queries import SQL

    page = "<title>a&amp;amp b &amp</title><p>x &lt y &copy z &nbsp;&quot;&#39;&amp;lt;</p>"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [page])
    assert visible(page) == "a&amp b &\nx < y © z \"'&lt;"
    assert con.execute(SQL["page_visible_text"]).fetchone()[1] == hashlib.md5(visible(page).encode()).hexdigest()


def test_unit_lookup_lists_every_pair_of_equal_citations(spark, tmp_path):
    import docketry.plans.curation_queries  # noqa: F401  (its queries register themselves)
    from docketry.plans.queries import QUERIES

    rows = [(k, "B", "T" if k < 8 else "S", k % 5) for k in range(1, 10)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    fits = lambda k, s, u: (k % 2 or s % 3 == u % 3) and (k % 4 or s % 2 == u % 2)
    want = sorted((k, u) for k, _, t, s in rows for u, _, v, z in rows if t == v and fits(k, s, z))
    got = QUERIES["unit_lookup"](spark, str(tmp_path))
    assert got.columns == ["key", "unit_id"] and sorted(map(tuple, got.collect())) == want
