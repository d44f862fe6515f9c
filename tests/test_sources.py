import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.plans.pipeline import keyword_predictor, run
from docketry.schemas import LABELS, PORTABLE_ROW, ConstraintError
from docketry.sources import office, tables

C, E, N = LABELS


def test_labelled_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('tag,premise,hypothesis,source,extra\nentailment,"p, ""q""\nline",h1,s1,x\nnot mentioned,p2,h2,,x\n', encoding="utf-8")
    rows = tables.read_labelled(spark, str(p), "val").orderBy("row").collect()
    assert [(r.example_id, r.tag, r.source) for r in rows] == [("val:000000", E, "s1"), ("val:000001", N, "")] and rows[0].premise == 'p, "q"\nline'
    p.write_text("tag,premise,hypothesis,source\nwrong,p,h,s\n")
    with pytest.raises(ConstraintError, match="unknown_label"):
        tables.read_labelled(spark, str(p), "val")
    p.write_text("tag,premise\nx,y\n")
    with pytest.raises(ConstraintError, match="hypothesis, source"):
        tables.read_labelled(spark, str(p), "val")


def test_portable_split(spark, tmp_path):
    head = ",".join(PORTABLE_ROW.names)
    p = tmp_path / "t.csv"
    p.write_text(f"{head}\ntrain_000001,h,p,1,c,contradiction,type,doc,texts/a.txt\ntrain_000002,h,p,1,c,entailment,,doc,texts/a.txt\n")
    assert tables.read_portable(spark, str(p)).count() == 2
    for bad, rule in (("x,h,p,1,c,entailment,type,doc,a.txt", "error_type"), ("x,h,p,1,c,entailment,,doc,../a.txt", "path"), ("train_000001,h,p,1,c,entailment,,doc,a\nx,h,p,1,c,entailment,,doc,a\nx,h,p,1,c,entailment,,doc,a", "repeated_id")):
        p.write_text(f"{head}\n{bad}\n")
        with pytest.raises(ConstraintError, match=rule):
            tables.read_portable(spark, str(p))
    p.write_text("id,label\n1,x\n")
    with pytest.raises(ConstraintError, match="in this order"):
        tables.read_portable(spark, str(p))


def test_paths(spark):
    df = spark.createDataFrame([(x,) for x in ("a/b.txt", "/a", "../a", "a/../b", "a\\b", "C:/a", "", "a//b")], "p string")
    assert [r.x for r in df.select(tables.portable_path("p").alias("x")).collect()] == [True] + [False] * 7
    with pytest.raises(ConstraintError):
        tables.resolve_path("/tmp", "a/../../b")


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n  \n{"id": "b"}\n')
    assert [(r.id, r.n) for r in tables.read_jsonl(spark, str(p), schema).collect()] == [("a", 1), ("b", None)]
    for bad in ("[1]", "not json"):
        p.write_text('{"id": "a"}\n' + bad + "\n")
        with pytest.raises(ConstraintError):
            tables.read_jsonl(spark, str(p), schema)


def test_workbooks(spark, tmp_path):
    office.write_xlsx({"правила": pd.DataFrame({"rule_id": ["r1", "r2"], "name": ["a & b", "c"], "kind": ["k", "k"], "weight": ["12,5 %", "7%"], "comment": ["", "x"], "instruction": ["i", "j"], "use": ["Да", "нет"]})}, str(tmp_path / "r.xlsx"))
    cells = office.read_xlsx(spark, str(tmp_path / "r.xlsx"))
    rows = office.named_rows(cells, ["rule_id", "name", "kind", "weight", "comment", "instruction", "use"], "правила", strict=True)
    assert [(r.rule_id, r.name, r.weight_percent, r.row) for r in tables.read_expert_rules(rows).collect()] == [("r1", "a & b", 12.5, 2)]
    with pytest.raises(ConstraintError):
        office.named_rows(cells, ["other"])


def test_review_shapes(spark, tmp_path):
    office.write_xlsx({"s": pd.DataFrame({"hypothesis": ["h"], "premise": ["p"], "prediction": [" entailment "]})}, str(tmp_path / "legacy.xlsx"))
    office.write_xlsx({"s": pd.DataFrame({"sentence": ["h"], "article": ["5"], "premise": ["p"], "answer": ["x"]})}, str(tmp_path / "raw.xlsx"))
    office.write_xlsx({"s": pd.DataFrame({c: ["v"] for c in office.REVIEW_SHAPES["current"]})}, str(tmp_path / "new.xlsx"))
    got = {r["shape"]: r for r in office.review_rows(office.read_xlsx(spark, str(tmp_path))).collect()}
    assert set(got) == {"current", "legacy", "raw_legacy"} and got["legacy"].expert_label == "entailment" and got["raw_legacy"].article_number == "5" and got["raw_legacy"].hypothesis == "h"


def test_documents(spark, tmp_path):
    office.write_docx([("Глава 1.", "Heading 1"), ("текст <с> &", ""), ("", "")], str(tmp_path / "КоАП_редакция 01.10.2026.docx"))
    assert spark.createDataFrame([(1,)], "x int").count() == 1
    assert office.read_docx(spark, str(tmp_path)).first().text == "Глава 1.\nтекст <с> &\n"
    assert [(r["index"], r.text, r.style) for r in office.read_docx_paragraphs(spark, str(tmp_path)).orderBy("index").collect()] == [(1, "Глава 1.", "Heading 1"), (2, "текст <с> &", ""), (3, "", "")]
    inv = tables.file_inventory(spark, str(tmp_path)).first()
    assert inv.length > 0 and len(inv.sha256) == 64


def test_gold_and_pairing(spark):
    rows = spark.createDataFrame([(1, "H  one", "r1", "t1"), (2, "h one", "r2", "t1"), (3, "h two", " ", "t")], "row int, hypothesis string, reference string, text string")
    assert {r.hypothesis_key: (r.references, r.texts) for r in tables.gold_arrays(rows).collect()} == {"h one": (["r1", "r2"], ["t1"]), "h two": ([], [])}
    a, b = (spark.createDataFrame([(x,) for x in v], "path string") for v in (["x/review_Ivanov.xlsx", "y/petrov.xlsx"], ["d/ivanov.docx", "d/sidorov.docx"]))
    assert {r.key: r.paired for r in tables.pair_files(a, b).collect()} == {"ivanov": True, "petrov": False, "sidorov": False}


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("d", "doc:1", "t", "h", 1), ("d", "doc:1", "t", "h", 2)], "test_dataset string, document string, task string, hypothesis string, rank int")
    tables.write_review_package(pairs, str(tmp_path / "review"))
    back = spark.read.csv(str(tmp_path / "review"), header=True)
    assert back.count() == 2 and {r.document for r in back.collect()} == {"doc_1"} and "expert_label" in back.columns
    tables.write_tables({"pairs": pairs}, str(tmp_path / "t"), {"b": {"x": 1}, "a": "s"})
    assert [(r.key, r.value) for r in spark.read.parquet(str(tmp_path / "t/run_metadata")).orderBy("key").collect()] == [("a", "s"), ("b", '{"x": 1}')]
    units = spark.createDataFrame([("u1", "т", [1, 2])], "unit_id string, text string, paragraph_ids array<int>")
    m = tables.write_export(units, units.where("false"), str(tmp_path / "e"))
    assert m["units"] == 1 and json.loads(spark.read.text(str(tmp_path / "e/manifest")).first().value) == m
    raw = [bytes(r.content) for r in spark.read.format("binaryFile").load(str(tmp_path / "e/units_csv")).collect() if r.length]
    assert any(x.startswith(b"\xef\xbb\xbfunit_id") for x in raw)
    rows = spark.createDataFrame([("1", "train", "approved", True, C), ("2", "train", "excluded", True, E), ("3", "train", "pending", True, N)], "id string, split string, status string, active boolean, label string")
    tables.write_split(rows, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s/labelled"), header=True).count() == 1 and "label" not in spark.read.csv(str(tmp_path / "s/unlabelled"), header=True).columns and spark.read.parquet(str(tmp_path / "s/snapshot")).count() == 3 and spark.read.parquet(str(tmp_path / "s/pending")).count() == 1
    tables.write_lines(units, F.col("text"), "unit_id", str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first().value == "1. т"
    assert tables.write_index(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>"), str(tmp_path / "i"))["rows"] == 1
    with pytest.raises(ConstraintError):
        tables.write_index(spark.createDataFrame([(1, [0.0])], "id long, vector array<double>"), str(tmp_path / "i"))
    with pytest.raises(ConstraintError):
        tables.check_manifest({"a": 1}, {"a": 2})
    with pytest.raises(ConstraintError):
        tables.merge_parameters({"a": 1}, {"b": 2})
    assert tables.frame_hash(units, "unit_id").first() == tables.frame_hash(units.repartition(3), "unit_id").first()
    assert len(tables.tree_hash(spark.createDataFrame([("a", "1")], "path string, sha256 string")).first().sha256) == 64


def test_documents_to_scored_pairs(spark):
    docs = spark.createDataFrame([(1, "ПОСТАНОВИЛ: Признать виновным по ч. 1 ст. 18.8 КоАП РФ. Наказание назначить без ссылки."), (2, "нет раздела")], "doc_id long, text string")
    units = spark.createDataFrame([("u1", "Штраф налагается.", "КоАП РФ: Статья 18.8. ч. 1.", "КоАП РФ", "18.8", "1", None), ("u2", "Иное.", "КоАП РФ: Статья 18.9.", "КоАП РФ", "18.9", None, None)], "unit_id string, text string, source string, code string, article string, part string, point string")
    out = run(docs, units, keyword_predictor(("запрещ",), ("штраф",)))
    pairs = out.pairs.collect()
    assert [(r.unit_id, r.method, r.prediction) for r in pairs] == [("u1", "exact", E)] and pairs[0].premise.startswith("КоАП РФ: Статья 18.8")
    assert [(r.label, r.n_premises) for r in out.hypotheses.collect()] == [(E, 1)] and [r.doc_id for r in out.errors.collect()] == [2] and out.audit.count() == 2
