from pyspark.sql import functions as F

from docketry.operators import release
from docketry.schemas import LABELS

C, E, N = LABELS
EDITS = "array<struct<start:int,end:int,before:string,after:string>>"


def test_variants(spark):
    docs = spark.createDataFrame([("s1", "train", "abc", True), ("s2", "val", "abc", True), ("s3", "val", "abc", False)], "source_id string, split string, text string, active boolean")
    v = spark.createDataFrame([("s1", "v1", [(0, 1, "a", "X")], 1), ("s1", "v2", [(1, 2, "b", "")], 2), ("s1", "v3", [], 3), ("s2", "v1", [(2, 3, "c", "Z")], 1), ("s2", "v2", [(0, 1, "q", "")], 2), ("s3", "v1", [], 1), ("s9", "v1", [], 1)], f"source_id string, variant_id string, edits {EDITS}, seq int")
    out, bad = release.apply_variants(docs, v, {"train": 2, "val": 1})
    got = {(r.source_id, r.variant_id): (r.text, r.active) for r in out.collect()}
    assert got == {("s1", "original"): ("abc", True), ("s2", "original"): ("abc", False), ("s3", "original"): ("abc", False), ("s1", "v1"): ("Xbc", True), ("s1", "v2"): ("ac", True), ("s2", "v1"): ("abZ", True)}
    assert {(r.rule, r.key) for r in bad.collect()} == {("edits_do_not_fit", "s2/v2"), ("inactive_source", "s3/v1"), ("unknown_source", "s9/v1")}


def test_refresh(spark):
    rows = spark.createDataFrame([("1", 1, 0, "a", "approved"), ("2", 1, 5, "a", "approved"), ("3", 1, 9, "b", "proposed"), ("4", 2, 0, "c", "approved")], "id string, doc_id long, start int, sentence string, status string")
    h = spark.createDataFrame([(1, 0, True, None), (1, 5, True, None), (1, 9, False, "bank")], "doc_id long, start int, kept boolean, reason string")
    assert {r.id: (r.status, r.exclusion) for r in release.refresh_filter(rows, h).collect()} == {"1": ("approved", None), "2": ("excluded", "duplicate"), "3": ("excluded", "bank"), "4": ("excluded", "not_extracted")}
    a = spark.createDataFrame([("r1", "n", "k", 1.0, "i"), ("r2", "n", "k", None, "i")], "rule_id string, name string, kind string, weight_percent double, instruction string")
    b = a.where("rule_id = 'r1'").withColumn("name", F.lit("m")).union(spark.createDataFrame([("r3", "n", "k", 1.0, "i")], a.schema))
    assert {(r.rule, r.key) for r in release.rules_changed(a, b).collect()} == {("core_changed", "r1"), ("rule_removed", "r2"), ("rule_added", "r3")}
    assert release.rules_changed(a, a).count() == 0


def test_gate_and_bundle(spark):
    rows = spark.createDataFrame([("1", "train", "proposed", True), ("2", "val", "proposed", True), ("3", "val", "approved", True), ("4", "val", "excluded", True), ("5", "test", "pending", False)], "id string, split string, status string, active boolean")
    assert {(r.rule, r.key) for r in release.release_gate(rows, "x", "x").collect()} == {("not_approved", "2")}
    assert {(r.rule, r.key) for r in release.release_gate(rows, "old", "x").collect()} == {("stale_plan", "1"), ("not_approved", "2")}
    import hashlib

    docs = spark.createDataFrame([("s", "text")], "source_id string, text string")
    good = hashlib.sha256(b"text").hexdigest()
    bundle = spark.createDataFrame([("1", "s", "h", "p", C, "type", good), ("1", "s", "h2", "p", E, "", good), ("2", "s", "h", "p", C, "", "0"), ("3", "q", " ", "p", "x", "", good)], "id string, source_id string, hypothesis string, premise string, label string, error_type string, text_sha256 string")
    assert {(r.rule, r.key) for r in release.bundle_violations(bundle, docs).collect()} == {("repeated_id", "1"), ("repeated_pair", "1"), ("changed_text", "2"), ("error_type", "2"), ("unknown_document", "3"), ("unknown_label", "3"), ("blank_hypothesis", "3")}


def test_rebuild_and_errors(spark):
    a, b = spark.createDataFrame([("p", "h")], "premise string, hypothesis string"), spark.createDataFrame([("p", "h"), ("q", "h")], "premise string, hypothesis string")
    out, bad = release.rebuild_validation(a, b)
    assert out.count() == 3 and [r.key for r in bad.collect()] == ["p | h"]
    e = release.enrich_errors(spark.createDataFrame([("s", "v", "x")], "source_id string, variant_id string, error string"), spark.createDataFrame([("s", "v", [])], f"source_id string, variant_id string, edits {EDITS}"), spark.createDataFrame([("s", "v", "t")], "source_id string, variant_id string, text string"))
    assert e.first().text == "t"


def test_laws(spark):
    rows = [(1, "115-ФЗ", 2002, "О правовом положении иностранных граждан", False), (2, None, 2002, "О правовом положении иностранных граждан в РФ", True), (3, "115-ФЗ", 2002, "Иное имя", True), (4, "7-ФЗ", 2002, "Об охране", True), (5, None, 2003, "Об охране", True)]
    got = {r.mention_id: (r.law, r.chosen) for r in release.resolve_laws(spark.createDataFrame(rows, "mention_id long, number string, year int, title string, dated boolean")).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, False), 4: (4, True), 5: (5, True)}
    assert spark.createDataFrame([("«О ёлках РФ» № 5",)], "t string").select(release.title_key("t").alias("x")).first().x == "о елках российской федерации 5"
