"""Citation audit, generation, annotations, lookups, models, discovery and shared helpers."""

import hashlib
import json
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docketry import models, shared
from docketry.operators import annotations, citation_audit, curation, generation, lookups
from docketry.operators.generation import Candidate, Pick
from docketry.schemas import ConstraintError
from docketry.sources import discovery, office, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
C, E, N = "contradiction", "entailment", "not mentioned"
CITE = "struct<code:string,article:string,part:string,point:string>"


def test_audit_of_occurrences(spark):
    units = spark.createDataFrame([("u1", "КоАП РФ", "18.8", "1", None), ("u2", "КоАП РФ", "18.8", "2", None), ("u3", "КоАП РФ", "5.1", None, None)], "unit_id string, code string, article string, part string, point string")
    said = ["ч. 1 ст. 18.8 КоАП РФ", "ст. 5.1 КоАП РФ и ст. 9.9 КоАП РФ", "нет ссылок", "ст. 18.8 КоАП РФ", "ч. 2 ст. 18.8 КоАП РФ"]
    occurrences = spark.createDataFrame([("A" if i < 3 else "B", "d", i, t) for i, t in enumerate(said)], "dataset string, document string, sentence_index int, hypothesis string")
    k = "коап рф"
    gold = spark.createDataFrame([(said[0].lower(), [("КоАП РФ", "18.8", "1", None)]), (said[1].lower(), [("КоАП РФ", "5.2", None, None), ("КоАП РФ", "5.1", None, None)]), (said[2], []), (said[4].lower(), [("КоАП РФ", "18.8", "1", None)])], f"hypothesis_key string, gold array<{CITE}>")
    audit = citation_audit.audit_occurrences(occurrences, gold, units)
    got = {r.sentence_index: r for r in audit.collect()}
    assert {i: (r.retrieval_route, r.annotated, r.comparison_status) for i, r in got.items()} == {
        0: ("rules", True, "matched_full"), 1: ("rules", True, "mixed"), 2: ("faiss", True, "no_articles"), 3: ("faiss", False, "missing_annotation"), 4: ("rules", True, "matched_article_subprovision_diff"),
    }
    assert [c.article for c in got[1].unresolved] == ["9.9"] and [c.article for c in got[1].resolved] == ["5.1"] and [c.article for c in got[3].unresolved] == ["18.8"]
    rows = {(r.sentence_index, r.code, r.article): (r.comparison_status, r.exact_lookup_status) for r in citation_audit.article_rows(audit).collect()}
    assert rows == {
        (0, k, "18.8"): ("matched_full", "resolved"), (1, k, "5.1"): ("matched_full", "resolved"), (1, k, "5.2"): ("missed_expert", "not_extracted"), (1, k, "9.9"): ("extracted_not_in_expert", "unresolved"),
        (3, k, "18.8"): ("unannotated_extraction", "unresolved"), (4, k, "18.8"): ("matched_article_subprovision_diff", "resolved"),
    }
    s = {r.dataset: r for r in citation_audit.summary(audit).collect()}["ALL"]
    assert (s.pipeline_hypotheses, s.annotated_hypotheses, s.missing_annotation_hypotheses, s.hypotheses_with_expert_articles, s.expert_articles, s.detected_articles, s.matched_articles) == (5, 4, 1, 3, 4, 5, 3)
    assert (s.missed_expert_articles, s.detected_not_in_expert, s.detected_with_missing_annotation, s.expert_full_references, s.matched_full_references, s.resolved_expert_articles, s.unresolved_detected_articles) == (1, 1, 1, 4, 2, 3, 2)
    assert (s.article_extraction_recall, s.full_reference_recall, s.rule_retrieval_recall) == (0.75, 0.5, 0.75)
    h = {r.sentence_index: r for r in citation_audit.hypothesis_rows(audit).collect()}
    assert h[0].expert_references == "КоАП РФ ст. 18.8 ч. 1" and h[3].detected_not_in_expert is None and h[1].missed_expert_articles == 1
    assert citation_audit.in_scope(audit, "rules").count() == 3
    with pytest.raises(ValueError):
        citation_audit.in_scope(audit, "other")
    cited = spark.createDataFrame([(1, "КоАП РФ", "18.8", None, None), (2, "КоАП РФ", "18.8", "2", None), (3, "КоАП РФ", "7", None, None)], "key int, code string, article string, part string, point string")
    assert sorted((r.key, r.unit_id) for r in citation_audit.unit_lookup(units, cited).collect()) == [(1, "u1"), (1, "u2"), (2, "u2")]
    ok, bad = citation_audit.gold_citations(spark.createDataFrame([("ст. 5.1 КоАП РФ",), ("нет",), ("ст. 5.1, 5.2 КоАП РФ",)], "reference string"))
    assert [r.citation.article for r in ok.collect()] == ["5.1"] and sorted(r.rule for r in bad.collect()) == ["no_article", "several_articles"]
    a = citation_audit.corpus_aliases(spark.createDataFrame([("КоАП РФ: Статья 1.1.",), ("Инструкция: Статья 7. ч. 2.",), ("Инструкция: Статья 7. ч. 2.",)], "source string"), ("КоАП РФ",))
    assert sorted(str(r.alias) for r in a.collect()) == ["None", "Инструкция"]


def test_generation_candidates_and_plan(spark):
    kind = "row_id string, source_id string, hypothesis_id string, variant_id string, status string, hypothesis string, start int, end int, unit_id string, premise string, article_number string"
    rows = [("1", "s", "h", "original", "proposed", "текст", 0, 5, "u1", "p1", "1"), ("2", "s", "h", "original", "proposed", "текст", 0, 5, "u1", "p1", "1"), ("3", "s", "h", "original", "proposed", "текст", 0, 5, "", "p2", "2"), ("4", "s", "h", "v", "proposed", "иное", 0, 4, "u9", "p", "1"), ("5", "s", "g", "original", "excluded", "иное", 0, 4, "u9", "p", "1")]
    found = generation.candidates(spark.createDataFrame(rows, kind))
    assert [(r.hypothesis_id, r.text, [p.row_id for p in r.provisions]) for r in found.collect()] == [("h", "текст", ["1", "3"])]
    with pytest.raises(ConstraintError, match="inconsistent"):
        generation.candidates(spark.createDataFrame([*rows, ("6", "s", "h", "original", "proposed", "другой", 0, 6, "u1", "p", "1")], kind))
    plan = found.select("source_id", F.col("hypothesis_id").alias("target_hypothesis_id"), F.lit("r1").alias("rule_id"), F.lit("val").alias("split"), F.lit("unconfirmed").alias("planned_status")).withColumn("assignment_id", generation.assignment_id("val", "source_id", "target_hypothesis_id", "rule_id"))
    rules = spark.createDataFrame([("r1", "правило")], "rule_id string, name string")
    assert [r.planned_status for r in generation.revalidate_plan(plan, "val", found, found, rules).collect()] == ["unconfirmed"]
    assert [(r.planned_status, r.inactive_reason) for r in generation.revalidate_plan(plan, "val", found, found.where("false"), rules).collect()] == [("inactive", "All original candidate pairs were excluded")]
    for bad in (plan.withColumn("assignment_id", F.lit("x")), plan.withColumn("rule_id", F.lit("r9")), plan.withColumn("split", F.lit("test"))):
        with pytest.raises(ConstraintError, match="invalid_assignment"):
            generation.revalidate_plan(bad, "val", found, found, rules).collect()
    documents = spark.createDataFrame([("s", "текст и далее")], "source_id string, text string")
    variants = spark.createDataFrame([("s", "original"), ("s", "v1")], "source_id string, variant_id string")
    task = generation.generation_tasks(plan, found, documents, rules, variants).first()
    assert task.task_id.startswith("gen_") and task.target_hypothesis.text == "текст" and task.expert_rule.name == "правило" and [v.variant_id for v in task.existing_variants] == ["v1"]
    with pytest.raises(ConstraintError, match="stale_offsets"):
        generation.generation_tasks(plan, found, documents.withColumn("text", F.lit("другой текст")), rules, variants)
    sources, counts = generation.confirmed(spark.createDataFrame([("s", True, "approved", C, "r1"), ("t", True, "approved", E, "r1"), ("u", False, "approved", C, "r1")], "source_id string, active boolean, status string, label string, rule_id string"))
    assert [r.source_id for r in sources.collect()] == ["s"] and [(r.rule_id, r.n) for r in counts.collect()] == [("r1", 1)]


def test_schedules():
    found = [Candidate(f"s{i // 2}", f"h{i}", {"r2": 1} if i == 1 else {}) for i in range(6)]
    out = generation.schedule_train(found, {"r1": 50.0, "r2": 50.0}, generation.Counter({("s0", "h0"): 2}), {("s1", "h2"): {"r1"}})
    assert sum(out.requested.values()) == 10 and not any(p.hypothesis_id == "h0" for p in out.picks)
    per = {}
    for p in out.picks:
        per.setdefault(p.hypothesis_id, []).append(p.rule_id)
    assert per["h1"][0] == "r2" and per["h2"] == ["r2"] and all(len(set(r)) == len(r) <= 2 for r in per.values())
    firsts = [p.round for p in out.picks[:5]]
    assert firsts == [1] * 5 and sum(out.shortage.values()) == 10 - len(out.picks)
    many = [Candidate(f"s{i}", f"h{i}", {}) for i in range(30)]
    assert generation.quotas({"a": 1.0, "b": 1.0, "c": 1.0}, 4) == {"a": 2, "b": 1, "c": 1} and sum(generation.quotas({"a": 1.0, "b": 9.0}, 7, 2).values()) == 7
    plan = [Pick("s", "h", "r1"), Pick("s", "h", "r2")]
    assert generation.reservations(plan, generation.Counter({("s", "h", "r1"): 2, ("s", "g", "r9"): 1})) == {("s", "h"): 3, ("s", "g"): 1}
    with pytest.raises(ConstraintError):
        generation.reservations([*plan, Pick("s", "h", "r3")], generation.Counter())
    assert generation.seeded_order(many, 1) == generation.seeded_order(many[::-1], 1) != generation.seeded_order(many, 2)


def _registry(spark):
    rows = [(str(i), "pending" if i < 4 else "excluded", "", "", "", "", "", None) for i in range(5)]
    return spark.createDataFrame(rows, f"row_id string, status string, label string, relevance string, error_type string, rule_id string, annotation_rationale string, annotation_history array<{annotations._EVENT}>")


GIVEN = "row_id string, status string, label string, relevance string, error_type string, rule_id string, rationale string"


def test_import_of_annotations(spark):
    rules = annotations.eligible_rules(None, spark.createDataFrame([("r1", "Сумма"), ("r2", "Срок")], "rule_id string, name string"))
    given = [("0", " Proposed ", C.upper(), "related", "r1", "", "why"), ("1", "needs_review", E, "unrelated", "", "", ""), ("2", None, N, "unrelated", "", "r2", "why")]
    out = annotations.import_annotations(_registry(spark), spark.createDataFrame(given, GIVEN), rules)
    got = {r.row_id: r for r in out.collect()}
    assert (got["0"].status, got["0"].label, got["0"].error_type, got["0"].rule_id, got["0"].annotation_rationale) == ("proposed", C, "Сумма", "r1", "why")
    assert got["1"].status == "pending" and got["1"].label == "" and got["1"].annotation_history[0].label == E and got["2"].rule_id == "r2" and got["3"].annotation_history is None
    again = annotations.import_annotations(out, spark.createDataFrame(given[:1], GIVEN), rules, human=True)
    first = next(r for r in again.collect() if r.row_id == "0")
    assert first.status == "approved" and [(e.actor, e.status) for e in first.annotation_history] == [("subagent", "proposed"), ("human", "approved")]
    bad = {
        "no_row_id": ("", "proposed", E, "related", "", "", "w"), "unknown_status": ("0", "odd", E, "related", "", "", "w"), "invalid_label": ("0", "pending", "x", "related", "", "", ""), "invalid_relevance": ("0", "pending", E, "x", "", "", ""),
        "no_rationale": ("0", "proposed", E, "related", "", "", " "), "has_to_be_related": ("0", "proposed", E, "unrelated", "", "", "w"), "rule_and_error_type_disagree": ("0", "proposed", C, "related", "Сумма", "r2", "w"),
        "no_eligible_error_type": ("0", "proposed", C, "related", "иное", "", "w"), "error_type_without_contradiction": ("0", "proposed", E, "related", "Сумма", "", "w"), "unknown_rule": ("0", "proposed", E, "related", "", "r9", "w"),
        "unknown_row": ("77", "proposed", E, "related", "", "", "w"), "excluded_row": ("4", "proposed", E, "related", "", "", "w"), "only_humans_approve": ("0", "approved", E, "related", "", "", "w"),
    }
    for rule, row in bad.items():
        with pytest.raises(ConstraintError, match=rule):
            annotations.import_annotations(_registry(spark), spark.createDataFrame([row], GIVEN), rules)
    with pytest.raises(ConstraintError, match="repeated_row"):
        annotations.import_annotations(_registry(spark), spark.createDataFrame(given[:1] * 2, GIVEN), rules)
    skipped = annotations.import_annotations(_registry(spark), spark.createDataFrame([bad["excluded_row"]], GIVEN), rules, skip_excluded=True)
    assert {r.row_id: r.status for r in skipped.collect()}["4"] == "excluded"
    with pytest.raises(FileNotFoundError):
        annotations.eligible_rules(None, None)
    with pytest.raises(ConstraintError):
        annotations.eligible_rules(spark.createDataFrame([("r1", None)], "rule_id string, name string"), None)


def test_lookups(spark):
    gold = spark.createDataFrame([("A", "d", 0, ["x", "y"]), ("A", "d", 1, ["z"]), ("A", "d", 2, []), ("B", "d", 0, ["q"])], "dataset string, document string, sentence_index int, gold array<string>")
    pairs = spark.createDataFrame([("A", "d", 0, "exact", "x"), ("A", "d", 0, "exact", "w"), ("A", "d", 1, "exact", "z"), ("A", "d", 1, "faiss", "z")], "dataset string, document string, sentence_index int, retrieval_method string, key string")
    assert {r.dataset: (r.faiss_recall, r.rules_recall, r.total_recall) for r in lookups.saved_pair_recall(gold, pairs).collect()} == {"A": (1.0, 0.5, 2 / 3), "B": (0.0, None, 0.0)}
    scores = spark.createDataFrame([("m", "r", 1.0), ("m", "s", 2.0), ("n", "r", 3.0), ("n", "r", 4.0)], "model string, recipe_id string, f1 double")
    want = lambda *rows: spark.createDataFrame(rows, "model string, recipe_id string")
    assert [r.f1 for r in lookups.grid_winners(scores, want(("m", "s"))).collect()] == [2.0]
    for row, rule in ((("n", "r"), "more_than_once"), (("o", "r"), "not_found")):
        with pytest.raises(ConstraintError, match=rule):
            lookups.grid_winners(scores, want(row))
    h = spark.createDataFrame([("s", 3, "a"), ("s", 9, "b")], "source_id string, start int, text string")
    target = h.limit(1).select("source_id", lookups.hypothesis_id("source_id", "start", "text").alias("target_id"))
    assert [r.text for r in lookups.find_target(target, h).collect()] == ["a"]
    known = {"plain": None, "deep": "rr", "other": "zz"}
    assert lookups.select_variants(None, known, ("rr",)) == ["plain", "deep"] and lookups.select_variants(["deep"], known, ("rr",)) == ["deep"]
    for asked in ([], ["deep", "deep"], ["x"], ["other"]):
        with pytest.raises(ConstraintError):
            lookups.select_variants(asked, known, ("rr",))
    rows = spark.createDataFrame([("A", "t", C, C)], "test_dataset string, task string, gold string, prediction string")
    assert lookups.scored_datasets(rows, ("A",)).count() == 1
    for sets, rule in ((("A", "B"), "empty_dataset"), ((), "unknown_dataset"), (("B",), "unknown_dataset|empty_dataset")):
        with pytest.raises(ConstraintError, match=rule):
            lookups.scored_datasets(rows, sets or ("C",))
    assert lookups.with_dataset(rows.drop("test_dataset"), "Q").columns[0] == "test_dataset" and lookups.decorated(rows, job="j").columns[0] == "job"
    lengths = spark.createDataFrame([("a", 3), ("b", 9)], "name string, n int")
    assert tuple(lookups.length_summary(lengths, "n", 5).first()) == (2, 3, 9, 1)
    with pytest.raises(ConstraintError, match="too_long: b"):
        lookups.guard_lengths(lengths, "n", 5, "name")
    m = spark.createDataFrame([("1", "s", E), ("2", "s", C)], "id string, source_id string, label string")
    digest = lambda df: {(r.measure, r.key): r.value for r in lookups.export_manifest(df).collect()}
    assert digest(m) == digest(m.repartition(3).orderBy(F.desc("id"))) and digest(m)["sources", ""] == "1"
    assert lookups.review_snapshot(spark.createDataFrame([("d", "H  x", "P", "1", " entailment ")], "document string, hypothesis string, premise string, article_number string, expert_label string")).first().label == E


class Lengths:
    configuration, max_tokens = {"model": "m"}, 3

    def token_lengths(self, texts):
        return [len(t.split()) for t in texts]

    def encode_documents(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def encode_query(self, text):
        return [0.0, 1.0]

    def score(self, query, documents):
        return [float(len(d) + len(query)) for d in documents]


def test_models(spark, tmp_path):
    df = spark.createDataFrame([("a b", "q"), ("c", "q"), ("d d d", "r")], "text string, query string")
    assert [r.vector for r in models.encode(df, Lengths()).collect()] == [[3.0, 1.0], [1.0, 1.0], [5.0, 1.0]]
    with pytest.raises(Exception, match="more than 3 tokens"):
        models.encode(spark.createDataFrame([("a b c d",)], "text string"), Lengths()).collect()
    assert [r.reranker_score for r in models.rerank_scores(df, Lengths(), document="text").collect()] == [4.0, 2.0, 6.0]
    pairs = spark.createDataFrame([("p", "h"), ("pp", "h")], "premise string, hypothesis string")
    assert [r.prediction for r in models.classify(pairs, lambda p, h: [[1.0, 1.0, float(len(x) > 1) * 2] for x in p], (C, E, N)).collect()] == [C, N]
    folder = str(tmp_path)

    def send(payload):
        with open(f"{folder}/{hashlib.md5(payload['m'].encode()).hexdigest()}", "a") as f:
            f.write("x")
        return {"text": payload["m"].upper()}

    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, prompt string")
    first, new = models.ask_server(asked, send, lambda p: {"m": p})
    new.write.parquet(f"{folder}/cache")
    cache = spark.read.parquet(f"{folder}/cache")
    assert cache.count() == 2 and os.path.getsize(f"{folder}/{hashlib.md5(b'a').hexdigest()}") == 1
    second, fresh = models.ask_server(asked, lambda p: 1 / 0, lambda p: {"m": p}, cache)
    assert {r.id: json.loads(r.response)["text"] for r in second.collect()} == {1: "A", 2: "B", 3: "A"} and fresh.count() == 0
    calls = []

    def flaky(payload):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("gone")
        return {"n": len(calls)}

    assert models.with_retry(flaky, 3, 0)({}) == {"n": 3}
    with pytest.raises(ConnectionError):
        models.with_retry(lambda p: (_ for _ in ()).throw(ConnectionError("x")), 2, 0)({})
    answers = iter([{}, {}, {"content": 1}])
    assert models.poll(lambda: next(answers), wait=0) == {"content": 1}
    with pytest.raises(TimeoutError):
        models.poll(dict, polls=2, wait=0)
    assert models.retriever_for(lambda b, d: (lambda q: q), {"a": 1}, {"a": 1})(df) is df
    with pytest.raises(ConstraintError):
        models.retriever_for(lambda b, d: None, {"a": 1}, {"a": 2})


def test_token_budgets():
    rng = random.Random(1)
    words = [rng.randint(1, 9) for _ in range(30)]
    for most in (0, 5, 40, 1000):
        kept = models.longest_suffix(words, lambda p: sum(p) <= most)
        assert sum(kept) <= most and (len(kept) == 30 or sum(words[30 - len(kept) - 1 :]) > most)
    plan = models.plan_batches(words, 4, 24)
    assert sorted(i for b in plan for i in b) == list(range(30)) and all(len(b) <= 4 and max(words[i] for i in b) * len(b) <= 24 for b in plan)
    assert models.plan_batches([100, 1], 4, 24) == [[0], [1]]
    assert models.supervised_row([1, 2], [1, 2, 3], 5) == {"input_ids": [1, 2, 3], "labels": [-100, -100, 3]}
    for bad in (([1, 9], [1, 2, 3], 5), ([1, 2], [1, 2], 5), ([1], [1, 2, 3], 2)):
        with pytest.raises(ConstraintError):
            models.supervised_row(*bad)


def test_discovery(spark, tmp_path):
    for d in ("l/Val", "l/autotest", "r/val", "r/Autotest"):
        os.makedirs(tmp_path / d)
    assert [n for n, _, _ in discovery.paired_datasets(str(tmp_path / "l"), str(tmp_path / "r"), ("VAL",))] == ["Val", "autotest"]
    os.makedirs(tmp_path / "l/alone")
    with pytest.raises(ConstraintError, match="alone"):
        discovery.paired_datasets(str(tmp_path / "l"), str(tmp_path / "r"))
    (tmp_path / "p.py").write_text("A = 'x'\nB: dict = {'k': [1]}\nC = A + 'y'\nraise SystemExit\n")
    found, digest = discovery.prompt_constants(str(tmp_path / "p.py"), ["A", "B"])
    assert found == {"A": "x", "B": {"k": [1]}} and len(digest) == 64
    for names in (["C"], ["D"]):
        with pytest.raises(ConstraintError):
            discovery.prompt_constants(str(tmp_path / "p.py"), names)
    for n in ("m1", "m2"):
        os.makedirs(tmp_path / "models" / n)
        (tmp_path / "models" / n / "manifest.json").write_text(json.dumps({"name": n}))
    assert [m["name"] for m in discovery.model_artifacts(str(tmp_path / "models"))] == ["m1", "m2"]
    (tmp_path / "models/list.json").write_text('["m2"]')
    assert [m["name"] for m in discovery.model_artifacts(listed=str(tmp_path / "models/list.json"))] == ["m2"]
    office.write_docx([("т", "")], str(tmp_path / "b.docx"))
    assert discovery.chosen_documents([str(tmp_path / "b.docx")] * 2) == [str(tmp_path / "b.docx")]
    for paths in ([], [str(tmp_path / "p.py")], [str(tmp_path / "none.docx")]):
        with pytest.raises(ConstraintError):
            discovery.chosen_documents(paths)
    inventory = discovery.code_inventory(spark, str(tmp_path / "b.docx"), spark.read.format("binaryFile").load(str(tmp_path / "b.docx")).select("path", F.lit("закон № 5-ФЗ").alias("text"))).first()
    assert inventory.law_numbers == ["5-ФЗ"]
    spark.range(3).write.parquet(str(tmp_path / "bundle/corpus"))
    spark.range(2).write.parquet(str(tmp_path / "bundle/index"))
    names = {}
    for t in ("corpus", "index"):
        files = spark.read.format("binaryFile").load(str(tmp_path / "bundle" / t)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256")).where(~F.col("path").startswith("_"))
        names |= {t: t, f"{t}_sha256": tables.tree_hash(files).first().sha256}
    (tmp_path / "bundle/manifest.json").write_text(json.dumps(names))
    assert discovery.load_bundle(spark, str(tmp_path / "bundle"))[0].count() == 3
    (tmp_path / "bundle/manifest.json").write_text(json.dumps(names | {"index_sha256": "x"}))
    with pytest.raises(ConstraintError):
        discovery.load_bundle(spark, str(tmp_path / "bundle"))
    svg = discovery.grouped_bars([("a<b", {"precision": 0.5, "recall": None})], ["precision", "recall"])
    assert svg.count("<rect") == 1 and "a&lt;b" in svg


def test_archive(spark, tmp_path):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for n in "ab":
        (tmp_path / n).write_bytes(n.encode())
    moves = [(str(tmp_path / n), str(tmp_path / "old" / n), digest(n.encode())) for n in "ab"]
    with pytest.raises(ConstraintError):
        discovery.move_to_archive([moves[0], (*moves[1][:2], "x")])
    assert (tmp_path / "a").exists()
    done = discovery.move_to_archive(moves)
    assert not (tmp_path / "a").exists() and (tmp_path / "old/b").exists()
    discovery.take_back(done)
    assert (tmp_path / "a").exists() and not (tmp_path / "old/a").exists()
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    plan, bad = discovery.archive_plan(files, spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, sha256 string"))
    assert sorted(r.path for r in plan.collect()) == ["a", "b"] and sorted((r.rule, r.key) for r in bad.collect()) == [("changed", "b"), ("not_found", "c")]


def test_staged_sinks(spark, tmp_path):
    df = spark.range(3)
    tables.write_tables({"t": df}, str(tmp_path / "out"))

    def broken(at):
        df.write.parquet(f"{at}/t")
        raise ValueError("no")

    with pytest.raises(ValueError):
        tables.replace(broken, str(tmp_path / "out"), spark)
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 3 and sorted(os.listdir(tmp_path)) == ["out"]
    tables.write_workbook({"s": df.select(F.col("id").cast("string").alias("x"))}, str(tmp_path / "w.xlsx"), {"k": "v"})
    assert {r.sheet for r in office.read_xlsx(spark, str(tmp_path / "w.xlsx")).collect()} == {"s", "run_metadata"}
    with pytest.raises(ConstraintError):
        tables.write_workbook({"s": df}, str(tmp_path / "w.xlsx"), most=2)
    found = spark.createDataFrame([(1, ["a"], {"a": ["p"]}, {"f": ["q"]}), (2, [], {}, {})], "doc_id long, reasons array<string>, evidence map<string,array<string>>, flags map<string,array<string>>")
    os.makedirs(tmp_path / "review")
    tables.write_review_report(found, str(tmp_path / "review"))
    assert [r.value for r in spark.read.text(str(tmp_path / "review/findings")).collect()] == ["1. 1: a: p"]


def test_shared_helpers(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    assert [(r.k, r.number) for r in shared.numbered(df, ["k"]).orderBy("k").collect()] == [(i, i + 1) for i in range(500)]
    total, want = 0, []
    for i, v in rows:
        total += v
        want.append((i, total))
    assert [(r.k, int(r.s)) for r in shared.running(df, ["k"], "v", "s").orderBy("k").collect()] == want
    digest = lambda d: d.agg(shared.set_digest(F.to_json(F.struct("k", "v"))).alias("x")).first().x
    assert digest(df) == digest(df.repartition(3)) != digest(df.where("k > 0")) and len(digest(df.where("false"))) == 64


def test_split_of_groups_and_single_documents(spark):
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}" if i % 11 else None, rng.choice([1, 1, 1, 1, 2, 3, 7])) for i in range(300)]
    total = sum(n for *_, n in rows)
    sizes = {"train": total - 120, "val": 80, "test": 40}
    df = spark.createDataFrame(rows, "group_id long, stratum string, n int")
    got = {r.group_id: r.split for r in curation.grouped_split(df, sizes, 3).collect()}
    assert len(got) == 300 and got == {r.group_id: r.split for r in curation.grouped_split(df.repartition(6), sizes, 3).collect()}
    assert {s: sum(n for i, _, n in rows if got[i] == s) for s in sizes} == sizes
    for g in ("s0", "s1", "s2", None):
        mine = sum(n for i, h, n in rows if h == g)
        assert all(abs(sum(n for i, h, n in rows if h == g and got[i] == s) - mine * sizes[s] / total) <= 8 for s in sizes)
    with pytest.raises(ValueError):
        curation.grouped_split(df, {"train": 1})


def test_groups_dealt_alike_as_one_by_one():
    rng = random.Random(8)
    for _ in range(400):
        names, n, step = ["a", "b", "c"][: rng.randint(1, 3)], rng.randint(1, 4), rng.randint(1, 9)
        lacks, left = {s: rng.randint(-30, 60) for s in names}, {s: rng.randint(0, 40) for s in names}
        k = rng.randint(0, sum(v // n for v in left.values()))
        lack, room, want = dict(lacks), dict(left), dict.fromkeys(names, 0)
        for _ in range(k):
            s = max((s for s in names if room[s] >= n), key=lambda s: (lack[s], room[s], -names.index(s)))
            want[s], lack[s], room[s] = want[s] + 1, lack[s] - step, room[s] - n
        assert curation.deal_alike(k, lacks, left, n, step) == want
    with pytest.raises(ValueError):
        curation.deal_alike(3, {"a": 5}, {"a": 5}, 2, 1)


def test_split_follows_the_lack_of_each_stratum(spark):
    """Group by group, in order of size and hash, as a reader of the rule would deal them."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([1, 1, 1, 2, 3, 5])) for i in range(200)]
    total = sum(n for *_, n in rows)
    sizes = {"train": total - 90, "val": 60, "test": 30}
    of = {g: sum(n for _, h, n in rows if h == g) for g in ("x", "y", None)}
    left, used, want = dict(sizes), {}, {}
    for _, g, n in sorted(rows, key=lambda r: (-r[2], of[r[1]], r[1] is None, r[1] or "")):
        s = max((s for s in sizes if left[s] >= n), key=lambda s: (of[g] * sizes[s] - used.get((g, s), 0) * total, left[s], -list(sizes).index(s)))
        left[s] -= n
        used[g, s] = used.get((g, s), 0) + n
        want[g, n, s] = want.get((g, n, s), 0) + 1
    found = {}
    split = {r.group_id: r.split for r in curation.grouped_split(spark.createDataFrame(rows, "group_id long, stratum string, n int"), sizes).collect()}
    for i, g, n in rows:
        found[g, n, split[i]] = found.get((g, n, split[i]), 0) + 1
    assert found == want


def _one_by_one(found, barred, closed, weights, controls, target, least, reached, controlled, seed):
    """Held-out dealing, one source after the other, over all candidates in a list."""
    order = generation.seeded_order(found, seed)
    best = lambda c, left: max(((c.hits.get(r, 0), n, r) for r, n in left.items() if n > 0 and (*c.key, r) not in barred), default=None)
    open_, taken, picks = max(0, target - reached), set(closed), []
    left = generation.quotas(weights, open_, least if open_ >= least * len(weights) else 1 if open_ >= len(weights) else 0)
    for source in dict.fromkeys(c.source_id for c in order):
        got = [(best(c, left), c) for c in order if c.source_id == source and source not in taken]
        if got := [x for x in got if x[0]]:
            (_, _, rule), c = max(got, key=lambda x: x[0])
            picks.append((*c.key, rule))
            left[rule] -= 1
            taken.add(source)
    short = {r: n for r, n in left.items() if n}
    left = generation.quotas(controls, max(0, max(1, round(target * sum(controls.values()) / sum(weights.values()))) - controlled)) if controls else {}
    for c in order:
        if c.source_id not in taken and (b := best(c, left)):
            picks.append((*c.key, b[2]))
            left[b[2]] -= 1
            taken.add(c.source_id)
    return picks, short | {f"control:{r}": n for r, n in left.items() if n}


def test_heldout_schedule_in_spark(spark):
    rng = random.Random(3)
    barred_of = lambda rows: spark.createDataFrame(rows, "source_id string, hypothesis_id string, rule_id string")
    closed_of = lambda rows: spark.createDataFrame([(x,) for x in rows], "source_id string")
    many = [Candidate(f"s{i // 3}é", f"h{i}", {r: rng.randrange(3) for r in ("r1", "r2", "k1") if rng.random() < 0.4}) for i in range(90)]
    barred = [(*c.key, r) for c in many for r in ("r1", "r2", "r3", "k1", "k2") if rng.random() < 0.5 or int(c.hypothesis_id[1:]) < 40]
    table = spark.createDataFrame([(*c.key, c.hits) for c in many] + [(None, "h", {}), ("s", None, {}), (*many[80].key, many[80].hits)], "source_id string, hypothesis_id string, hits map<string,int>")
    for target, least, reached, controlled, closed in ((10, 3, 2, 0, []), (10, 1, 0, 1, ["s29é", "s28é", None]), (200, 1, 5, 0, ["s20é"]), (0, 1, 0, 0, []), (3, 3, 9, 0, [])):
        args = {"r1": 1.0, "r2": 3.0, "r3": 2.0}, {"k1": 1.0, "k2": 2.0}, target, least, reached, controlled, 5
        if target == 0:
            args = args[0], {}, *args[2:]
        want = _one_by_one(many, set(barred), closed, *args)
        got = generation.schedule_heldout(table, barred_of(barred), closed_of(closed), *args)
        assert ([(p.source_id, p.hypothesis_id, p.rule_id) for p in got.picks], dict(got.shortage)) == want
    empty = generation.schedule_heldout(table.where("false"), barred_of([]), closed_of([]), {"r1": 1.0}, {"k": 1.0}, 10, 1, 0, 0, 5)
    assert not empty.picks and empty.shortage == {"r1": 10, "control:k": 10}


def test_failed_assignments_are_kept_and_dealt_again(spark):
    plan = spark.createDataFrame([("a1", "s1", "h1", "r1", "planned"), ("a2", "s2", "h2", "r1", "planned"), ("a3", "s3", "h3", "r1", "inactive"), ("a4", "s4", "h4", "r1", None)], "assignment_id string, source_id string, target_hypothesis_id string, rule_id string, planned_status string")
    key = "source_id string, target_hypothesis_id string, rule_id string"
    feedback = spark.createDataFrame([("s1", "h1", "r1", "needs_review", "no contradiction", 1), ("s1", "h1", "r1", "needs_review", "none at all", 2), ("s2", "h2", "r1", "done", "", 1), ("s2", "h2", "r2", "needs_review", "x", 1)], f"{key}, status string, rationale string, at int")
    unusable = spark.createDataFrame([("s4", "h4", "r1"), ("s4", "h4", "r1"), ("s1", "h1", "r1")], key)
    active, failed = generation.apply_feedback(plan, feedback, unusable)
    assert [r.assignment_id for r in active.collect()] == ["a2"] and active.columns == plan.columns
    assert {r.assignment_id: (r.planned_status, r.failure_reason) for r in failed.collect()} == {
        "a1": ("needs_review", "none at all"), "a3": ("inactive", None), "a4": ("needs_review", "Applied variant lacks a usable retrieved contradiction target")
    }
    # the failed rule isn't dealt to its hypothesis again, another is; a source whose variant was applied stays closed
    found = spark.createDataFrame([("s1", "h1", {"r1": 5}), ("s4", "h4", {"r1": 9})], "source_id string, hypothesis_id string, hits map<string,int>")
    barred = failed.select("source_id", F.col("target_hypothesis_id").alias("hypothesis_id"), "rule_id")
    again = generation.schedule_heldout(found, barred, unusable.where("source_id = 's4'"), {"r1": 1.0, "r2": 1.0}, {}, 2, 1, 0, 0, 1)
    assert [(p.hypothesis_id, p.rule_id) for p in again.picks] == [("h1", "r2")] and again.shortage == {"r1": 1}
