"""The ten queries over tables with nulls in any column, empty and long texts, ties, repeated rows and clashing further columns, and over empty tables."""

import random
import zlib

import pytest

import corpus_pipeline
from docketry.llm import langid
from docketry.llm.queries import queries

rng = random.Random(11)
CLASH = ["id", "key", "print", "doc", "fp", "f0", "anchor", "component", "component_id", "found", "score", "size", "target", "taken", "copies", "cols", "n", "role", "way", "at", "of", "unit", "nth", "entry", "vector", "status", "headers", "kind", "date", "url_key"]
WANT = {
    "op1_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_passages": {"doc_a": "bigint", "doc_b": "bigint", "n_words": "bigint", "identity": "double"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_simhash_components": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_decontamination": {"doc_id": "bigint", "item_id": "bigint", "cosine": "double"},
    "op7_licences": {"doc_id": "bigint", "licences": "string"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_warc_revisits": {"page_id": "bigint", "status": "string"},
    "op10_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}


def words(n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    passage, docs = words(60), []
    for i in range(80):
        docs.append((i, words(rng.randint(1, 90)) + (" " + passage if i % 5 == 0 else ""), rng.choice(["aa", "bb"]), rng.choice(["s", "t", None])))
    docs += [(100, None, None, None), (101, "", "aa", "s"), (102, " \n ", None, "s"), (None, words(30), "bb", None), (103, words(30_000), "aa", "t"), (104, "x" * 300_000, "aa", "t"), (105, "12 34", "aa", None)]
    docs += [docs[3], docs[3], (7, words(70) + " " + passage, "aa", "s"), (106, "Permission is hereby granted, free of charge, to any person obtaining a copy", "aa", "s"), (107, "ab\x00cd é   \U0001f600", "bb", "é")]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(120)] + [(None, [1.0] * 8, 1), (200, None, None), (201, [], 1), (202, [0.0] * 8, 1), (203, [None] * 8, 1), (204, [1.0] * 5, 2), (50, [1.0] * 8, 1), (205, [1.0] * 8, 1), (206, [float("nan")] * 8, 1)]
    pages = [(i, f"http://h.org/{i % 7}", f"<title>{i % 4}</title>") for i in range(60)] + [(None, "http://h.org/1", "x"), (62, None, "x"), (65, "http://h.org/1", None), (8, "http://h.org/1", "<title>0</title>"), (8, "http://h.org/1", "<title>0</title>")]
    labels = [(i, i % 2, int(i % 6 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 1, 0)]
    bench = [(1, passage), (2, None), (3, ""), (4, words(12)), (4, words(12)), (None, "y" * 3000 + " " + words(9))]
    schema = {
        "documents": ("doc_id long, text string, lang string, source string", docs), "embeddings": ("vec_id long, embedding array<float>, label int", vectors), "pages": ("page_id long, url string, html string", pages),
        "labels": ("doc_id long, quality int, toxic int", labels), "benchmark": ("item_id long, text string", bench),
    }
    out = {}
    for name, keep in (("messy", True), ("empty", False)):
        at = out[name] = str(tmp_path_factory.mktemp(name))
        for table, (kind, rows) in schema.items():
            held = [c.split()[0] for c in kind.split(", ")]
            df = spark.createDataFrame(rows if keep else [], kind)
            if table == "documents":
                df = df.selectExpr("*", "cast(length(text) as long) n_chars")
            df.selectExpr("*", *(f"'{c}' as {c}" for c in CLASH if c not in held)).repartition(3).write.parquet(f"{at}/{table}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(WANT))
def test_messy_and_empty_tables(spark, tables, name):
    query = queries()[name]
    empty = query(spark, tables["empty"])
    assert empty.count() == 0 and WANT[name].items() <= dict(empty.dtypes).items()
    df = query(spark, tables["messy"])
    rows = df.collect()
    assert rows and WANT[name].items() <= dict(df.dtypes).items()
    docs = spark.read.parquet(f"{tables['messy']}/documents.parquet").select("doc_id", "text").collect()
    if name in ("op1_token_store", "op3_language_id", "op4_toxicity", "op5_simhash_components", "op8_mixing"):
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs)
    if name == "op1_token_store":
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert {r.n_tokens for r in rows if r.doc_id in (100, 101, 102)} == {1} and {r.ids_crc32 for r in rows if r.doc_id in (100, 101, 102)} == {zlib.crc32((2).to_bytes(4, "little"))}
    if name == "op2_passages":
        linked = {i for r in rows for i in (r.doc_a, r.doc_b)}
        assert {i for i in range(0, 80, 5)} | {7} <= linked and None not in linked
    if name == "op3_language_id":
        assert {r.lang_pred for r in rows if r.doc_id in (100, 101, 102, 105)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    if name == "op4_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op5_simhash_components":
        assert {r.component_id for r in rows if r.doc_id in (100, 101, 102)} == {100}
    if name == "op6_decontamination":
        assert {i for i in range(0, 80, 5)} | {7} <= {r.doc_id for r in rows if r.item_id == 1}
    if name == "op7_licences":
        assert {r.doc_id: r.licences for r in rows} == {106: "MIT"}
    if name == "op8_mixing":
        assert all(r.size == 0 == r.taken for r in rows if r.doc_id in (100, 101, 102)) and all(r.taken <= 3 * r.size for r in rows)
    if name == "op10_multi_index":
        assert {r.query_id for r in rows} == {0, 50, 100} and not {200, 201, 202, 203, 204, 206, None} & {r.vec_id for r in rows}


def test_passages_name_both_documents_by_doc_id(spark, tables):
    rows = queries()["op2_passages"](spark, tables["messy"]).collect()
    sides = sorted((r.doc_id, r.other_id, r.first, r.last) for r in rows)
    pairs = {(r.doc_a, r.doc_b, r.first_a, r.last_a, r.first_b, r.last_b) for r in rows}
    assert rows and set(sides) == {x for a, b, fa, la, fb, lb in pairs for x in ((a, b, fa, la), (b, a, fb, lb))}


def test_pipeline_on_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0


def test_all_languages_are_learned(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(i, f"w{letters[i % 20]}{letters[i // 20 % 20]} " * 6, f"l{i % 300:03d}") for i in range(600)]
    model = langid.learn(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert len(model.langs) == 300 and len(model.bias) == 300
