import random

import pytest

import corpus_pipeline
from docketry.llm.token_store import Store  # noqa: F401

rng = random.Random(12)
PARTS = {"en": ["th", "er", "on", "an", "re", "ing", "ly", "ou", "st", "ble", "ea", "nd"], "de": ["sch", "ung", "eit", "ver", "zu", "ß", "ein", "ach", "ge", "pf", "ü", "keit"]}


def words(lang, n):
    return ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) + str(rng.randrange(9)) * (rng.random() < 0.1) for _ in range(n)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    item = words("en", 30)
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "de"])
        rows.append([i, " ".join(words(lang, rng.randint(40, 200))), lang, f"src{i % 3}" if i % 7 else None])
    rows += [[1000 + k, "".join(c.upper() if c.isascii() else c for c in rows[k][1]) if k % 2 else rows[k][1], rows[k][2], "src0"] for k in range(20)]  # copies
    for k in range(20, 40):  # near copies: one word of many
        w = rows[k][1].split()
        w[len(w) // 2] = "changed"
        rows.append([1000 + k, " ".join(w), rows[k][2], "src1"])
    rows += [[2000 + k, " ".join(words("en", 60) + item + words("en", 60)), "en", "src2"] for k in range(5)]  # leaks
    rows += [[3000, "12 34 56", "en", "src0"], [3001, None, None, None], [3002, "", "de", "src0"], [None, rows[50][1] + " other words here", "en", "src1"]]
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_on_planted_cases(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        if name != "tokens":
            assert docs.columns == columns
        docs.write.mode("overwrite").parquet(f"{data}/{name}")
        docs = spark.read.parquet(f"{data}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
    assert {3000, 3001, 3002}.isdisjoint(seen["language"]) and len(seen["language"]) >= 445 - 3
    near = seen["near_duplicates"]
    assert not any(1000 + k in near for k in range(20)) and sum(1000 + k in near for k in range(20, 40)) <= 2
    assert set(range(400)) <= set(near) | (set(range(400)) - set(seen["language"]))
    clean = seen["decontamination"]
    assert not any(2000 <= (i or 0) < 2005 for i in clean) and set(near) - set(clean) == {2000 + k for k in range(5)}
    assert set(seen["mixing"]) <= set(clean)
    out = spark.read.parquet(f"{data}/tokens").orderBy("start").collect()
    assert sorted(map(str, seen["tokens"])) == sorted(map(str, seen["mixing"]))
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_run_equals_the_stages(spark, data):
    a = sorted(map(str, corpus_pipeline.run(spark, data).collect()))
    assert a == sorted(map(str, spark.read.parquet(f"{data}/tokens").collect()))


def test_mixing_by_brute_force(spark, data):
    """What the mixing stage takes of each source is near its target."""
    from test_native import brute_targets

    before, after = (spark.read.parquet(f"{data}/{n}").collect() for n in ("decontamination", "mixing"))
    sizes, taken = {}, {}
    for rows, into in ((before, sizes), (after, taken)):
        for r in rows:
            into[r.source] = into.get(r.source, 0) + len(r.text.split())
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(0.02 * target, 200)
