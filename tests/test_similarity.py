"""Nearest rows by bounds on their scores against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import similarity

WORDS = ["".join(c) for c in zip(*(iter("абвгдежзиклмнопрстуфхцчшщэюяabcdefghijklmnopqrstuvwxyz" * 4),) * 4)]


def _rows(rng, n, start):
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 7)))
    out = [(start + i, text(), text()) for i in range(n)]
    for i in range(0, n, 3):  # near copies
        out[i] = (out[i][0], " ".join(rng.choice(WORDS) if rng.random() < 0.2 else w for w in out[0][1].split()) or "x", out[i][2])
    return out


@pytest.mark.parametrize("looked_up", [3, 1000])
def test_bounds_change_nothing(spark, looked_up, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL", 0)
    monkeypatch.setattr(similarity, "FEW", 12)
    rng = random.Random(looked_up)
    q, t = (spark.createDataFrame(_rows(rng, n, s), "id long, premise string, hypothesis string") for n, s in ((60, 1000), (90, 0)))
    fields = ("premise", "hypothesis")
    want = similarity._in_blocks(q, t, fields, 9, 3, 5)
    got = similarity._nearest(q, t, fields, 9, 3, 5, looked_up)
    a, b = ({(r.id, r.measure): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 180
    # the two ways round halves differently
    assert all(a[k].neighbour == b[k].neighbour and abs(a[k].score - b[k].score) < 2e-9 for k in a)


def test_few_pairs_are_compared(spark):
    b = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    t = b.where("id % 2 = 0")
    vectors = [similarity._vectors(x, t, ("text",), 3, 5) for x in (b.where("id % 2 = 1"), t)]
    best, compared, open_ = similarity.best_matches(vectors[0].select("id", "g", "w"), vectors[1].select(F.col("id").alias("neighbour"), "g", "w"), 1.0, 9)
    assert best.count() + open_.count() == 100 and open_.count() > 80  # items that are like no other go in blocks
    copies = t.select((F.col("id") + 1_000_000).alias("id"), F.concat("text", F.lit(" x")).alias("text"))
    near = [similarity._vectors(x, t, ("text",), 3, 5) for x in (copies, t)]
    best, compared, open_ = similarity.best_matches(near[0].select("id", "g", "w"), near[1].select(F.col("id").alias("neighbour"), "g", "w"), 1.0, 9)
    assert best.where("id - 1000000 <> neighbour").count() == 0 and compared.count() < 1.2 * t.count()


def test_messy_rows(spark):
    q = spark.createDataFrame([(1, None), (2, ""), (3, "zz"), (4, "Hello  World"), (4, "Hello  World")], "id long, text string")
    t = spark.createDataFrame([(7, "hello world"), (8, "hello world"), (5, None)], "id long, text string")
    assert sorted({(r.id, r.neighbour, r.score) for r in similarity.nearest(q, t).collect()}) == [(1, 5, 0.0), (2, 5, 0.0), (3, 5, 0.0), (4, 7, 1.0)]
    assert {(r.neighbour, r.score) for r in similarity.nearest(q, t.limit(0)).collect()} == {(None, 0.0)}


def test_nearest_clients_searches_for_every_fiftieth_id_against_all(spark, tmp_path):
    from docketry.plans.queries import QUERIES

    rows = [(i, f"client number {i} of house {i % 7}", i if i % 10 else i + 1) for i in range(1, 121)] + [(150, None, 1), (200, "client number 33 of house 5", 1)]
    spark.createDataFrame(rows, "client_id long, name string, master_id long").write.parquet(f"{tmp_path}/clients.parquet")
    got = {r.id: (r.neighbour, r.score) for r in QUERIES["nearest_clients"](spark, str(tmp_path)).collect()}
    assert set(got) == {50, 100, 200} and got[200] == (33, 1.0)


def test_nearest_clients_searches_for_every_other_name(spark, tmp_path):
    from docketry.plans.queries import QUERIES

    rows = [(i, f"client number {i} of house {i % 7}", i if i % 10 else i + 1) for i in range(1, 121)] + [(150, None, 1), (200, "client number 33 of house 5", 1), (203, "client number 41 of house 6", 1)]
    spark.createDataFrame(rows, "client_id long, name string, master_id long").write.parquet(f"{tmp_path}/clients.parquet")
    got = {r.id: (r.neighbour, r.score) for r in QUERIES["nearest_clients"](spark, str(tmp_path)).collect()}
    assert set(got) == {*range(10, 121, 10), 200, 203} and got[200] == (33, 1.0) and got[203] == (41, 1.0)


def test_names_in_blocks_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TASK_QUERIES", 9)
    monkeypatch.setattr(similarity, "TASK_TRAIN", 17)
    rng = random.Random(5)
    q, t = (spark.createDataFrame([r[:2] for r in _rows(rng, n, s)] + more, "id long, text string") for n, s, more in ((70, 1000, [(3000, "##"), (3001, None), (3002, "≠≠≠≠")]), (90, 0, [(500, None)])))
    want = {r.id: r for r in similarity.nearest(q, t).collect()}  # few pairs: all in blocks of rows
    monkeypatch.setattr(similarity, "SMALL", 0)
    monkeypatch.setattr(similarity, "best_matches", None)
    got = {r.id: r for r in similarity.nearest(q, t).collect()}
    assert got.keys() == want.keys() and len(got) == 73
    assert all(got[k].neighbour == want[k].neighbour and abs(got[k].score - want[k].score) < 2e-9 for k in got)
    assert {r.neighbour for r in similarity.nearest(q, t.limit(0)).collect()} == {None}
