import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import multi_index
from docketry.llm.multi_index import search, visited

draw = np.random.default_rng(9)


def brute(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine.setdefault(i, np.array(v, float))
    out = {}
    for q, x in fine.items():
        if q % 50 == 0:
            s = [(-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in fine.items() if i != q]
            out[q] = [(i, -d) for d, i in heapq.nsmallest(k, s)]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, entry string")
    got = {}
    for r in search(df, F.col("id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_whole_walk_is_exact_with_ties_and_odd_vectors(spark):
    rows = [(i, draw.standard_normal(16).tolist()) for i in range(500)]
    same = rows[7][1]
    rows += [(i, same) for i in range(1000, 1150)]  # more copies than a result can name, some are queries
    rows += [(2000, [2 * x for x in same]), (2001, None), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0] * 3), (None, same)]
    assert run(spark, rows, share=1.0, centroids=8) == brute(rows)


def recall_of(want, got):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) / (5 * len(want))


@pytest.mark.parametrize("n", [1000, 6000])
def test_recall_on_vectors_without_clusters(spark, n):
    rows = [(i, draw.standard_normal(16).tolist()) for i in range(n)]
    assert recall_of(brute(rows), run(spark, rows)) >= 0.9


def test_walks_are_shorter_where_vectors_have_clusters(spark, monkeypatch):
    shares, measure = [], multi_index.needed_share
    monkeypatch.setattr(multi_index, "needed_share", lambda *a: shares.append(measure(*a)) or shares[-1])
    for n in (1000, 8000):
        middles = draw.standard_normal((n // 40, 16)) * 3
        rows = [(i, (middles[i % len(middles)] + 0.3 * draw.standard_normal(16)).tolist()) for i in range(n)]
        assert recall_of(brute(rows), run(spark, rows)) >= 0.9
    assert shares[1] < shares[0] < 0.25


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0] + [0.0] * 15), (50, [0.0, 1.0] + [0.0] * 14), (7, [1.0, 1.0] + [0.0] * 14)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == {} and run(spark, []) == {} and run(spark, [(3, None)]) == {}


def test_walk_goes_by_summed_distance():
    for _ in range(30):
        a, b, sizes = draw.random(6), draw.random(5), draw.integers(0, 4, (6, 5))
        enough = draw.integers(1, sizes.sum() + 1)
        cells = visited(a, b, sizes.tolist(), enough)
        seen, want = 0, set()
        for i, j in sorted(((i, j) for i in range(6) for j in range(5)), key=lambda c: a[c[0]] + b[c[1]]):
            if seen >= enough:
                break
            seen += sizes[i, j]
            want.add((i, j))
        assert {(i, j) for i, j in zip(*map(list, np.nonzero(cells)))} == want
