import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import audit, curation, retrieval, scoring, similarity
from docketry.schemas import LABELS, ConstraintError, reject, violations
from docketry.streaming import ledger

C, E, N = LABELS


def test_scores_and_classes(spark):
    rows = [(C, C), (C, E), (E, E), (N, None), (E, N)]
    df = spark.createDataFrame(rows, "gold string, prediction string")
    s = scoring.scores(df).first()
    assert (s.support, s.accuracy, s.invalid_count, s.contradiction_precision, s.contradiction_recall) == (5, 0.4, 1, 1.0, 0.5)
    assert abs(s.macro_f1 - (2 / 3 + 1 / 2 + 0) / 3) < 1e-12 and abs(s.weighted_f1 - (2 * 2 / 3 + 2 * 0.5) / 5) < 1e-12
    cells = {(r.gold, r.prediction): r.n for r in scoring.confusion(df).collect()}
    assert len(cells) == 12 and cells[N, "invalid"] == 1 and cells[N, C] == 0
    assert {r.label: r.support for r in scoring.per_class(df).collect()} == {C: 2, E: 2, N: 1}
    empty = scoring.scores(df.where("false")).first()
    assert empty.support == 0 and empty.accuracy == 0 and empty.macro_f1 == 0


def test_precedence(spark):
    df = spark.createDataFrame([([N, E, C],), ([N, E],), ([N, None],), ([None],), ([],)], "l array<string>")
    assert [r.x for r in df.select(scoring.precedence("l").alias("x")).collect()] == [C, E, N, "invalid", "invalid"]


def test_fallback_is_used_once(spark):
    gold = spark.createDataFrame([(1, "h", "p", "a1", C, False), (2, "h", "p", "", E, False), (3, "h", "q", "a9", C, False), (4, "z", "z", "a1", E, True)], "gold_id long, hypothesis string, premise string, article string, label string, legacy boolean")
    pred = spark.createDataFrame([(1, "h", "p", "a1", C), (2, "h", "p", "a2", C), (3, "h", "p", "a3", C), (4, "h", "q", "a1", N), (5, "z", "z", None, E)], "seq long, hypothesis string, premise string, article string, prediction string")
    got = scoring.align_gold(pred, gold)
    assert {r.seq: (r.gold_id, r.gold, r.gold_source) for r in got.collect()} == {1: (1, C, "exact"), 2: (2, E, "fallback"), 3: (None, N, "inferred"), 4: (None, N, "inferred"), 5: (4, E, "fallback")}
    missed = scoring.misses(gold, got)
    assert [(r.gold_id, r.status) for r in missed.collect()] == [(3, "rag_miss")]
    assert scoring.scores(scoring.total_scope(got, missed)).first().support == 6


def test_threshold(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 1), rng.random() < 0.5) for _ in range(60)]
    best = max(((lambda tp, n, a: 2 * tp / (n + a))(sum(y for s, y in rows if s >= t), sum(s >= t for s, _ in rows), sum(y for _, y in rows)), t) for t in {s for s, _ in rows})
    r = scoring.best_threshold(spark.createDataFrame(rows, "score double, positive boolean")).first()
    assert abs(r.f1 - best[0]) < 1e-12 and r.threshold == best[1]


def test_topk_over_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 30)
    v = np.random.default_rng(0).integers(-2, 3, (150, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 4)], "id long, vector array<double>")
    got = {}
    for r in retrieval.vector_topk(df, df, 7, exclude_same_id=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    fine = [i for i in range(150) if v[i].any()]
    u = {i: v[i] / np.linalg.norm(v[i]) for i in fine}
    for q in fine:
        s = sorted(((round(float(u[q] @ u[i]), 9), -i) for i in fine if i != q), reverse=True)[:7]
        assert [(i, sc) for i, sc in got[q]] == [(-i, sc) for sc, i in s]
    assert set(got) == set(fine)


def test_rerank_and_depths(spark):
    df = spark.createDataFrame([(1, i, i, s) for i, s in enumerate([0.1, 0.9, 0.9, 0.5], 1)], "query_id long, id long, rank int, reranker_score double")
    out = retrieval.rerank(df)
    assert [r.id for r in out.orderBy("rank").collect()] == [2, 3, 4, 1]
    assert [r.id for r in retrieval.depth_slice(out, 3, 2).orderBy("rank").collect()] == [2, 3]
    for bad in ([], [(5, 6)], [(5, 0)], [(5, 5), (5, 5)]):
        with pytest.raises(ValueError):
            retrieval.check_depths(bad)


def test_injected_predictor(spark):
    df = spark.createDataFrame([("a b", "a"), ("c", "a")], "premise string, hypothesis string")
    out = retrieval.score_pairs(df, lambda p, h: p.combine(h, lambda x, y: C if y in x else N))
    assert [r.prediction for r in out.collect()] == [C, N]


def test_recall_counts(spark):
    hits = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (2, "x", 9)], "query_id long, item string, rank int")
    gold = spark.createDataFrame([(1, "x"), (1, "z"), (2, "x")], "query_id long, item string")
    assert {r.depth: (r.hits, r.gold) for r in retrieval.recall_at_depths(hits, gold, [1, 3, 10]).collect()} == {1: (0, 3), 3: (1, 3), 10: (2, 3)}


def test_nearest_by_library_formula(spark):
    import math

    train, queries = [(1, "The cat  sat"), (2, "a dog ran"), (3, "the cat sat")], [(10, "the cat sat"), (11, "zzz"), (12, "dog"), (13, "")]

    def grams(t):
        t, out = " ".join(t.lower().split()), {}
        for k in (3, 4, 5):
            for i in range(len(t) - k + 1):
                out[t[i : i + k]] = out.get(t[i : i + k], 0) + 1
        return out

    df = {}
    for _, t in train:
        for g in grams(t):
            df[g] = df.get(g, 0) + 1

    def vector(t):
        w = {g: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[g])) + 1) for g, n in grams(t).items() if g in df}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / length for g, x in w.items()}

    got = {r.id: (r.neighbour, r.score) for r in similarity.nearest(spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(train, "id long, text string")).collect()}
    for i, t in queries:
        q = vector(t)
        want = max(((round(sum(x * vector(s).get(g, 0) for g, x in q.items()), 9), -j) for j, s in train))
        assert got[i][0] == -want[1] and abs(got[i][1] - min(want[0], 1)) < 1e-8
    assert got[11] == got[13] == (1, 0.0)


def test_pair_scores_use_one_row(spark):
    t = spark.createDataFrame([(1, "alpha beta", "unrelated text"), (2, "other words", "gamma delta")], "id long, premise string, hypothesis string")
    q = spark.createDataFrame([(9, "alpha beta", "gamma delta")], "id long, premise string, hypothesis string")
    r = similarity.nearest_pairs(q, t).first()
    assert (r.premise_neighbour, r.hypothesis_neighbour, r.pair_neighbour) == (1, 2, 1) and r.premise_score == r.hypothesis_score == 1.0 and r.pair_score < 0.6


def test_diffs(spark):
    a = spark.createDataFrame([(1, "k", "x"), (2, "k", "y"), (3, "l", None), (4, "m", "x")], "seq int, pair_key string, label string")
    b = spark.createDataFrame([(1, "k", "x"), (2, "l", None), (3, "n", "z")], "seq int, pair_key string, label string")
    got = {r.pair_key: (r.status, r.legacy_rows, r.label_changed) for r in audit.snapshot_diff(a, b).collect()}
    assert got == {"k": ("shared", 2, False), "l": ("shared", 1, False), "m": ("legacy_only", 1, False), "n": ("current_only", None, False)}
    d = audit.run_diff(a, b, value="label")
    assert {(r.pair_key, r.occurrence): r.status for r in d.collect()} == {("k", 0): "shared", ("k", 1): "removed", ("l", 0): "shared", ("m", 0): "removed", ("n", 0): "added"}
    assert {r.measure: r.value for r in audit.run_diff_summary(d).collect()} == {"shared": 2, "added": 1, "removed": 2, "changed": 0, "unchanged": 2}
    none = audit.snapshot_diff(a.where("false"), b)
    assert {r.status for r in none.collect()} == {"current_only"}


def test_fallback_merge(spark):
    a = spark.createDataFrame([("x", ["1"]), ("y", ["2", "1"])], "k string, v array<string>")
    b = spark.createDataFrame([("y", ["1", "2"]), ("x", ["9"]), ("z", ["3"])], "k string, v array<string>")
    merged, clash = audit.fallback_merge(a, b, "k", "v")
    assert {r.k: r.v for r in merged.collect()} == {"x": ["1"], "y": ["2", "1"], "z": ["3"]} and [r.key for r in clash.collect()] == ["x"]


def test_groups_and_split(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, *"abcdefgh"]), f"c{rng.randrange(40)}", f"s{i % 3}") for i in range(100)] + [(200 + i, f"p{i}", f"p{i + 1}", "s0") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a string, b string, s string")
    groups = {r.id: r.group_id for r in curation.duplicate_groups(df, "id", [F.col("a"), F.col("b")]).collect()}
    up = {i: i for i, *_ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a, b, _ in rows:
        for j, c, e, _ in rows:
            if (a and a == c) or b == e:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    assert groups == {i: top(i) for i in up}
    sizes = spark.createDataFrame([(g, f"s{g % 3}", list(groups.values()).count(g)) for g in set(groups.values())], "group_id long, stratum string, n int")
    wanted = {"train": 110, "val": 10, "test": 10}
    split = curation.grouped_split(sizes, wanted)
    n = {r.group_id: r.n for r in sizes.collect()}
    got = {}
    for r in split.collect():
        got[r.split] = got.get(r.split, 0) + n[r.group_id]
    assert got == {k: v for k, v in wanted.items() if v} and split.orderBy("group_id").collect() == curation.grouped_split(sizes, wanted).orderBy("group_id").collect()
    with pytest.raises(ValueError):
        curation.grouped_split(sizes, {"train": 1})


def test_quotas_by_brute_force(spark):
    rng = random.Random(5)
    for _ in range(5):
        w, total, least = [rng.randint(1, 9) for _ in range(rng.randint(1, 7))], rng.randint(20, 60), rng.randint(0, 2)
        rest = total - least * len(w)
        exact = [rest * x / sum(w) for x in w]
        quota = [least + int(x) for x in exact]
        for i in sorted(range(len(w)), key=lambda i: (-round(exact[i] - int(exact[i]), 9), i))[: total - sum(quota)]:
            quota[i] += 1
        df = spark.createDataFrame([(i, float(x), i) for i, x in enumerate(w)], "key int, weight double, ordinal int")
        assert [r.quota for r in curation.largest_remainder(df, total, least).orderBy("key").collect()] == quota


def test_edits_by_brute_force(spark):
    rng, rows, want = random.Random(7), [], []
    for k in range(60):
        text, at, edits = "".join(rng.choice("abcdé") for _ in range(30)), 0, []
        while at < 28 and len(edits) < 4:
            a = rng.randint(at, 28)
            b = min(30, a + rng.randint(0, 3))
            edits.append((a, b, text[a:b], "X" * rng.randint(0, 3)))
            at = b + 1
        s = rng.randint(0, 20)
        e = s + rng.randint(1, 9)
        out = text
        for a, b, _, new in reversed(edits):
            out = out[:a] + new + out[b:]
        delta = lambda cond: sum(len(x[3]) - (x[1] - x[0]) for x in edits if cond(x))
        want.append((out, s + delta(lambda x: x[1] <= s), e + delta(lambda x: x[0] < e)))
        rows.append((k, text, rng.sample(edits, len(edits)), s, e))
    df = spark.createDataFrame(rows, "k int, text string, edits array<struct<start:int,end:int,before:string,after:string>>, start int, end int")
    got = df.select("k", curation.edits_are_valid("text", "edits").alias("ok"), curation.apply_edits("text", "edits").alias("t"), curation.map_span("start", "end", "edits").alias("m")).orderBy("k").collect()
    assert all(r.ok for r in got) and [(r.t, r.m.start, r.m.end) for r in got] == want
    bad = spark.createDataFrame([("abc", [(0, 2, "ab", "x"), (1, 3, "bc", "y")]), ("abc", [(0, 1, "z", "x")])], "text string, edits array<struct<start:int,end:int,before:string,after:string>>")
    assert [r.ok for r in bad.select(curation.edits_are_valid("text", "edits").alias("ok")).collect()] == [False, False]


def test_target_audit(spark):
    t = spark.createDataFrame([("v", "t1", 10, 20, [(0, 2, "ab", "abcd")], ["u1", "u2"]), ("v", "t2", 90, 95, [], ["u1"])], "variant_id string, target_id string, start int, end int, edits array<struct<start:int,end:int,before:string,after:string>>, gold_units array<string>")
    h = spark.createDataFrame([("v", 12, 15, ["u1"]), ("v", 21, 30, ["u3"]), ("v", 22, 23, ["u9"])], "variant_id string, start int, end int, units array<string>")
    got = {r.target_id: (r.start, r.end, r.n_hypotheses, r.missing_units, r.status) for r in curation.target_audit(t, h).collect()}
    assert got == {"t1": (12, 22, 2, ["u2"], "missing"), "t2": (90, 95, 0, ["u1"], "no_hypothesis")}


def test_registry(spark):
    reg = spark.createDataFrame([("train_000007", "a", "train"), ("val_000050", "b", "val")], "id string, stable_key string, split string")
    new = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3), ("d", 1)], "stable_key string, seq int")
    assert {r.stable_key: r.id for r in curation.register(reg, new, "train").collect()} == {"d": "train_000008", "c": "train_000009"}
    assert {r.id for r in curation.register(reg.where("false"), new.where("seq = 2"), "test").collect()} == {"test_000001"}


def test_review_and_verification(spark):
    snap = spark.createDataFrame([("1", "h", "p", C), ("2", "h", "q", E), ("3", "h", "r", N)], "id string, hypothesis string, premise string, label string")
    sheet = spark.createDataFrame([("1", "h", "p", E), ("2", "h", "CHANGED", E), ("9", "x", "y", N)], "id string, hypothesis string, premise string, label string")
    rows, bad = curation.import_review(snap, sheet)
    assert {r.id: (r.label, r.status) for r in rows.collect()} == {"1": (E, "approved"), "2": (E, "approved"), "3": (N, "excluded")}
    assert {(r.rule, r.key) for r in bad.collect()} == {("immutable_changed", "2"), ("unknown_id", "9")}
    r = spark.createDataFrame([("1", "s", "v1", "approved"), ("2", "s", "v1", "approved"), ("3", "s", "original", "approved")], "id string, source_id string, variant_id string, status string")
    v = spark.createDataFrame([("1", "dispute"), ("3", "accept")], "id string, verdict string")
    assert {x.id: x.status for x in curation.apply_verifications(r, v).collect()} == {"1": "pending", "2": "pending", "3": "approved"}


def test_overlapping_spans_of_any_length(spark):
    rng = random.Random(7)
    span = lambda: (s := rng.randrange(-3000, 3000), s + rng.choice([-5, 0, 1, 2, 3, 64, 65, rng.randrange(4000)]))
    rows = [[(rng.choice(["hot", "hot", "k1", "k2", None]), i, *rng.choice([span(), span(), (None, 3), (0, 8), (8, 16)])) for i in range(300)] for _ in range(2)]
    a, b = (spark.createDataFrame(r, "key string, id int, start long, end long") for r in rows)
    whole = lambda x: x[0] is not None and x[2] is not None and x[2] <= x[3]
    want = sorted((x[0], *x[1:], *y[1:]) for x in rows[0] for y in rows[1] if whole(x) and whole(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    out = curation.overlapping(a, b, "key")
    assert out.columns == ["key", "id", "start", "end", "other_id", "other_start", "other_end"] and len(want) > 1000
    assert sorted(map(tuple, out.collect())) == want
    assert curation.overlapping(a.where("false"), b, "key").count() == curation.overlapping(a, b.where("false"), "key").count() == 0


def test_hot_key_of_overlaps_meets_by_bins(spark):
    """20,000 short spans of one key on each side: 4e8 pairs of the key, of which bins let through few more than overlap."""
    a, b = (spark.range(20000).select(F.lit("hot").alias("key"), "id", (F.col("id") * 100 + shift).alias("start")).withColumn("end", F.col("start") + 60) for shift in (0, 50))
    out = curation.overlapping(a, b, "key")
    assert out.count() == 39999 and out.agg(F.max(F.abs(F.col("id") - F.col("other_id")))).first()[0] <= 1


def test_samples_and_schedule(spark):
    rows = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(60)], "id long, s string")
    got = curation.stratified_sample(rows, ["s"], "id", 0.1, "x")
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 5, "b": 1}
    assert sorted(got.collect()) == sorted(curation.stratified_sample(rows.repartition(5), ["s"], "id", 0.1, "x").collect())
    w = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0)], "id long, w double")
    drawn = curation.sample_with_replacement(w, "w", "id", 4000, 1).groupBy("id").count().collect()
    n = {r.id: r["count"] for r in drawn}
    assert set(n) == {2, 3} and sum(n.values()) == 4000 and abs(n[3] / 4000 - 0.75) < 0.03


def test_weights_and_reports(spark):
    df = spark.createDataFrame([(1, C), (2, C), (3, E), (4, N)], "id int, label string")
    assert [round(r.weight, 6) for r in curation.weighted_rows(df, "label").orderBy("id").collect()] == [0.666667, 0.666667, 1.333333, 1.333333]
    assert [r.weight for r in curation.weighted_rows(df.where("id < 4"), "label").collect()] == [None] * 3
    targets = spark.createDataFrame([("train", C, 3), ("val", E, 1)], "split string, label string, target long")
    rows = spark.createDataFrame([("train", C, "d1"), ("train", C, "d1"), ("test", N, "d2")], "split string, label string, document string")
    got = {(r.split, r.label): (r.n, r.documents, r.shortage, r.excess) for r in curation.split_report(rows, targets).collect()}
    assert got == {("train", C): (2, 1, 1, 0), ("val", E): (0, 0, 1, 0), ("test", N): (1, 1, 0, 1)}


def test_violations_and_rejection(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    report = violations(df, "id", {"null": F.col("v").isNull(), "big": F.col("id") > 1})
    assert {(r.rule, r.key) for r in report.collect()} == {("null", "1"), ("big", "2")}
    with pytest.raises(ConstraintError, match="null: 1"):
        reject(report.where("rule = 'null'"))
    reject(report.where("false"))


def test_no_result_depends_on_partitions(spark):
    import __spark_entry__

    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        q = __spark_entry__.queries()
        found.append({k: sorted(map(str, q[k](spark, "/root/testdata/sf0.001").collect())) for k in ("gold_alignment", "quota_targets", "register_ids", "duplicate_groups", "task_batches", "grouped_split")})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_ledger(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, 1, "running"), ("a", 2, 2, "failed"), ("b", 1, 3, "completed")], "job_id string, ts long, seq long, status string")
    got = {r.job_id: (r.status, r.attempts) for r in ledger.latest_state(events).collect()}
    assert got == {"a": ("failed", 2), "b": ("completed", 1)}
    done = spark.createDataFrame([("a", "failed", "f1"), ("b", "completed", "f1"), ("c", "completed", "old")], "job_id string, status string, fingerprint string")
    jobs = spark.createDataFrame([(j, "f1") for j in "abcd"], "job_id string, fingerprint string")
    assert sorted(r.job_id for r in ledger.due(done, jobs).collect()) == ["a", "c", "d"]
    pages = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "page_id long, html string")
    assert sorted(r.page_id for r in ledger.new_contents(pages).collect()) == [1, 3]
    pages.write.parquet(str(tmp_path / "in"))
    stream = ledger.stream_new_contents(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")))
    write = lambda: stream.writeStream.foreachBatch(ledger.upsert_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    write()
    spark.createDataFrame([(4, "y"), (5, "z")], "page_id long, html string").write.mode("append").parquet(str(tmp_path / "in"))
    write()
    assert {r.html for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"x", "y", "z"} and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_bounded_stream_and_resumed_preparation(spark, tmp_path):
    import datetime

    pages = spark.createDataFrame([(1, "x", datetime.datetime(2020, 1, 1)), (2, "x", datetime.datetime(2020, 1, 2)), (3, "y", datetime.datetime(2020, 1, 3))], "page_id long, html string, at timestamp")
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger.stream_new_contents(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), "at")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.html for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]
    variants, asked = spark.createDataFrame([("v1",), ("v2",)], "variant_id string"), []

    def prepare(df):
        asked.append(sorted(r.variant_id for r in df.collect()))
        return df.withColumn("pairs", F.lit(len(asked)))

    run = lambda rows, mark: {r.variant_id: r.pairs for r in ledger.prepare_missing(rows, str(tmp_path / "prepared"), mark, prepare).collect()}
    assert run(variants.where("variant_id = 'v1'"), "a") == {"v1": 1} and run(variants, "a") == {"v1": 1, "v2": 2} and run(variants, "a") == {"v1": 1, "v2": 2} and run(variants, "b") == {"v1": 3, "v2": 3}
    assert asked == [["v1"], ["v2"], ["v1", "v2"]]
