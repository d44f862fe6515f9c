import random

import numpy as np

from docketry.llm.decontamination import WHOLE, Matcher, contaminated, filter_clean, leading, read_items

rng = random.Random(6)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
COMMON = VOCABULARY[:40]


def words(n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(n)]


def subsequence(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_planted_items(spark):
    items = [words(rng.randint(15, 70)) for _ in range(30)] + [words(400), VOCABULARY[100:104]]
    docs, want = [], set()
    for i in range(120):
        body = words(rng.randint(5, 600))
        if i % 4 == 0:
            k = rng.randrange(len(items))
            held = list(items[k])
            if i % 8 == 0 and len(held) > 10:  # a paraphrase: one word in six is another
                for p in range(0, len(held), 6):
                    held[p] = rng.choice(VOCABULARY)
            at = rng.randrange(len(body))
            body[at:at] = held
            want.add((i, k))
        docs.append((i, " ".join(body), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, " ".join(items[3]), "x"), (502, " ".join(items[0][: len(items[0]) // 3]), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, print string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(90, None), (91, " - "), (92, " ".join(items[5]))], "item_id long, text string")
    rows = contaminated(df.select("doc_id", "text"), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want |= {(i, 92) for i, k in want if k == 5} | {(None, 3)}
    assert got == want
    texts = {d: (t or "").split() for d, t, _ in docs}
    for r in rows:
        if r.doc_id is not None and r.item_id < 90:
            x = items[r.item_id]
            assert abs(r.lcs - subsequence(x, texts[r.doc_id][r.first_word : r.last_word]) / len(x)) < 1e-9 and r.cosine >= 0.55
    left = filter_clean(df, bench)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, t, _ in docs if d not in {i for i, _ in want})


def test_answers_decide_on_paraphrases(spark):
    item, answer = words(40), VOCABULARY[200:206]
    part = [w if n % 3 else "other" for n, w in enumerate(item)]
    part[1], part[2] = "x1", "x2"  # 0.6 of the item: a paraphrase at most
    docs = [(1, " ".join(words(50) + part + answer)), (2, " ".join(words(50) + part + words(50)))]
    bench = spark.createDataFrame([(7, " ".join(item), " ".join(answer))], "item_id long, text string, answer string")
    got = {r.doc_id for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1}


def test_items_fill_half_of_their_windows():
    space = read_items([(n, " ".join(VOCABULARY[:n]), None) for n in range(5, 400)])
    space.axes = np.ones((len(space.vocabulary), 2), np.float32)
    matcher = Matcher(space)
    for size, items in matcher.classes:
        assert size % matcher.unit == 0 and matcher.unit <= size // 4
        assert all(0.5 <= len(space.items[k][1]) / size <= 0.8 for k in items)


def test_space_is_that_of_the_leading_singular_vectors():
    draw = np.random.default_rng(2)
    a = (draw.standard_normal((500, 90)) * 0.85 ** np.arange(90)) @ np.linalg.qr(draw.standard_normal((90, 90)))[0]
    omega = draw.standard_normal((90, 40))
    found = leading(a.T @ (a @ omega), omega)[:, :20]
    true = np.linalg.svd(a)[2][:20].T
    assert np.allclose(found.T @ found, np.eye(20), atol=1e-6)
    assert np.linalg.svd(true.T @ found)[1].min() > 0.95  # cosines of the angles between both spaces


def test_recall_of_the_cosine_against_all_windows(spark):
    """Copies and paraphrases in a benchmark of 2,000 items: what the longest common subsequence finds without the gate, the gate lets through."""
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    draw = lambda n: [vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n)]
    items = [draw(rng.randint(15, 60)) for _ in range(2000)]
    docs, planted = [], {}
    for i in range(300):
        k, body = rng.randrange(len(items)), draw(rng.randint(50, 400))
        held = list(items[k])
        for p in rng.sample(range(len(held)), int(len(held) * (0, 0.15, 0.28)[i % 3])):
            held[p] = rng.choice(vocabulary)
        at = rng.randrange(len(body))
        body[at:at] = held
        planted[i] = k
        docs.append((i, " ".join(body)))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    want = {(i, k) for i, k in planted.items() if subsequence(items[k], docs[i][1].split()) >= WHOLE * len(items[k])}
    print([sum((i, k) in got for i, k in want if i % 3 == j) / sum(i % 3 == j for i, _ in want) for j in range(3)])
    assert len(want & got) >= 0.95 * len(want)
    assert all(subsequence(items[k], docs[i][1].split()) >= 0.5 * len(items[k]) for i, k in got)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "some text")], "doc_id long, text string"), spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert contaminated(docs, bench.where("false")).count() == 0 and contaminated(docs.where("false"), bench).count() == 0
    assert filter_clean(docs, bench.where("false")).count() == 1
    assert [r.item_id for r in contaminated(docs, bench).collect()] == [1]


def test_words_that_share_a_slot_are_not_the_same(spark):
    """Words with the same leading 20 bits of their hashes, as items and in clean texts."""
    from docketry.llm.words import word_slots

    seen, pairs = {}, []
    own = random.Random(4)
    while len(pairs) < 12:
        w = "".join(own.choice("abcdefghijklmnop") for _ in range(7))
        k = int(word_slots(w.encode())[0])
        if seen.setdefault(k, w) != w:
            pairs.append((seen[k], w))
    pairs.append(("nefiopk", "pfidmhe"))
    items = [(i, a) for i, (a, _) in enumerate(pairs)] + [(100, " ".join(a for a, _ in pairs))]
    docs = [(i, f"clean text {b} more") for i, (_, b) in enumerate(pairs)] + [(100, " ".join(b for _, b in pairs)), (200, f"here {pairs[3][0]} is")]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(200, 3)}
