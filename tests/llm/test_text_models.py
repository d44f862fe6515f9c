import math
import random

from pyspark.sql import functions as F

from docketry.llm import langid, toxicity
from docketry.llm.words import word_hashes, word_slots

rng = random.Random(4)
PARTS = {"aa": ["ka", "lo", "mi", "tu", "ran"], "bb": ["sch", "ung", "eit", "ver", "zu"], "cc": ["ção", "nh", "lhe", "ões", "ar"]}


def text(lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_words_hash_alike_everywhere():
    a = word_hashes("Ünder  the, THE été".encode())
    assert len(a) == 4 and a[1] == a[2] and word_hashes("the".encode())[0] == a[1] and word_hashes("xx été".encode())[1] == a[3]
    assert len(word_slots(None)) == len(word_slots(b"")) == len(word_slots(b" 12 ,.")) == 0
    long = b"word " * 500_000
    assert len(set(word_slots(long).tolist())) == 1 and len(word_slots(long)) == 500_000


def test_languages_on_held_out_texts(spark):
    rows = [(i, text(g, rng.randint(3, 80)), g, "s") for i, g in enumerate(rng.choice(list(PARTS)) for _ in range(600))]
    rows += [(900, None, "aa", "s"), (901, "", None, "s"), (902, "12 34 !", "bb", "s"), (903, text("aa", 30_000), None, "s"), (903, "sch ung", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, found_by string")
    got = langid.identify(df, F.col("doc_id") % 4 != 2).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id % 4 == 2 and r.doc_id < 600]
    assert sum(r.found.lang == r.lang for r in held) >= 0.97 * len(held)
    by = {(r.doc_id, r.text): r.found for r in got}
    assert all(by[i, t].lang == "und" and by[i, t].rejected and by[i, t].score == 0 for i, t in ((900, None), (901, ""), (902, "12 34 !")))
    assert all(0 <= r.found.score <= 1 for r in got) and sum(r.found.rejected for r in held) <= 0.02 * len(held)
    assert sum(f.lang == "aa" for (i, t), f in by.items() if i == 903 and len(t) > 1000) == 1


def test_language_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(none, F.lit(True)).first().found.lang == "und"
    assert langid.identify(none.where("false"), F.lit(True)).count() == 0


def test_toxic_words_in_long_texts(spark):
    insults, rows, labels = ["grobian", "lümmel", "flegel"], [], []
    for i in range(900):
        words = text(rng.choice(list(PARTS)), rng.randint(20, 400)).split()
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, toxic))
    truth = {i: any(w in t.split() for w in insults) for i, t in rows}
    rows += [(2000, None), (2001, ""), (2002, "Grobian!"), (2002, "Grobian!")]
    docs, marks = spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1), (4, labels[2][1])], "key long, toxic int")
    model = toxicity.learn(docs, marks, F.col("key") % 5 != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.key % 5 == 0 and r.key < 900]
    assert sum((r.score >= 0.5) == truth[r.key] for r in held) >= 0.97 * len(held)
    assert all(r.score > 0.5 for r in got if r.key == 2002) and all(r.score < 0.5 for r in got if r.key in (2000, 2001))


def brute_ratio(rows, v, w, slots):
    """log P_1(w | v) - log P_0(w | v) from the definitions, by plain counting."""
    triples = {(c, u, x, y) for t, c in rows for u, x, y in zip(["", "", *t.split()], ["", *t.split()], t.split())}
    both = {t[1:] for t in triples}
    n = lambda x, y, c: len({u for k, u, p, q in triples if (k, p, q) == (c, x, y)})
    pooled = lambda x, y: len({u for u, p, q in both if (p, q) == (x, y)})
    after = {y for _, x, y in both if x == v}
    words = {y for _, _, y in both}
    holders = lambda y, cs: len({x for c, _, x, z in triples if z == y and c in cs})
    total = sum(holders(y, (0, 1)) for y in words)
    single = (holders(w, (0, 1)) + 0.5) / (total + 0.5 * slots)

    def unigram(c, backoff):
        held = {y: holders(y, (c,)) for y in words}
        every, freed = sum(held.values()), sum(min(x, toxicity.WORD) for x in held.values())
        return (max(held.get(w, 0) - toxicity.WORD, 0) + freed * backoff) / every

    alone = math.log(unigram(1, single)) - math.log(unigram(0, single))
    if pooled(v, w) <= toxicity.PAIR:
        return alone
    level = lambda k, of, lower: (max(k - toxicity.PAIR, 0) + sum(min(of(v, y), toxicity.PAIR) for y in after) * lower) / sum(of(v, y) for y in after)
    shared, p = level(pooled(v, w), pooled, single), []
    for c in (0, 1):
        of = lambda x, y, c=c: n(x, y, c)
        p.append(level(n(v, w, c), of, unigram(c, shared)) if any(of(v, y) for y in after) else unigram(c, shared))
    own = math.log(p[1]) - math.log(p[0])
    return own if abs(own - alone) > toxicity.PRUNE else alone


def test_toxicity_probabilities_by_brute_force(spark):
    letters = "abcdefgh"
    rows = [(" ".join(rng.choice(letters[: rng.choice((3, 8))]) for _ in range(rng.randint(0, 25))), int(rng.random() < 0.3)) for _ in range(40)]
    rows += rows[:5] + [("x y x y z", 1)] * 4
    model = toxicity.gather(spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, toxic int").repartition(3))
    assert len(model.keys)
    for t in [rows[0][0], rows[1][0], "a b c d e f g h", "x y z y x", "new a words b"]:
        got = model.positions(word_slots(t.encode()))
        for k, (v, w) in enumerate(zip(["", *t.split()], t.split())):
            assert abs(got[k] - brute_ratio(rows, v, w, 1 << model.bits)) < 1e-4, (t, v, w)


def test_copies_of_a_passage_count_once(spark):
    texts = [("p q r s t", 1), ("a b c", 0), ("q r", 0)]
    tables = [toxicity.counts(spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, toxic int"), 20) for rows in (texts, texts * 7)]
    assert sorted(map(tuple, tables[0].collect())) == sorted(map(tuple, tables[1].collect()))


def test_toxicity_table_grows_with_the_vocabulary(spark):
    letters = "abcdefghij"
    name = lambda n: "".join(letters[int(c)] for c in str(n))
    rows = [(" ".join(name(i * 1000 + j) for j in range(1000)).encode(), i % 2) for i in range(600)]
    model = toxicity.gather(spark.createDataFrame(rows, "text binary, toxic int"))
    assert len(model.logs) >= 2 * 600_000
    assert toxicity.table_bits(15_000_000) == 26


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x y"), (None, "x")], "key long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "key long, toxic int"), F.lit(True))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
