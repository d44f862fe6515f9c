import random

import numpy as np
import xxhash

from docketry.llm import golay, simhash
from docketry.llm.components import components
from docketry.llm.simhash import components_within_two, links_within_two, near_copies, near_links, replicas

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def brute_print(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def texts():
    out = [None, "", " \t\n", "one", "One", "two words", "Two\x0bWords"]
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            if rng.random() < 0.7:
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            out.append(" ".join(other))
    return out


def test_code_is_perfect_and_near_is_complete():
    x = np.arange(0, 1 << 23, 997, dtype=np.uint64)
    homes = golay.home(x)
    assert np.bitwise_count(x ^ homes).max() <= 3 and not golay.syndrome(homes).any()
    # words within 5 bits of the zero word, dealt over the 2048 cosets
    assert sum(len(set(r)) for r in golay.errors(5).tolist()) == 1 + 23 + 253 + 1771 + 8855 + 33649


def test_replicas_hold_every_home_within_two_bits():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 20, dtype=np.uint64)

    def own(x):
        return int(golay.home(x & golay.MASK)) << 23 | int(golay.home((x >> np.uint64(23)) & golay.MASK))

    row, anchor = replicas(fp)
    sent = {(int(a), int(b)) for a, b in zip(row, anchor)}
    for i, x in enumerate(fp):
        for a in range(64):
            for b in range(a, 64):
                y = x ^ np.uint64(1 << a) ^ np.uint64(1 << b)
                h = own(y)
                assert h >= own(x) or (i, h) in sent


def test_components_match_brute_force(spark):
    t = texts()
    want = [brute_print(x) for x in t]
    comp = brute_components(want)
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate(t)], "id long, text string, fp string")
    for crowd in (256, 0):  # 0: every anchor is split
        got = {r.id: r for r in components_within_two(df, crowd=crowd).collect()}
        assert [got[i].fp & (1 << 64) - 1 for i in range(len(t))] == want
        assert [got[i].component_id for i in range(len(t))] == comp


def test_close_fingerprints_are_linked_alike_when_crowded(spark):
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_components([p & (1 << 64) - 1 for p in prints])
    for crowd in (256, 3):
        comp = {r.node: r.component for r in components(links_within_two(df, crowd)).collect()}
        assert [prints.index(comp.get(p, p)) for p in prints] == want


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert components_within_two(empty).count() == 0 and near_copies(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (8, "")], "id long, text string")
    got = sorted((str(r.id), r.component_id) for r in components_within_two(df).collect())
    assert got == [("4", 4), ("4", 4), ("8", 8), ("9", 8), ("None", 4)]
    assert sorted((str(r.id), r.group_id) for r in near_copies(df).collect()) == got


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_near_copies_by_similarity(spark):
    rows, group = [], {}
    for g in range(30):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(300)]
        for c in range(4):
            other = list(base)
            for _ in range(3 * (c > 0)):  # up to 15 of 296 shingles: similarity of 0.9 and more
                other[rng.randrange(300)] = "changed" + str(rng.randrange(10**6))
            group[len(rows)] = g * 4
            rows.append((len(rows), " ".join(other)))
    got = {r.id: r.group_id for r in near_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert sum(got[i] == group[i] for i in group) >= 0.98 * len(group)
    assert all(group[got[i]] == group[i] for i in group)


def test_rows_that_joined_a_leader_are_compared_further(spark):
    rows = []
    for g in range(20):
        a = rng.getrandbits(256)
        flips = rng.sample(range(256), 36)
        b = a ^ sum(1 << p for p in flips[:8])
        c = b ^ sum(1 << p for p in flips[8:])  # a-b 8 bits, b-c 28, a-c 36
        rows += [(3 * g + k, *((x >> 64 * i & (1 << 64) - 1) - (x >> 64 * i + 63 & 1) * (1 << 64) for i in range(4))) for k, x in enumerate((a, b, c))]
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long").coalesce(1)
    got = {frozenset((r.a, r.b)) for r in near_links(df, 30).collect()}
    assert sum({3 * g + 1, 3 * g + 2} in got for g in range(20)) >= 19


def test_recall_at_the_border(spark):
    """Of pairs at a similarity of 0.80 to 0.82, by brute force over their shingle sets, nine in ten are found, also with the tables of many more texts."""
    rows = []
    for g in range(200):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(296 - g % 20)]
        other = list(base)
        for p in rng.sample(range(10, 260, 8), 6):
            other[p] = "changed" + str(rng.randrange(10**6))
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        assert 0.79 <= len(x & y) / len(x | y) <= 0.82
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "id long, text string")
    for usual in (simhash.USUAL, 1 << 6):
        simhash.USUAL, kept = usual, simhash.USUAL
        try:
            got = {r.id: r.group_id for r in near_copies(df).collect()}
        finally:
            simhash.USUAL = kept
        assert sum(got[i] == i - 1 for i, _ in rows if i % 2) >= 0.9 * len(rows) / 2
        assert all(got[i] == i for i, _ in rows if i % 2 == 0)


def test_crowded_anchors_lose_nothing(spark, monkeypatch):
    base, rows = rng.getrandbits(256), []
    for k in range(120):
        x = base ^ sum(1 << p for p in rng.sample(range(256), rng.randint(0, 14)))
        rows.append((k, *((x >> 64 * i & (1 << 64) - 1) - (x >> 64 * i + 63 & 1) * (1 << 64) for i in range(4))))
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long").repartition(5)
    groups = []
    for cell in (4096, 10):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "SOME", 1)
        groups.append(sorted(map(tuple, components(near_links(df, 20)).collect())))
    assert groups[0] == groups[1] and len(groups[0]) == 120


def test_links_are_made_between_groups_only(spark):
    base, rows = rng.getrandbits(256), []
    for k in range(120):
        x = base ^ sum(1 << p for p in rng.sample(range(256), 14))
        rows.append((k, *((x >> 64 * i & (1 << 64) - 1) - (x >> 64 * i + 63 & 1) * (1 << 64) for i in range(4)), k % 2))
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long, of long")
    every, first, between = (near_links(d, 30, nearest=n) for d, n in ((df.drop("of"), False), (df.drop("of"), True), (df, False)))
    assert len({i for r in first.collect() for i in (r.a, r.b)}) == 120 and first.count() < every.count() / 2
    found = between.collect()
    assert found and all((r.a + r.b) % 2 for r in found) and len({i for r in found for i in (r.a, r.b)}) == 120
    alone = near_links(df.withColumn("of", df.of * 0), 30)
    assert alone.count() == 0  # of one group nothing is left to link


def test_shingle_sets_decide(spark):
    rows, near = [], {}
    for g in range(60):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(200)]
        other = list(base)
        for p in range(12, 12 + 10 * (3 if g % 2 else 6), 10):  # 15 or 30 of 196 shingles: 0.86 or 0.73
            other[p] = "changed" + str(rng.randrange(10**6))
        x, y = ({tuple(t[i : i + 5]) for i in range(196)} for t in (base, other))
        near[2 * g + 1] = len(x & y) >= 0.8 * len(x | y)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    got = {r.id: r.group_id for r in near_copies(spark.createDataFrame(rows, "id long, text string"), similarity=0.8).collect()}
    assert not any(got[i] != i for i, yes in near.items() if not yes)
    assert sum(got[i] == i - 1 for i, yes in near.items() if yes) >= 28


def test_texts_half_alike_give_no_more_links_than_texts(spark, monkeypatch):
    """A large group of texts, some of which are near copies: the links are trees, the groups those of brute force over the sets."""
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(120)]
    rows, shingles = [], []
    for i in range(240):
        other = list(base)
        for p in rng.sample(range(6), rng.randint(2, 4)) if i % 4 else []:
            other[p * 20 + 5] = f"changed{rng.randrange(3)}"
        rows.append((i, " ".join(other)))
        shingles.append({tuple(other[k : k + 5]) for k in range(len(other) - 4)})
    want = list(range(240))
    for i in range(240):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    made = []
    alike = simhash.alike

    def counted(*args):
        out = alike(*args)
        made.append((args[0].count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "alike", counted)
    for cluster in (simhash.CLUSTER, 20_000):
        monkeypatch.setattr(simhash, "CLUSTER", cluster)
        got = {r.id: r.group_id for r in near_copies(spark.createDataFrame(rows, "id long, text string").repartition(3)).collect()}
        assert [got[i] for i in range(240)] == want
    assert made[0][1] < 240 and len(made) == 2


def test_sets_of_all_pairs_of_a_cluster_are_met():
    """Against brute force, also where rows are dealt to two blocks."""
    own = np.random.default_rng(4)
    core = own.choice(1 << 30, 100, replace=False).astype(np.uint32)
    sets = [np.unique(np.concatenate([core[own.permutation(100)[: own.integers(70, 100)]], own.integers(0, 1 << 30, own.integers(0, 12)).astype(np.uint32)])) for _ in range(80)]
    fps = own.integers(0, 1 << 8, (80, 4)).astype(np.uint64)
    for block in (np.zeros(80, np.int64), np.arange(80) % 2):
        for most in (10, 16, 256):
            label = list(range(80))
            for i in range(80):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    near = int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= most and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
                    if near and (not block.any() or block[i] != block[j]):
                        label = [label[i] if x == label[j] else x for x in label]
            found = simhash.linked_within(fps, sets, block, most, 0.8)
            again = list(range(80))
            for i, j in found:
                assert again[i] != again[j]
                again = [again[i] if x == again[j] else x for x in again]
            pairs = lambda of: {(i, j) for i in range(80) for j in range(i) if of[i] == of[j]}
            assert pairs(again) == pairs(label)
