"""Laws that sentences mention, against a reader who goes through the mentions one after another."""

import difflib
import random

import pytest

from docketry.operators import laws


def reader(mentions):
    """The same decisions, taken in order with everything in memory."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    generic = lambda t: t.startswith("о внесении")
    cites, named = [], []
    for m in mentions:
        for c in laws.cited(m[2]):
            (named if c["named"] else cites).append((c, m))
    of = {}
    for c, _ in cites:
        if c["title"] and not generic(c["title"]):
            of.setdefault((c["number"], c["date"]), []).append(c["title"])
    law = {}
    for key in sorted(of, key=lambda k: not k[1]):
        like = [o for o in of if o in law and o[0] == key[0] and any(ratio(a, b) >= 0.8 or a in b or b in a for a in of[key] for b in of[o])]
        law[key] = law[like[0]] if like else key
    picked, alias = {}, set()
    for c, m in sorted(cites, key=lambda x: not x[0]["date"]):
        n, d = c["number"], c["date"]
        dates, names = {x["date"] for x, _ in cites if x["number"] == n and x["date"]}, {law[k] for k in law if k[0] == n}
        key = law.get((n, d)) or (min(names) if len(names) == 1 and not c["title"] else None)
        if not d and len(dates) > 1 and not key:
            continue
        key = key or (n, d or (min(dates) if len(dates) == 1 else ""))
        key = next((k for k in picked if key[1] and k[0] == n and k[1][-4:] == key[1][-4:]), key)
        picked.setdefault(key, m)
        alias |= {c["title"]} - {""}
    for c, m in named:
        t = c["title"]
        if t in alias or (c["number"] and any(k[0] == c["number"] for k in picked)):
            continue
        if not generic(t) and any(not generic(a) and (ratio(t, a) >= 0.8 or (len(t) >= 20 and (t in a or a in t))) for a in alias):
            continue
        picked[None, t] = m
        alias.add(t)
    out = {}
    for (n, d), m in picked.items():
        out.setdefault(m[:2], []).append(d if n is None else f"{n}-ФЗ" + (f" от {d}" if d else ""))
    return out


def found(spark, mentions):
    rows = laws.representative_mentions(spark.createDataFrame(mentions, "source string, sentence_index int, sentence string")).collect()
    return {(r.source, r.sentence_index): r.law_labels for r in rows}


def test_dates_names_and_aliases(spark):
    said = [
        "По Федеральному закону № 3-ФЗ действует правило.", 'Федеральный закон от 8 января 1998 г. № 3-ФЗ "О наркотических средствах" действует.', "Федеральный закон от 08.01.1998 № 3-ФЗ действует.",
        "Федеральный закон от 07.02.2011 № 3-ФЗ «О полиции» действует.", "Федеральный закон «О полиции» действует.", "Федеральный закон «О беженцах» действует.", "По Федеральному закону «О беженцах» можно.", "Указанный Федеральный закон действует.",
    ]
    mentions = [("d", i, s) for i, s in enumerate(said)]
    want = {("d", 1): ["3-ФЗ от 08.01.1998"], ("d", 3): ["3-ФЗ от 07.02.2011"], ("d", 5): ["о беженцах"]}
    assert reader(mentions) == want == found(spark, mentions)


def test_typing_errors_in_dates(spark):
    title = "«О правовом положении иностранных граждан»"
    said = [
        f"Федеральный закон от 25.07.2002 № 115-ФЗ {title} действует.", f"Федеральный закон от 25.07.2022 № 115-ФЗ {title} действует.", f"Нарушение от 17.08.2023 касается закона № 115-ФЗ от 25.07.2002 г. {title}.",
        f"Федеральный закон {title} от 25.07.2014 № 115-ФЗ действует.", "Федеральный закон № 115-ФЗ и Указ главы от 01.01.2025 № 1 «Об установлении запрета» действуют.", "Применяется ФЗ-115 «О правилах пребывания иностранцев».",
    ]
    mentions = [("d", i, s) for i, s in enumerate(said)]
    assert reader(mentions) == {("d", 0): ["115-ФЗ от 25.07.2002"]} == found(spark, mentions)


WORDS = "о правовом положении иностранных граждан полиции беженцах судебных приставах охране среды связи рекламе банках труде отходах недрах".split()


def _title(rng):
    words = rng.choice(["о", "об"]).split() + [rng.choice(WORDS) for _ in range(rng.randint(1, 4))]
    t = list(" ".join(words))
    for _ in range(rng.choice([0, 0, 1, 3])):  # slips
        t[rng.randrange(2, len(t))] = rng.choice("абвгде")
    return rng.choice(["О внесении изменений", "О" + "".join(t)[1:], "О" + "".join(t)[1:]])


@pytest.mark.parametrize("seed", range(2))
def test_random_mentions(spark, seed):
    rng, mentions = random.Random(seed), []
    pool = [_title(rng) for _ in range(25)]
    for i in range(140):
        n, title = rng.randint(1, 5), rng.choice(pool) if rng.random() < 0.5 else _title(rng)
        date = rng.choice(["01.02.2003", "02.02.2003", "5 мая 2010", "06.06.2011"])
        said = rng.choice([
            f"Федеральный закон № {n}-ФЗ", f"Федеральный закон от {date} № {n}-ФЗ", f"закон N {n} ФЗ от {date} г. «{title}»", f"Федеральный закон от {date} № {n}-ФЗ «{title}»", f"Федеральный закон «{title}»", f"Федеральный закон № {n}-ФЗ «{title}»",
            f"ФЗ-{n} «{title}»", f"ФЗ «{title}» и Федеральный закон «{rng.choice(pool)}»", "Федеральный закон действует",
        ])
        mentions.append((f"s{i // 20}", i % 20, said))
    assert found(spark, mentions) == reader(mentions)


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    titles = sorted({_title(rng).lower() for _ in range(120)} | {"".join(rng.choice("абв ") for _ in range(rng.randint(1, 7))).strip() for _ in range(80)} - {""})
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    for contained in (0, 20):
        got = {(r.x, r.y) for r in laws.similar_pairs(df, df, [], contained).collect()}
        like = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() >= 0.8 or (len(a) >= contained and (a in b or b in a))  # noqa: E731,B023
        assert got == {(a, b) for a in titles for b in titles if like(a, b)}


def test_leaders_and_pointers(spark):
    rng = random.Random(2)
    n = 60
    links = [(b, a) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.1] + [(i + 1, i) for i in range(n - 1)]
    kept = []
    for i in range(n):
        if not any((i, k) in set(links) for k in kept):
            kept.append(i)
    got = laws.leaders(spark.range(n), spark.createDataFrame(links, "id long, before long"))
    assert sorted(r.id for r in got.collect()) == kept
    chain = spark.createDataFrame([(i, i - 1 if i % 20 else None) for i in range(n)], "id long, to long")
    assert {r.id: r.root for r in laws.followed(chain).collect()} == {i: i - i % 20 for i in range(n)}


def test_mentions_of_texts(spark):
    text = "Ссылка на Федерального закона нет.\nФЗУ не закон. По ФЗ  №\t7-ФЗ и N 115 - ФЗ, № 7 ФЗ.\nПусто."
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("a", "Ф З")], "source string, text string")
    got = sorted(map(tuple, laws.law_mentions(docs).collect()))
    assert got == [("a", 1, "Ссылка на Федерального закона нет.", []), ("a", 1, "Ф З", []), ("a", 3, "По ФЗ № 7-ФЗ и N 115 - ФЗ, № 7 ФЗ.", ["7", "115"])]
    counts = laws.number_counts(laws.law_mentions(docs), spark.createDataFrame([("7",), ("7",)], "number string"))
    assert {r.number: (r.sentences, r.supplied) for r in counts.collect()} == {"7": (1, True), "115": (1, False)}
    nothing = spark.createDataFrame([], "source string, sentence_index int, sentence string")
    assert laws.representative_mentions(nothing).count() == 0
