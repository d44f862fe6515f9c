import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketry.llm.common import fresh_path
from docketry.llm.token_store import Store, WordEncoder, crc_shift, cut, cuts, rolling, token_digests, write_store
from docketry.llm.words import word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(3)


def _texts():
    words = ["Oneouen", "don't", "naïve,", "ÉCOLE", "x1y22", "<|endoftext|>", "a b", "été", "日本語", "***", "İstanbul", "ΑΣ", " q", "the."]
    out = [None, "", "   ", "<|startoftext|> hi"]
    out += [" ".join(rng.choice(words) + rng.choice(["", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    long = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(6000))
    return out + [long, "prefix words first " + long, long, "no blank " + "xyzzy" * 60_000 + " end"]


TEXTS = _texts()


def test_words_encode_as_whole_texts():
    whole = Tokenizer.from_file(PATH)
    small = WordEncoder(PATH, "<u2", words=40)  # starts over again and again
    for t, packed in zip(TEXTS, small.encode([None if x is None else x.encode() for x in TEXTS]), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_ids_do_not_depend_on_words_met_before():
    """Signs alone, as words and as ends of words, in random order; each text is met by warm tables of several sizes."""
    own, whole = random.Random(11), Tokenizer.from_file(PATH)
    signs = [*".,;:!?*#$%&)(\"'-=/<>|[]{}@~`^+_"]
    parts = [*signs, *signs, "yes", "a", "é", "ß", "日", "7", "²", "x1", "'s", "'ll", "a\u0301", "<|endoftext|>", "No"]
    texts = [" ".join("".join(own.choice(parts) for _ in range(own.randint(1, 4))) for _ in range(own.randint(1, 5))) for _ in range(100_000)]
    texts += ["'", "a '?", '"', 'He said "yes ".', "-", "-.", "/", "/.", "=", "=;", "(", "(."]
    want = [array("H", e.ids).tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    for words in (300, 700_000):
        encoder = WordEncoder(PATH, "<u2", words=words)
        packed = [t.encode() for t in texts]
        assert encoder.encode(packed) == want
        assert encoder.encode(packed[::-1]) == want[::-1]


def test_a_text_is_encoded_in_one_pass_over_its_words():
    """Words are learned as they are met, also where a table turns over, and none too long is held."""
    whole, encoder = Tokenizer.from_file(PATH), WordEncoder(PATH, "<u2", words=8)
    texts = ["école über, straße ąę ɂ ɏ ʒ Ⱥ ÷ x÷ ﬁ naïve's", "q" * 300 + " q", "über über école, straße"]
    for t in texts * 2:
        assert np.frombuffer(encoder.encode([t.encode()])[0], "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids
        assert max(map(len, [*encoder.known, *encoder.older, b""])) <= 256 and len(encoder) <= 20
    assert encoder.known["über".encode()] and encoder.known[b"never-met"] and b"never-met" in encoder.known


def test_digests_do_not_depend_on_partitions(spark):
    rows = [(1, 'a " b \' ('), (2, 'He said "yes ".'), (3, "a '?"), (4, "(. -. =;"), (5, None)]
    found = [sorted(map(tuple, token_digests(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(n, "doc_id"), PATH).collect())) for n in (1, 2, 5)]
    assert found[0] == found[1] == found[2]
    whole = Tokenizer.from_file(PATH)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert [(r[0], r[2], r[3]) for r in found[0]] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in sorted(ids.items())]


def test_checksums_join():
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(0, 3000)) for _ in range(rng.randint(1, 6))]
        after = np.cumsum([0, *(len(p) for p in parts[:0:-1])])[::-1]
        shifted = crc_shift(np.array([zlib.crc32(p) for p in parts], np.uint32), after)
        assert np.bitwise_xor.reduce(shifted) == zlib.crc32(b"".join(parts))


def test_long_words_that_sums_of_powers_confuse(spark):
    """Words of 1,024 to 2,048 bytes whose polynomial hashes modulo 2^64 agree under every odd base."""
    whole, pair = Tokenizer.from_file(PATH), ["a", "b"]
    while len(pair[0]) < 2048:
        pair = [pair[0] + pair[1], pair[1] + pair[0]]
        if len(pair[0]) >= 256:
            small = WordEncoder(PATH, "<u2")
            for t, packed in zip(pair * 2, small.encode([x.encode() for x in pair * 2]), strict=True):
                assert np.frombuffer(packed, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids
    assert word_hashes(pair[0].encode())[0] != word_hashes(pair[1].encode())[0]


def test_cuts_follow_content():
    ids = np.random.default_rng(0).integers(0, 49000, 20000).astype(np.uint16)
    ends = cut(ids)
    assert ends[-1] == 20000 and max(np.diff([0, *ends])) <= 2048
    moved = cut(np.concatenate([ids[:7], ids]))
    assert len({e + 7 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert cut(ids[:0]) == [] and cut(ids[:1]) == [1]


def test_round_trip(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(None if i == 7 else 100 - i, t, "x") for i, t in enumerate(TEXTS)] + [(50, TEXTS[8], "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    path = fresh_path(spark, "test-store")
    write_store(docs, path, PATH)
    store = Store(spark, path)
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(((d, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for d, t, _ in rows), key=key)
    got = sorted(store.documents().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((key((r.doc_id,)), tuple(r.ids)) for r in got) == sorted((key((d,)), x) for d, x in want)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert store.tokens == at
    crc = {r.start: r for r in store.verify().collect()}
    for r in got:
        v = crc[r.start]
        assert (v.doc_id, v.n_tokens, v.ids_crc32) == (r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    chunks = store.chunks()
    assert chunks.count() == chunks.select("digest").distinct().count() < store.references().count()
    other = fresh_path(spark, "test-store")
    write_store(docs.repartition(5), other, PATH)
    assert Store(spark, other).root == store.root or spark.conf.get("spark.sql.shuffle.partitions") != "4"


def test_damage_is_found(spark):
    path = fresh_path(spark, "test-store")
    write_store(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), path, PATH)
    store = Store(spark, path)
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/packs").collect()]
    for r in rows:
        r["payload"] = r["payload"] and bytes(r["payload"][:-1]) + b"\7"
    spark.createDataFrame(rows, spark.read.parquet(f"{path}/packs").schema).write.mode("overwrite").parquet(f"{path}/packs")
    with pytest.raises(Exception, match="digest"):
        store.verify().collect()


def test_empty_table(spark):
    path = fresh_path(spark, "test-store")
    write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert Store(spark, path).verify().count() == 0 and Store(spark, path).tokens == 0


def test_rolling_hash_is_the_same_by_table():
    import numpy as np

    from docketry.llm import token_store

    ids = np.random.default_rng(3).integers(0, 1 << 16, 5000)
    assert len(token_store.rolling(ids[:0].astype("<u2"))) == 0
    assert (token_store.rolling(ids.astype("<u2")) == token_store.rolling(ids.astype("<u4"))).all()
    assert (token_store._MIXED[0] == token_store._mixed(np.arange(1 << 16))).all()  # what is held isn't written to


def test_streams_are_cut_alike_together():
    own = np.random.default_rng(5)
    streams = [own.integers(0, 40, n).astype("<u2") for n in (0, 1, 31, 32, 33, 64, 65, 700, 20_000, 5, 40_000)]
    assert cuts(streams) == [cut(x) for x in streams] and cuts([]) == []
    assert [cuts([x.astype("<u4")])[0] for x in streams] == cuts(streams)
    for x in streams[1:]:
        zeros = (np.flatnonzero(rolling(x) & np.uint64(7) == 0) + 1).tolist()
        assert [e for e in cut(x, 3, 1, 1 << 20) if e < len(x)] == [e for e in zeros if e < len(x) and len(x) > 1]
