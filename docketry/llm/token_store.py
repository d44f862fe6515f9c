"""Content-addressed store of token ids.

Texts are encoded, a rolling hash cuts each document's id stream into chunks, every distinct chunk is stored once
under its digest, and documents are recipes (ordered lists of digests). Each recipe carries a Merkle root over its
digests, each shard of recipes a root over its documents, and the manifest a root over the shards.

Layout below the store's path (all Parquet, written by Spark's committer, so a lost executor only repeats tasks):

``packs``     kind 0: a distinct chunk (digest, n, payload: ids as little-endian unsigned integers of ``id_bytes``
              bytes); kind 1: the draft of a document's recipe, not yet in order
``recipes``   shard, row, doc_id, shard_start, n_tokens, digests, lengths, root   - ascending doc_id, nulls first
``manifest``  shard, docs, tokens, start, root; shard -1 is the whole store

Edge cases: a null or empty text is the end id alone; rows that repeat an id are kept as documents of their own,
ordered by the digest of their content; an empty table gives an empty store whose manifest holds only the total row;
further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import fresh_path, spread_join, trimmed

DIGEST = 16
#: Words held per Python worker at most; it only saves time.
CACHE_WORDS = 700_000

_WORKER: dict = {}


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged, no leaves give the digest of nothing."""
    if not leaves:
        return digest(b"")
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: Ids that a rolling hash covers.
REACH = 32


def rolling(ids: np.ndarray) -> np.ndarray:
    """Cyclic-polynomial hash of the REACH ids that end at each place (fewer at the start)."""
    return _rolled(_hashed(ids))


def _hashed(ids: np.ndarray) -> np.ndarray:
    if ids.dtype.itemsize == 2:  # few enough ids to hold all their hashes
        if not _MIXED:
            _MIXED.append(_mixed(np.arange(1 << 16)))
        return _MIXED[0][ids]
    return _mixed(ids)


def _rolled(h: np.ndarray) -> np.ndarray:
    """In parts that stay near, each with the REACH - 1 places before it."""
    out = np.empty_like(h)
    for lo in range(0, len(h), _PART):
        at = max(0, lo - REACH + 1)
        part = h[at : lo + _PART].copy()
        for s in (1, 2, 4, 8, 16):
            turned = part[:-s] << np.uint64(s)
            turned |= part[:-s] >> np.uint64(64 - s)
            part[s:] ^= turned
        out[lo : lo + _PART] = part[lo - at :]
    return out


#: Places that are hashed in one go.
_PART = 1 << 14
_MIXED: list[np.ndarray] = []


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cut(ids: np.ndarray, bits: int = 8, least: int = 64, most: int = 2048) -> list[int]:
    """Ends of the chunks of an id stream: where the rolling hash has ``bits`` low zeros, within the two bounds."""
    return cuts([ids], bits, least, most)[0]


def cuts(streams: list[np.ndarray], bits: int = 8, least: int = 64, most: int = 2048) -> list[list[int]]:
    """``cut`` of each of the streams, which are hashed in one go: zeros between them keep their windows apart."""
    sizes = np.array([len(x) for x in streams], np.int64)
    apart = np.zeros(REACH - 1, np.uint64)
    h = np.concatenate([x for ids in streams for x in (_hashed(ids), apart)]) if streams else apart
    starts = np.cumsum(sizes + len(apart)) - sizes - len(apart)
    found = np.flatnonzero((_rolled(h) & np.uint64((1 << bits) - 1)) == 0)
    lo, hi = np.searchsorted(found, starts), np.searchsorted(found, starts + sizes)
    return [_bounded((found[i:j] - at + 1).tolist() if n > least else [], n, least, most) for i, j, at, n in zip(lo.tolist(), hi.tolist(), starts.tolist(), sizes.tolist(), strict=True)]


def _bounded(places: list[int], n: int, least: int, most: int) -> list[int]:
    last, ends = 0, []
    for c in places:
        while c - last > most:
            last += most
            ends.append(last)
        if c - last >= least:
            ends.append(c)
            last = c
    while n - last > most:
        last += most
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


#: A pre-tokenizer that has this alternative splits between letters and the signs after them.
_SPLIT = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs that begin no contraction.
_TAIL = b".,;:!?*#$%&)"
#: Words of more bytes are encoded anew each time and never held.
_LONGEST = 256
#: Bytes of the letters below U+0240, which are their own normal form; words of nothing else may go to the tokenizer's model itself.
_PLAIN_BYTES = bytes([*range(0xC0), *range(0xC2, 0xC9)])


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + n for n, b in enumerate(rest)}


def _ends_a_piece(stem: bytes) -> bool:
    """Whether signs after this part of a word are always pieces of their own: it ends in a letter or an ASCII digit."""
    return stem[-1:].isalnum() or (stem[-1:] > b"\x7f" and stem.decode("utf-8")[-1].isalpha())


class _Known(dict):
    """Ids of words; those of a word that isn't there are learned."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        return self.learn(word)


class WordEncoder:
    """Encodes whole texts through a table of white-space separated words.

    The tokenizer drops white space and never joins characters across it, so a text's ids are its words' ids in
    order; ``test_token_store`` holds this against whole-text encoding. The table maps a word's bytes to its packed
    ids. It has two generations of ``words`` / 2 entries: once the younger is full it becomes the older, whose words
    are taken over as they are met again.
    """

    def __init__(self, path: str, dtype: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer, self.half, self.dtype = Tokenizer.from_file(path), max(1, words // 2), np.dtype(dtype)
        normal, split = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        # A tokenizer that lower-cases all but its special tokens may be given lower-cased ASCII: fewer words to hold.
        self.folds = "Lowercase()" in normal
        # Where letters and signs never share a token, signs after a letter are encoded on their own,
        self.parts = _SPLIT in split
        # and a run of letters is one piece, which the model takes as its bytes' letters.
        self.direct = self.folds and self.parts and "ByteLevel(add_prefix_space=False" in split and normal.count("Replace(") == normal.count(r'Replace(pattern=Regex("\s+")')
        self.letters, self.code = "".join(map(chr, map(_byte_letters().get, range(256)))), "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.specials = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails: dict[bytes, bytes] = {}
        self.known = _Known(self._learn)
        self.older: dict[bytes, bytes] = {}

    def __len__(self) -> int:
        return len(self.known) + len(self.older)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words as the whole tokenizer gives them."""
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _word(self, word: bytes) -> bytes | None:
        """Packed ids of a word of plain lower-case letters; None if it has others."""
        if not self.direct:
            return None
        if word.isalpha():  # of ASCII letters only
            if not word.islower():
                return None
            piece = word.decode("ascii")
        else:
            if word.translate(None, _PLAIN_BYTES):
                return None
            text = word.decode("utf-8")
            if not text.isalpha() or text != text.lower():
                return None
            piece = charmap_decode(word, "strict", self.letters)[0]
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _tail(self, tail: bytes) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self._whole([tail])[0]
        return self.tails[tail]

    def _learn(self, word: bytes) -> bytes:
        """Find the ids of a word that the younger generation hasn't, and hold them unless it is too long."""
        ids = self.older.get(word)
        if ids is None:
            if self.direct and word.isalpha() and word.islower():  # the same as _word, for most words
                ids = array(self.code, [t.id for t in self.tokenize(word.decode())]).tobytes()
            elif self.parts and (stem := word.rstrip(_TAIL)) != word and _ends_a_piece(stem):
                if (ids := self.known.get(stem) or self.older.get(stem) or self._word(stem)) is not None:
                    ids += self._tail(word[len(stem) :])
            else:
                ids = self._word(word)
            if ids is None:
                ids = self._whole([word])[0]
        if len(word) <= _LONGEST:
            self.known[word] = ids
        return ids

    def _text(self, text: bytes) -> bytes:
        packed = b"".join(map(self.known.__getitem__, text.split()))
        if len(self.known) >= self.half:
            self.known, self.older = _Known(self._learn), self.known
        return packed

    def _folded(self, text: bytes) -> bytes:
        """The text with ASCII letters lower-cased, unless this could make a special token of something else."""
        if not self.folds:
            return text
        low = text.lower()
        return text if any(x in low for x in self.specials) else low

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text (UTF-8), packed."""
        return [self._text(self._folded(t or b"")) for t in texts]


def _encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _WORKER:
        _WORKER[path, dtype] = WordEncoder(path, dtype)
    return _WORKER[path, dtype]


_PACK = "kind int, key binary, n int, payload binary, doc_id long, uid long, digests binary, lengths binary, root binary"
_PACK_ARROW = [pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _slices(batch: pa.RecordBatch, rows: int = 2048, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some ``rows`` rows and ``size`` bytes of text, one row at least."""
    n, lo, held = batch.column(1), 0, 0
    for i in range(batch.num_rows):
        held += len(n[i].as_buffer()) if n[i].is_valid else 0
        if held >= size or i + 1 - lo >= rows or i + 1 == batch.num_rows:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0


def encode_chunks(docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int, bits: int = 8) -> DataFrame:
    """Rows of kind 0, a chunk under its digest, once for each task that meets it, and 1, the draft of a recipe.

    ``key`` deals them out: a chunk's digest, or the digest of a document's place, so that neither a chunk that
    many documents share nor a document that many rows repeat gathers in one task.
    """
    dtype = f"<u{id_bytes}"
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uid, sent = _encoder(tokenizer, dtype), TaskContext.get().partitionId() << 40, set()
        for whole in batches:
            for batch in _slices(whole):
                rows = []
                streams = [packed + end for packed in encoder.encode(batch.column(1).to_pylist())]
                places = cuts([np.frombuffer(packed, dtype) for packed in streams], bits)
                for doc_id, packed, ends in zip(batch.column(0).to_pylist(), streams, places, strict=True):
                    at, leaves, sizes = 0, [], []
                    for to in ends:
                        part = packed[at * id_bytes : to * id_bytes]
                        leaves.append(d := digest(part))
                        sizes.append(to - at)
                        if d not in sent:
                            sent.add(d)
                            rows.append((0, d, to - at, part, None, None, None, None, None))
                        at = to
                    if len(sent) > 200_000:
                        sent.clear()
                    rows.append((1, digest(uid.to_bytes(8, "little")), at, None, doc_id, uid, b"".join(leaves), np.array(sizes, "<u4").tobytes(), merkle(leaves)))
                    uid += 1
                yield _batch(rows, _names(_PACK), _PACK_ARROW)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(trimmed(run), _PACK)


_RECIPES = "kind int, shard int, row long, doc_id long, shard_start long, n_tokens long, digests binary, lengths binary, root binary"


_RECIPES_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted drafts of a shard and add up their lengths; a last row of kind 1 sums the shard up."""
    from pyspark import TaskContext

    shard, start, row, roots = TaskContext.get().partitionId(), 0, 0, []
    for b in batches:
        rows = []
        for doc_id, n, digests, lengths, root in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "digests", "lengths", "root")), strict=True):
            rows.append((0, shard, row, doc_id, start, n, digests, lengths, root))
            roots.append(root)
            start, row = start + n, row + 1
        yield _batch(rows, _names(_RECIPES), _RECIPES_ARROW)
    if row:
        yield _batch([(1, shard, row, None, 0, start, None, None, merkle(roots))], _names(_RECIPES), _RECIPES_ARROW)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_bytes: int = 2, shards: int | None = None, bits: int = 8) -> None:
    """Encode ``docs`` (doc_id, text) and write the store at ``path``.

    The only wide rows that are shuffled are the chunks, once, towards their digest. Recipes move as digests. The
    driver gets one row for each shard.
    """
    spark = docs.sparkSession
    encode_chunks(docs, tokenizer, end_id, id_bytes, bits).repartition("key").dropDuplicates(["key"]).write.parquet(f"{path}/packs")
    drafts = spark.read.schema(_PACK).parquet(f"{path}/packs").where("kind = 1").select("doc_id", "root", "uid", "n", "digests", "lengths")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        drafts.repartitionByRange(shards, "doc_id", "root", "uid")
        .sortWithinPartitions("doc_id", "root", "uid")
        .mapInArrow(trimmed(_recipes), _RECIPES)
        .write.parquet(f"{path}/recipes")
    )
    both = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    sums = both.where("kind = 1").select("shard", "row", "n_tokens", "root").orderBy("shard").collect()
    start, lines = 0, []
    for s in sums:
        lines.append((s.shard, s.row, s.n_tokens, start, bytes(s.root), id_bytes, end_id))
        start += s.n_tokens
    lines.append((-1, sum(s.row for s in sums), start, 0, merkle([bytes(s.root) for s in sums]), id_bytes, end_id))
    spark.createDataFrame(lines, "shard int, docs long, tokens long, start long, root binary, id_bytes int, end_id int").coalesce(1).write.parquet(f"{path}/manifest")


class Store:
    """Reads a store. ``verify`` and ``documents`` raise if a chunk, a recipe or a shard isn't what was written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = spark.read.parquet(f"{path}/manifest")
        total = self.manifest.where("shard = -1").first()
        self.id_bytes, self.end_id, self.root, self.tokens = total.id_bytes, total.end_id, bytes(total.root), total.tokens

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(_PACK).parquet(f"{self.path}/packs").where("kind = 0").select(F.col("key").alias("digest"), "n", "payload")

    def recipes(self) -> DataFrame:
        """One row per document with ``start``, the number of ids before it in the whole store."""
        rows = self.spark.read.schema(_RECIPES).parquet(f"{self.path}/recipes").where("kind = 0").drop("kind")
        base = self.manifest.where("shard >= 0").select("shard", F.col("start").alias("base"))
        # one manifest row for each shard
        return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")

    def references(self) -> DataFrame:
        """Recipes as rows: shard, row, seq, digest."""
        places = F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1)
        return self.recipes().select("shard", "row", "digests", F.explode(places).alias("seq")).select("shard", "row", "seq", F.expr(f"substring(digests, seq * {DIGEST} + 1, {DIGEST})").alias("digest"))

    def verify(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from the stored payloads.

        Each payload is read once, checked against its digest and reduced to the checksum of its ids. Checksums of
        consecutive parts combine exactly, so what is shuffled to the documents is 24 bytes a chunk, not the ids.
        """
        width = self.id_bytes

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held, n = b.column("payload"), b.column("n").to_numpy()
                offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int32)
                packed = memoryview(held.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
                ends = (offsets - offsets[0]).tolist()
                if [digest(packed[x:y]) for x, y in zip(ends, ends[1:])] != b.column("digest").to_pylist() or (np.diff(offsets) != n * width).any():
                    raise ValueError("a stored chunk doesn't have the digest under which it is stored")
                wide = memoryview(np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes())
                ends = [4 * x // width for x in ends]
                crc = [zlib.crc32(wide[x:y]) for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

        parts = self.chunks().mapInArrow(trimmed(sums), "digest binary, n int, crc long")
        lists = (
            spread_join(self.references(), parts, "digest").groupBy("shard", "row")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
        )
        found = self.recipes().select("shard", "row", "doc_id", "start", "n_tokens", "digests", "root").join(lists, ["shard", "row"], "left")
        flat = found.select("doc_id", "start", "n_tokens", "digests", "root", F.col("parts.n").alias("ns"), F.col("parts.crc").alias("crcs"))
        return flat.mapInArrow(trimmed(_combined), "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int")

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids: the id streams themselves, put together from the chunks."""
        width = self.id_bytes

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def unpack(packed):
            return packed.map(lambda x: np.frombuffer(x, f"<u{width}").astype(np.int32))

        lists = self.references().join(self.chunks(), "digest").groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
        whole = lists.select("shard", "row", F.aggregate("parts.payload", F.unhex(F.lit("")), lambda a, b: F.concat(a, b)).alias("packed"))
        return self.recipes().join(whole, ["shard", "row"]).select("doc_id", "start", "n_tokens", unpack("packed").alias("ids"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        totals, digests, roots, ns, crcs = (b.column(i) for i in (2, 3, 4, 5, 6))
        sizes, parts, of = [], [], []
        for k, (total, d, root, n, c) in enumerate(zip(totals.to_pylist(), digests.to_pylist(), roots.to_pylist(), ns.to_pylist(), crcs.to_pylist(), strict=True)):
            leaves = [d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]
            if n is None or len(n) != len(leaves) or sum(n) != total or merkle(leaves) != root:
                raise ValueError("a recipe doesn't lead to the chunks that it was written with")
            sizes += n
            parts += c
            of += [k] * len(n)
        sizes, parts, of = np.array(sizes, np.int64), np.array(parts, np.uint32), np.array(of)
        ends = np.cumsum(sizes)
        last = ends[np.searchsorted(of, np.arange(b.num_rows), side="right") - 1]
        shifted = crc_shift(parts, 4 * (last[of] - ends))
        out = np.bitwise_xor.reduceat(shifted, np.searchsorted(of, np.arange(b.num_rows)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out.astype(np.int64)), pa.array([len(d) // DIGEST for d in digests.to_pylist()], pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])


_CRC_STEPS: list[np.ndarray] = []


def _crc_step(k: int) -> np.ndarray:
    """What each byte of a crc32 (4 x 256 values) becomes when 2^k zero bytes are appended to the message."""
    while len(_CRC_STEPS) <= k:
        if _CRC_STEPS:  # twice the step before
            half = _CRC_STEPS[-1]
            unit = _crc_apply(half, _crc_apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
        else:  # eight zero bits: the register moves, the polynomial is added if a one falls out
            unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for _ in range(8):
                unit = (unit >> np.uint32(1)) ^ np.where(unit & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        table = np.zeros((4, 256), np.uint32)
        for bit in range(8):
            table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] ^ unit.reshape(4, 8)[:, bit : bit + 1]
        _CRC_STEPS.append(table)
    return _CRC_STEPS[k]


def _crc_apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return table[0][crc & low] ^ table[1][crc >> np.uint32(8) & low] ^ table[2][crc >> np.uint32(16) & low] ^ table[3][crc >> np.uint32(24)]


def crc_shift(crc: np.ndarray, nbytes: np.ndarray) -> np.ndarray:
    """The part of each crc32 in that of a longer message, ``nbytes`` of which come after; the parts of consecutive pieces add up (xor)."""
    crc, nbytes = crc.copy(), nbytes.copy()
    k = 0
    while (nbytes > 0).any():
        some = np.flatnonzero(nbytes & 1)
        crc[some] = _crc_apply(_crc_step(k), crc[some])
        nbytes >>= 1
        k += 1
    return crc


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, id_bytes: int = 2) -> DataFrame:
    """Write a store of ``docs`` into the shared folder and return what ``Store.verify`` reads back from it."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-store")
    write_store(docs, path, tokenizer, end_id, id_bytes)
    return Store(spark, path).verify()
