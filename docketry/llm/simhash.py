"""SimHash fingerprints and near-duplicate groups by anchor-point covering.

A fingerprint is sent to the anchors, the words of a covering code, that lie near it; two fingerprints meet at an
anchor if they are near each other, and are compared there.

``components_within_two`` links all fingerprints of 64 bits that differ in two bits at most, without exception. The
code is the product of two perfect codes of length 23 and the zero word of the 18 bits left (covering radius
3 + 3 + 18). A fingerprint's home is the anchor that its two halves decode to. Flipping two bits moves a home in two
blocks at most, by code words within 3 + 2 bits in one block or 3 + 1 bits in each of both, so that a fingerprint is
replicated to these. Homes are compared with what was sent to them; an anchor that is home to very many is split
exactly (see there).

``near_copies`` groups whole texts whose sets of five-word shingles have a similarity of 0.8 or more, as proposed by
256 bits. Bits of such pairs differ too often (in 15 % at 0.8) for replicas at every anchor in reach, so each of many
tables decodes a part of the bits to its anchor. Rows that meet at any anchor and differ in few bits, with a margin of three
deviations, are of one cluster; of an anchor only trees are kept. Within a cluster all pairs within the margin are compared by
the shingle sets of the two texts, which decide each link, unless links connect the pair already. With more texts a table
takes more bits, so that anchors hold as few strangers as before, and there are more tables, so that pairs meet as often
(``tables_for``). An anchor with more than ``CELL`` rows is dealt to cells, in which each two of its blocks meet, and so is a
cluster whose sets have more than ``CLUSTER`` bytes: a cluster's comparisons of bits grow with the square of its rows, its
memory and the rows that leave its tasks don't.

Edge cases: null and empty texts have no words and the fingerprint zero, like any other; repeated rows are kept, and
are one class; null ids take part and are never the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import golay
from docketry.llm.common import discard, settle, trimmed
from docketry.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Homes at one anchor that are still compared one by one.
CROWD = 256
#: Rows that may be broadcast (16 bytes each); beyond that the join shuffles.
SMALL = 1_000_000
_BLOCK = 1 << 15


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; of all words together if there are fewer."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([of(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The bits that more than half of the hashes have, as ``lanes`` words of 64 bits.

    The first word votes with the hashes themselves, each further one with a mixture of them.
    """
    counts = np.zeros((lanes, 64), np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        part = hashes[lo : lo + _BLOCK]
        for lane in range(lanes):
            h = part
            if lane:
                h = (part + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(32)
            counts[lane] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), axis=1).view(np.uint64).ravel()


def fingerprints(docs: DataFrame, size: int, lanes: int = 1) -> DataFrame:
    """id, f0 .. f(lanes-1) for each row of ``docs`` (id, text); words of 64 bits as signed longs."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([majority(shingle_hashes(t.as_py(), size), lanes) for t in b.column(1)], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i].view(np.int64)) for i in range(lanes))], ["id", *names])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), ", ".join(["id long", *(f"{n} long" for n in names)]))


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp & golay.MASK, (fp >> np.uint64(golay.LENGTH)) & golay.MASK


def _anchor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(golay.LENGTH)) | b


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = map(golay.home, _halves(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(_anchor(a, c).view(np.int64)), b.column(0)], ["anchor", "fp"])


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``fp`` and anchors below their home that a fingerprint within two bits may have as home."""
    a, c = _halves(fp)
    a1, c1, a2, c2 = golay.near(a, 1), golay.near(c, 1), golay.near(a, 2), golay.near(c, 2)
    own = _anchor(a1[:, 0], c1[:, 0])[:, None]
    both = _anchor(a1[:, 1:, None], c1[:, None, 1:]).reshape(len(fp), -1)
    sent = np.concatenate([_anchor(a2, c1[:, :1]), _anchor(a1[:, :1], c2), both], axis=1)
    row, col = np.nonzero(sent < own)
    return row, sent[row, col]


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            fp = whole.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            row, anchor = replicas(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[row].view(np.int64))], ["anchor", "fp"])


def links_within_two(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) that connect exactly what pairs of distinct fingerprints (column fp) within two bits connect.

    An anchor that is home to more than ``crowd`` fingerprints is split: these, and all that were sent there, are
    dealt by the 65 words within one bit of them. Two fingerprints within two bits share such a word; all that share
    one are within two bits, 65 at most, and are linked to the smallest.
    """
    homes = settle(prints.mapInArrow(trimmed(_homes), "anchor long, fp long"), "homes")
    sent = prints.mapInArrow(trimmed(_replicas), "anchor long, fp long")
    crowded = settle(homes.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowded")
    every = homes.select("anchor", "fp", F.lit(True).alias("own")).union(sent.select("anchor", "fp", F.lit(False)))
    calm = homes.join(crowded, "anchor", "left_anti").select("anchor", F.col("fp").alias("a"))
    met = calm.join(every, "anchor").where((F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= 2) & (~F.col("own") | (F.col("a") < F.col("fp"))))
    links = met.select("a", F.col("fp").alias("b"))
    if crowded.isEmpty():
        return links
    those = every.join(crowded, "anchor", "left_semi").select("fp").distinct()
    balls = those.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("word"))
    shared = balls.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return links.union(shared.select("a", F.explode("all").alias("b")).where("a <> b").distinct())


def components_within_two(docs: DataFrame, size: int = 3, crowd: int = CROWD) -> DataFrame:
    """id, fp and component_id of each row of ``docs`` (id, text): the smallest id that links of two bits reach."""
    prints = settle(fingerprints(docs, size), "prints")
    classes = settle(prints.groupBy(F.col("f0").alias("fp")).agg(F.min("id").alias("least")), "classes")
    parts = components(links_within_two(classes.select("fp"), crowd))
    placed = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = settle(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = placed.join(least, "component").select("fp", "component_id")
    out = settle(prints.withColumnRenamed("f0", "fp").join(names, "fp").select("id", "fp", "component_id"), "components")
    discard(prints, classes, placed)
    return out


def fingerprint_text(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# near copies by similarity


LANES = 4
#: Tables, and bits of a table besides those of its code, for up to USUAL texts.
TABLES, EXTRA, USUAL = 128, 9, 1 << 18
#: How often a bit agrees at a similarity of 0.8.
AGREES = 0.85
#: Bits within which the links of an anchor are a tree.
SURE = 20
#: Rows of an anchor, or of a cell of it, that are compared in one go; anchors with more are told from one row in SOME.
CELL, SOME = 4096, 16


def tables_for(texts: int) -> tuple[int, int]:
    """Number of tables and their further bits: a bit more for each doubling, and as many more tables as that bit costs."""
    more = max(0, (max(texts, 1) - 1).bit_length() - (USUAL.bit_length() - 1))
    return int(np.ceil(TABLES / AGREES**more)), EXTRA + more


def _table_bits(tables: int, extra: int) -> np.ndarray:
    """For each table the places, among all bits, of its 23 code bits and its further bits."""
    draw = np.random.default_rng(SEED)
    return np.array([draw.permutation(64 * LANES)[: golay.LENGTH + extra] for _ in range(tables)])


def table_anchor(fps: np.ndarray, places: np.ndarray, table: int) -> np.ndarray:
    """Anchor of each row of ``fps`` (n x LANES words) in one table: the code word its bits decode to, further bits, the table."""
    word = np.zeros(len(fps), np.uint64)
    for i, p in enumerate(places.tolist()):
        word |= ((fps[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)) << np.uint64(i)
    code = golay.home(word & golay.MASK)
    return (np.uint64(table) << np.uint64(len(places))) | (word >> np.uint64(golay.LENGTH) << np.uint64(golay.LENGTH)) | code


def meet(anchors: np.ndarray, ids: np.ndarray, fps: np.ndarray, sure: int, most: int, of: np.ndarray | None = None, nearest: bool = False) -> np.ndarray:
    """(a, b) places of links within the anchors: trees that connect what ``sure`` bits connect, and, for each row and each
    other of these trees, the nearest member within ``most`` bits (``nearest``: of all other trees together).

    A row that is reached is compared with all rows that no tree has reached yet, not just the first of its anchor. Where groups
    are known (``of``), only links between different ones are given: for each row the nearest member of each other group in each tree.
    """
    order = np.lexsort((ids, anchors))
    links = []
    for part in np.split(order, np.flatnonzero(np.diff(anchors[order])) + 1):
        if len(part) < 2:
            continue
        words, tree, left = fps[part], np.full(len(part), -1), np.arange(len(part))
        trees = 0
        while len(left):
            todo, left = [int(left[0])], left[1:]
            tree[todo[0]] = trees
            while todo and len(left):
                i = todo.pop()
                near = np.bitwise_count(words[left] ^ words[i]).sum(axis=1) <= sure
                if of is None:
                    links += [(part[i], part[j]) for j in left[near].tolist()]
                tree[left[near]] = trees
                todo += left[near].tolist()
                left = left[~near]
            trees += 1
        group = tree if of is None else of[part]
        if (group != group[0]).any():
            for i in range(len(part)):
                apart = np.bitwise_count(words ^ words[i]).sum(axis=1)
                there = np.flatnonzero((apart <= most) & (group != group[i]))
                there = there[np.lexsort((apart[there], group[there], tree[there]))]
                if nearest:
                    there = there[apart[there].argmin()][None] if len(there) else there
                first = np.concatenate([[True], (np.diff(tree[there]) != 0) | (np.diff(group[there]) != 0)])[: len(there)]
                links += [(part[min(i, j)], part[max(i, j)]) for j in there[first].tolist()]
    return np.array(links, np.int64).reshape(-1, 2)


def forest(anchors: np.ndarray, ids: np.ndarray, fps: np.ndarray, most: int) -> np.ndarray:
    """(a, b) places of trees that connect what pairs within ``most`` bits connect in each anchor: fewer links than rows."""
    order = np.lexsort((ids, anchors))
    links = []
    for part in np.split(order, np.flatnonzero(np.diff(anchors[order])) + 1):
        words, left = fps[part], np.arange(len(part))
        while len(left) > 1:
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                i = todo.pop(0)
                near = np.bitwise_count(words[left] ^ words[i]).sum(axis=1) <= most
                links += [(part[i], part[j]) for j in left[near].tolist()]
                todo += left[near].tolist()
                left = left[~near]
    return np.array(links, np.int64).reshape(-1, 2)


_FIELDS = ["anchor", "id", *(f"f{i}" for i in range(LANES))]
_ROW = "anchor long, id long, " + ", ".join(f"f{i} long" for i in range(LANES))


def _words(b: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([b.column(at + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(LANES)], axis=1)


def near_links(prints: DataFrame, most: int, texts: int | None = None, nearest: bool = False, trees: bool = False) -> DataFrame:
    """(a, b, bits): links between rows of ``prints`` (id, f0 ..) that meet at an anchor and differ in ``most`` bits or fewer.

    See ``meet`` for which (``trees``: ``forest``); a column ``of`` of ``prints`` tells groups. Tables are as many as for ``texts`` texts (those of ``prints``). Which anchors are dealt to cells is told from one row in ``SOME``; that decides where rows meet, not which.
    """
    tables, extra = tables_for(prints.count() if texts is None else texts)
    bits = _table_bits(tables, extra)
    grouped = "of" in prints.columns
    fields, row = (_FIELDS + ["of"], _ROW + ", of long") if grouped else (_FIELDS, _ROW)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All anchors of each row, one row after the other, so that its words are beside each other in what is shuffled."""
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                fps = _words(b, 1)
                anchors = np.stack([table_anchor(fps, bits[t], t) for t in range(tables)], axis=1)
                of = pa.array(np.repeat(np.arange(b.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ravel().view(np.int64)), *(c.take(of) for c in b.columns)], fields)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at, cell, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            group, fps = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])])), _words(b, 3)
            of = b.column(3 + LANES).to_numpy(zero_copy_only=False) if grouped else None
            pairs = forest(group, ids, fps, most) if trees else meet(group, ids, fps, min(SURE, most), most, of, nearest)
            apart = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]]), pa.array(apart)], ["a", "b", "bits"])

        for b in batches:
            if not b.num_rows:
                continue
            at, cell = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            apart = np.flatnonzero((at != at[-1]) | (cell != cell[-1]))
            last = int(apart[-1]) + 1 if len(apart) else 0  # the last group may go on
            held.append(b)
            if last and sum(x.num_rows for x in held) >= 50_000:
                held[-1] = b.slice(0, last)
                yield from done()
                held = [b.slice(last)]
        if held:
            yield from done()

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = prints.select(*fields[1:]).repartition(n, "id")
    few = own.where(F.pmod(F.xxhash64("id"), F.lit(SOME)) == 0).mapInArrow(trimmed(first), row).groupBy("anchor").count().where(F.col("count") > CELL // SOME)
    crowded = settle(few.select(F.col("anchor").alias("__of"), F.ceil(F.col("count") * SOME / (CELL // 2)).alias("__blocks")), "crowded")
    rows, cell = own.mapInArrow(trimmed(first), row), F.lit(0).cast("long").alias("cell")
    if crowded.isEmpty():
        dealt = rows.select("anchor", cell, *fields[1:])
    else:
        small = crowded.limit(SMALL + 1).count() <= SMALL
        marked = rows.join(F.broadcast(crowded) if small else crowded, F.col("anchor") == F.col("__of"), "left")
        block, every = F.pmod(F.xxhash64("id"), "__blocks"), F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)
        cells = F.transform(every, lambda k: F.least(block, k) * F.col("__blocks") + F.greatest(block, k))
        dealt = marked.select("anchor", F.explode(F.coalesce(cells, F.array(cell))).alias("cell"), *fields[1:])
    met = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(trimmed(second), "a long, b long, bits int")
    out = settle(met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("bits").alias("bits")), "links")
    discard(crowded)
    return out


#: Bytes of shingle sets that are compared in one go; a cluster with more is dealt to cells, in which each two of its blocks meet.
CLUSTER = 8 << 20


def linked_within(fps: np.ndarray, sets: list[np.ndarray], block: np.ndarray, most: int, similarity: float) -> list[tuple[int, int]]:
    """(a, b) places of trees that connect all pairs of rows within ``most`` bits whose ``sets`` have the ``similarity``.

    Pairs that links found before connect are not compared. Rows of two blocks are compared across these only.
    """
    sizes, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    own, across = np.zeros(1 + max((int(c.max()) for c in codes if len(c)), default=0), bool), (block != block[0]).any()
    for i in range(len(sets) - 1):
        there = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1) <= most) + i + 1
        fits = np.minimum(sizes[there], sizes[i]) >= np.maximum(similarity * np.maximum(sizes[there], sizes[i]), 1)
        there = there[fits & (block[there] != block[i])] if across else there[fits]
        own[codes[i]] = True
        while len(there := there[label[there] != label[i]]):
            now, there = there[:256], there[256:]
            both = np.add.reduceat(own[np.concatenate([codes[j] for j in now.tolist()])].astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
            for j in now[both >= similarity * (sizes[now] + sizes[i] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
        own[codes[i]] = False
    return out


def alike(links: DataFrame, prints: DataFrame, docs: DataFrame, size: int, similarity: float, most: int) -> DataFrame:
    """(a, b): links that connect all pairs of rows of ``prints`` (id, f0 ..) that ``links`` connect, in whatever way, and that
    differ in ``most`` bits or fewer and whose texts in ``docs`` (id, text) have shingle sets of ``similarity`` or more.

    Sets are compared where their clusters are, so that what leaves a task is a tree, not pairs. A shingle is told by 32 bits of
    its hash: two different ones agree once in 4 billion.
    """
    words = [f"f{i}" for i in range(LANES)]
    clusters = settle(components(links), "clusters")
    named = prints.join(clusters, F.col("id") == F.col("node")).select(F.col("id").alias("__id"), *words, "component")
    texts = docs.select("id", F.col("text").cast("binary").alias("text")).join(named, F.col("id") == F.col("__id")).select("id", "text", "component", *words)
    fields = ["id", "component", *words, "shingles"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, found = [], []
            for text, own in zip(b.column(1), _words(b, 3), strict=True):
                h = shingle_hashes(text.as_py(), size)
                keep.append(bool((majority(h, LANES) == own).all()))  # other texts may have this id, too
                found.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() if keep[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(found, pa.binary())], fields).filter(pa.array(keep, pa.bool_()))

    row = ", ".join(f"{f} {'binary' if f == 'shingles' else 'long'}" for f in fields)
    of = settle(texts.mapInArrow(trimmed(sets), row).groupBy("id").agg(F.min(F.struct(*fields[1:])).alias("of")).select("id", "of.*"), "shingles")
    large = of.groupBy("component").agg(F.sum(F.length("shingles") + 64).alias("bytes")).where(F.col("bytes") > CLUSTER)
    large = settle(large.select(F.col("component").alias("__of"), F.ceil(F.col("bytes") / (CLUSTER // 2)).alias("__blocks")), "large")
    none = F.lit(0).cast("long")
    if large.isEmpty():
        dealt = of.select("component", none.alias("cell"), none.alias("block"), "id", *words, "shingles")
    else:
        few = large.limit(SMALL + 1).count() <= SMALL
        marked = of.join(F.broadcast(large) if few else large, F.col("component") == F.col("__of"), "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), "__blocks"), none))
        cells = F.transform(F.sequence(none, F.col("__blocks") - 1), lambda k: F.least("block", k) * F.col("__blocks") + F.greatest("block", k))
        dealt = marked.select("component", F.explode(F.coalesce(cells, F.array(none))).alias("cell"), "block", "id", *words, "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            held_sets = [np.frombuffer(x, np.uint32) for x in b.column(4 + LANES).to_pylist()]
            pairs = np.array(linked_within(_words(b, 4), held_sets, block, most, similarity), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs.min(axis=1)]), pa.array(ids[pairs.max(axis=1)])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            at, cell = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = [*(np.flatnonzero((at[1:] != at[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), b.num_rows]
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (at[0], cell[0]):
                yield from done()
                held = []
            for lo, to in zip([0, *ends], ends):
                if lo:
                    yield from done()
                    held = []
                held.append(b.slice(lo, to - lo))
        if held:
            yield from done()

    met = dealt.repartition("component", "cell").sortWithinPartitions("component", "cell", "id").mapInArrow(trimmed(compare), "a long, b long")
    out = settle(met, "alike")
    discard(clusters, of, large)
    return out


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """id and group_id (smallest id of its group) of each row of ``docs`` (id, text), groups being near copies.

    ``similarity`` is that of the shingle sets (Jaccard), which decide each link that the bits propose.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = int(np.ceil(64 * LANES * share + 3 * np.sqrt(64 * LANES * share * (1 - share))))
    prints = settle(fingerprints(docs, size, LANES), "prints")
    words = [f"f{i}" for i in range(LANES)]
    classes = settle(prints.groupBy(*words).agg(F.min("id").alias("least")), "classes")
    known = classes.where("least is not null").withColumnRenamed("least", "id")
    # bits only tell which rows may be of one group: their clusters, within which the sets are compared
    proposed = near_links(known, most, known.count(), trees=True)
    links = alike(proposed.select("a", "b"), known, docs, size, similarity, most)
    parts = components(links)
    named = classes.join(parts.withColumnRenamed("node", "least"), "least", "left").select(*words, F.coalesce("component", "least").alias("group_id"))
    out = settle(prints.join(named, words).select("id", "group_id"), "groups")
    discard(prints, classes, proposed, links)
    return out


def keep_one(docs: DataFrame, id_column: str, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of near copies.

    Rows that repeat this id are kept once if their texts agree. Rows without an id have no group and stay.
    """
    groups = near_copies(docs.select(F.col(id_column).alias("id"), "text"), size, similarity)
    gone = settle(groups.where("id <> group_id").select(F.col("id").alias("__gone")).distinct(), "gone")
    few = gone.limit(SMALL + 1).count() <= SMALL
    left = docs.join(F.broadcast(gone) if few else gone, F.col(id_column) == F.col("__gone"), "left_anti")
    again = settle(groups.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("__again")), "again")
    if again.isEmpty():
        return left
    marked = left.join(again, F.col(id_column) == F.col("__again"), "left")
    once = marked.where("__again is not null").dropDuplicates([id_column, "text"])
    return marked.where("__again is null").unionByName(once).drop("__again")
