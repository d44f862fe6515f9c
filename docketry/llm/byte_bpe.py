"""Byte-level BPE by a tree reduction: halves are encoded on their own, neighbours are joined at their boundary.

A text's encoding is a fold over a monoid whose elements are encoded stretches of text and whose product encodes two
neighbouring stretches as one. The product is the same however a text is cut, so it may be taken in any tree. It has to
mend two things at the boundary, each by a window that grows until what lies outside can't change:

* **Pieces.** The pattern that cuts texts into pieces looks at what follows, up to ``REACH`` characters beyond a piece's
  end, and never at what precedes it. So pieces of the left stretch whose end is that far from its own end are firm, and
  from any place where a piece of the right stretch begins in both cuts, all further pieces are the right one's own. The
  window is the left's pieces that aren't firm, with the first 1, 2, 4 ... pieces of the right.
* **Tokens** within a piece. Ids x, y are *stable* if the bytes of both encode to x, y. A sequence in which all neighbours are
  stable is the encoding of its bytes: consider the first merge that would cross a boundary between two of its tokens;
  up to it, either token has merged as it does when only these two are encoded, where the same merge would be the next.
  Windows are encodings themselves, so only the pairs at their two edges have to be checked.

Decoding maps ids to bytes and concatenates, which needs no mending.

Edge cases: a null or empty text has no ids; bytes that aren't UTF-8 count as U+FFFD; rows that repeat an id are rows of
their own; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import trimmed

#: Characters of a text that are encoded as one leaf of its tree.
LEAF_CHARS = 1 << 14
#: Bytes of a piece that are encoded as one leaf of the piece's tree.
LEAF_BYTES = 64
#: Characters beyond a piece's end that the pattern may look at: a contraction that fails after "'" and a letter, or white
#: space whose last character goes to the next piece.
REACH = 3
#: Pieces and pairs held per Python worker at most, in two generations each; they only save time.
CACHE = 600_000
#: Pieces of more characters are encoded anew each time.
_LONGEST = 128

_WORKER: dict = {}


class Held:
    """A table of two generations: once the younger is full it becomes the older, whose entries are taken over when met again."""

    def __init__(self, entries: int):
        self.half, self.new, self.old = max(1, entries // 2), {}, {}

    def find(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new
        self.new[key] = value


class ByteBpe:
    """Ranks, pattern and what has been met so far. ``ranks`` maps the bytes of a token to its id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, cache: int = CACHE):
        import regex

        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.dtype = np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")
        self.known, self.pairs = Held(cache), Held(cache)

    @classmethod
    def from_file(cls, path: str, pattern: str, **limits) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern, **limits)

    # ---- tokens within a piece

    def merged(self, data: bytes) -> list[int]:
        """Ids of ``data``: of all neighbours that form a token, those of the lowest rank merge, the leftmost first, until none do."""
        if len(data) <= self.leaf_bytes:
            parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
            while len(parts) > 1:
                pairs = [ranks.get(a + b, 1 << 32) for a, b in zip(parts, parts[1:])]
                if (low := min(pairs)) == 1 << 32:
                    break
                at = pairs.index(low)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        return self._merged_long(data)

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list, for windows that had to grow."""
        n, ranks = len(data), self.ranks
        end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if (j := end[i]) < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != to:  # one of the two has merged since
                continue
            gone[j], end[i] = 1, to
            if to < n:
                before[to] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ranks[data[i : end[i]]] for i in range(n) if not gone[i]]

    def stable(self, x: int, y: int) -> bool:
        found = self.pairs.find((x, y))
        if found is None:
            found = self.merged(self.tokens[x] + self.tokens[y]) == [x, y]
            self.pairs.put((x, y), found)
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of two neighbours from the ids of either."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            inner = self.merged(b"".join(self.tokens[i] for i in left[len(left) - a :] + right[:b]))
            before = a == len(left) or self.stable(left[-a - 1], inner[0])
            after = b == len(right) or self.stable(inner[-1], right[b])
            if before and after:
                return left[: len(left) - a] + inner + right[b:]
            a, b = a if before else 2 * a, b if after else 2 * b

    def tree(self, data: bytes) -> list[int]:
        """Ids of a piece's bytes. Halves end at a power of two of leaves, where repeated signs are cut into equal tokens on both sides."""
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = self.leaf_bytes << (((len(data) - 1) // self.leaf_bytes).bit_length() - 1)
        return self.joined(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, piece: str) -> bytes:
        """Packed ids of a piece; one that is a token as a whole is that token."""
        found = self.known.find(piece)
        if found is None:
            data = piece.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            found = np.array([whole] if whole is not None else self.tree(data), self.dtype).tobytes()
            if len(piece) <= _LONGEST:
                self.known.put(piece, found)
        return found

    # ---- pieces within a text

    def leaf(self, text: str) -> tuple[list[str], list[bytes]]:
        """The monoid's element for a stretch of text: its pieces and the packed ids of each."""
        pieces = self.pieces(text)
        ids = list(map(self.known.new.get, pieces))
        if None in ids:
            ids = [self.piece(p) if i is None else i for p, i in zip(pieces, ids)]
        return pieces, ids

    def product(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """The element for two neighbouring stretches; associative, with the empty stretch as its unit."""
        (p, x), (q, y) = left, right
        if not p or not q:
            return (p + q, x + y)
        firm, beyond = len(p), 0
        while firm and beyond < REACH:  # back to the last piece that ends REACH characters before the end
            firm -= 1
            beyond += len(p[firm])
        tail, n = "".join(p[firm:]), 1
        while True:
            window = tail + "".join(q[:n])
            inner, at, begins = self.pieces(window), 0, {}
            offset = len(tail)
            for j in range(min(n, len(q))):
                begins[offset] = j
                offset += len(q[j])
            for k, piece in enumerate(inner):
                if at in begins:
                    kept, j = inner[:k], begins[at]
                    return p[:firm] + kept + q[j:], x[:firm] + [self.piece(w) for w in kept] + y[j:]
                at += len(piece)
                if at + REACH > len(window):
                    break
            if n >= len(q):
                return p[:firm] + inner, x[:firm] + [self.piece(w) for w in inner]
            n *= 2

    def element(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        return self.product(self.element(text[:half]), self.element(text[half:]))

    def encode(self, text: str | None) -> bytes:
        """Packed ids (``dtype``) of a whole text."""
        return b"".join(self.element(text or "")[1])


def _codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = ByteBpe.from_file(path, pattern)
    return _WORKER[path, pattern]


def _rows(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with some ``size`` bytes in their second column, one row at least: what encoding holds at once."""
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += n or 0
        if held >= size or i + 1 == batch.num_rows:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of each row's whole ``text`` by the ranks at ``path``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for whole in batches:
            for b in _rows(whole):
                packed = [codec.encode(t.decode("utf-8", "replace") if t else None) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, packed)]) // codec.dtype.itemsize
                ids = np.frombuffer(b"".join(packed), codec.dtype).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (binary): the concatenated bytes of each row's ids; no shuffle. Null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        if "bytes" not in codec.__dict__:
            codec.bytes = pa.array([codec.tokens.get(i) for i in range(max(codec.tokens, default=-1) + 2)], pa.large_binary())
        for b in batches:
            lists = b.column(1)
            ids = lists.flatten()
            flat = codec.bytes.take(pa.array(np.minimum(ids.to_numpy(zero_copy_only=False).view(np.uint32), len(codec.bytes) - 1)))
            if flat.null_count:
                raise ValueError("an id stands for no token of the vocabulary")
            place = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            raw = memoryview(flat.buffers()[2] or b"")
            at = place[ends].tolist()
            out = [None if null else bytes(raw[lo:to]) for lo, to, null in zip(at, at[1:], lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids array<int>, decoded binary")


def fold(codec: ByteBpe, stretches: list[str]) -> bytes:
    """Packed ids of a text given in stretches, from left to right; any other bracketing gives the same."""
    return b"".join(reduce(codec.product, map(codec.leaf, stretches), ([], []))[1])
