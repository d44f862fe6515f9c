"""Words of a text as slots of a fixed table, hashed in numpy without a pass over the words in Python."""

from __future__ import annotations

import numpy as np
import xxhash

WORD_BITS = 20
SLOTS = 1 << WORD_BITS
#: Letters stay, also those beyond ASCII; all else separates.
LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))
#: Only white space separates.
SPACES = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_BLOCK = 1 << 17
_ZERO = np.zeros(1, np.int8)
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


_HELD: dict[str, np.ndarray] = {}
#: Words of more bytes are hashed one by one: sums of powers modulo 2^64 agree for some long words that differ.
_SHORT = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: bytes | None, table: bytes = LETTERS) -> np.ndarray:
    """Hash of each lower-cased word of a UTF-8 text; words of any length are hashed whole."""
    text = (text or b"").decode("utf-8", "replace").lower().encode("utf-8").translate(table)
    if not _HELD:
        _HELD["up"], _HELD["down"] = _powers(_PRIME, _BLOCK + 1), _powers(_INVERSE, _BLOCK + 1)
    parts, lo = [], 0
    while lo < len(text):
        to = len(text)
        if to - lo > _BLOCK:  # blocks end between words, or after a word that is longer than a block
            to = text.rfind(b" ", lo, lo + _BLOCK) + 1 or text.find(b" ", lo + _BLOCK) + 1 or to
        if to - lo > _BLOCK:
            parts.append(np.array([xxhash.xxh64_intdigest(text[lo:to].strip(b" "))], np.uint64))
            lo = to
            continue
        x = np.frombuffer(text, np.uint8, to - lo, lo)
        edge = np.diff(np.concatenate([_ZERO, (x != 32).view(np.int8), _ZERO]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # the sum of bytes times rising powers of a base; its slice over a word, scaled back to the word's start
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) * _HELD["up"][: len(x)], dtype=np.uint64)])
        h = _mixed((total[end] - total[start]) * _HELD["down"][start])
        for k in np.flatnonzero(end - start > _SHORT).tolist():
            h[k] = xxhash.xxh64_intdigest(text[lo + int(start[k]) : lo + int(end[k])])
        parts.append(h)
        lo = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_slots(text: bytes | None, bits: int = WORD_BITS) -> np.ndarray:
    """Slot of each word (run of letters, lower-cased) of a UTF-8 text, in a table of 2^bits."""
    return (word_hashes(text) >> np.uint64(64 - bits)).astype(np.int64)
