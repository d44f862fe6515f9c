"""The perfect binary code of length 23 (radius 3), used as covering code, with vectorised decoding."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, RADIUS = 23, 3
MASK = np.uint64((1 << LENGTH) - 1)
#: Generator polynomial of the code (a fixed value of the code).
GENERATOR = 0b110001110101


def _remainder(x: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


@cache
def _halves() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits."""
    unit = [_remainder(1 << i) for i in range(LENGTH)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ unit[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[12 + i]
    return low, high


def syndrome(x: np.ndarray) -> np.ndarray:
    low, high = _halves()
    return low[x & np.uint64(0xFFF)] ^ high[x >> np.uint64(12)]


@cache
def errors(weight: int) -> np.ndarray:
    """For each syndrome its error patterns up to ``weight``, lightest first; rows are filled up with the first."""
    lists: list[list[int]] = [[] for _ in range(1 << 11)]
    unit = [_remainder(1 << i) for i in range(LENGTH)]
    for w in range(weight + 1):
        for places in combinations(range(LENGTH), w):
            s = e = 0
            for p in places:
                s, e = s ^ unit[p], e | 1 << p
            lists[s].append(e)
    widest = max(map(len, lists))
    return np.array([x + x[:1] * (widest - len(x)) for x in lists], np.uint64)


def home(x: np.ndarray) -> np.ndarray:
    """The one code word within the radius of each 23-bit word."""
    return x ^ errors(RADIUS)[syndrome(x), 0]


def near(x: np.ndarray, slack: int) -> np.ndarray:
    """All code words within the radius plus ``slack`` of each word; the home comes first and fills the rows up."""
    return x[:, None] ^ errors(RADIUS + slack)[syndrome(x)]
