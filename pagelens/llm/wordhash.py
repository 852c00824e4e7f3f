"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n - 1``; tables of up to 1M entries (8 MB) are kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 20:
            _POWERS[int(base)] = have
    return have[:n]


@dataclass
class Words:
    data: np.ndarray  # all texts, joined by line feeds
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # the word's text
    hash: np.ndarray  # of the word with A-Z lower-cased


def words(texts: list[bytes], fold: bool = True, plain: bool = False) -> Words:
    """Every run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``, in order; ``plain`` cuts at all ASCII but letters and digits."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if plain:
        space = (data < 128) & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & ~((data >= 48) & (data <= 57))
    turn = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    start, end = turn[0::2], turn[1::2]
    low = np.where((data >= 65) & (data <= 90), data | 32, data) if fold else data
    total = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(STEP, len(low)), dtype=np.uint64)]
    h = mix((total[end] - total[start]) * powers(BACK, len(low))[start] + (end - start).astype(np.uint64))
    edges = np.cumsum([len(t) + 1 for t in texts])
    return Words(data, start, end, np.searchsorted(edges, start, "right"), h)
