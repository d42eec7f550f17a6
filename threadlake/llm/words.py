"""Vectorised words of UTF-8 text: positions and 64-bit hashes, without a Python object per word.

Two word definitions are used: `folded` lower-cases A-Z and takes runs of digits, letters and
non-ASCII bytes; `spaced` takes runs of bytes other than space and \\x09-\\x0D, unchanged.
A word's hash is a polynomial in an odd base modulo 2**64 over its bytes, then mixed with its
length; two of 10**8 different words share a hash with a chance below 10**-3.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD = np.frombuffer(FOLD, np.uint8)
FOLDED = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
SPACED = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
LETTERS = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
FOLDED_RE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    hashes: np.ndarray  # uint64, a word each
    offsets: np.ndarray  # of the first word of each text, and the number of words
    data: np.ndarray  # the joined bytes
    starts: np.ndarray  # of each word in them
    ends: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The text's index, for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def word_spans(texts: Sequence[bytes | None], folded: bool, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, word starts and ends in them, and each text's first word. `kind`: the bytes of a word, if others."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    if folded:
        data = _FOLD[data]
    inside = (kind if kind is not None else FOLDED if folded else SPACED)[data].view(np.int8)
    step = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=first[1:])
    return data, starts, ends, np.searchsorted(starts, first)


def hash_words(texts: Sequence[bytes | None], folded: bool = True, kind: np.ndarray | None = None) -> Words:
    """Null and empty texts have no words."""
    data, starts, ends, offsets = word_spans(texts, folded, kind)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return Words(mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), offsets, data, starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words; of fewer words, none."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(_BASE)
        out += words[k : k + len(out)]
    return mix(out)
