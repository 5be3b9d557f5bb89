"""Word shingles of a text as sets of 64-bit hashes."""

from __future__ import annotations

import itertools
import re
import string
from collections import defaultdict

import numpy as np
import xxhash

_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_ODD = 0x9E3779B97F4A7C15
_PIECE = 1 << 22


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def _hash_piece(data: bytes) -> np.ndarray:
    code_of: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = data.translate(_LOWER).split()
    codes = np.fromiter(map(code_of.__getitem__, words), dtype=np.int64, count=len(words))
    return np.array([xxhash.xxh3_64_intdigest(w) for w in code_of], dtype=np.uint64)[codes]


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, in order.

    Long texts are cut at white space, so memory does not follow the length of the text.
    """
    if len(text) <= _PIECE:
        return _hash_piece(text)
    out, start = [], 0
    while start < len(text):
        gap = _WHITE.search(text, start + _PIECE)
        stop = gap.start() if gap else len(text)
        out.append(_hash_piece(text[start:stop]))
        start = stop
    return np.concatenate(out)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of all windows of ``words`` words.

    A text with fewer words gives its whole sequence as one shingle; one without words gives none.
    """
    hashes = word_hashes(text)
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, words)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = mix(acc * np.uint64(_ODD) + hashes[i : i + n - width + 1])
    return np.unique(acc)


def set_ids(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit ids of a set: the node it stands for, and a check on that."""
    both = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return both & (2**64 - 1), both >> 64
