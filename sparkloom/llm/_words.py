"""Words and word shingles of texts as 64-bit hashes, vectorised per text."""

from __future__ import annotations

import numpy as np

_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at once; a longer word makes its segment longer.
SEGMENT = 1 << 18
#: ASCII digits and lower-case letters and all bytes beyond ASCII are parts of words.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hash_segment(data: np.ndarray) -> np.ndarray:
    up, down = _grown(max(SEGMENT, len(data) + 1))
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs of letters, digits and non-ASCII characters, in lower case."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    if len(data) <= SEGMENT:
        return _hash_segment(data)
    parts, at = [], 0
    while at < len(data):
        cut = at + SEGMENT
        while cut < len(data):  # move on to the end of the word
            out = np.flatnonzero(~_IN_WORD[data[cut : cut + SEGMENT]])
            if len(out):
                cut += int(out[0])
                break
            cut += SEGMENT
        parts.append(_hash_segment(data[at:cut]))
        at = cut
    return np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Occurrence-labelled hashes of the runs of ``k`` words, in text order.

    Equal runs differ by the number of their occurrence.  A text with fewer words
    has one run of them all; one without words has none.
    """
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out + words[i : i + n])
    order = np.argsort(out, kind="stable")
    sorted_ = out[order]
    same = np.append(False, sorted_[1:] == sorted_[:-1])
    if same.any():
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(same, 0, at))
        out[order] = np.where(run > 0, mix(sorted_ + run.astype(np.uint64) * _M1), sorted_)
    return out
