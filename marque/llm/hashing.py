"""Words of UTF-8 texts as 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)  # fixed: hashes must agree between workers and runs
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Inverse of _MULT modulo 2**64.
_BACK = np.uint64(pow(int(_MULT), -1, 2**64))


def lower_ascii() -> np.ndarray:
    t = np.arange(256)
    t[65:91] += 32
    return t


#: The white space of ``[^\x20\x09-\x0D]+``.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, m in enumerate((_MULT, _BACK)):
            steps = np.full(n, m, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    if n < 4_000_000 < len(_POWERS[0]):  # after one very long text
        for i in (0, 1):
            _POWERS[i] = _POWERS[i][:4_000_000].copy()
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which span_hash gives the hash of any span of the bytes b."""
    up, down = _powers(max(1, len(b)))
    return np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)], down


def span_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c, down = sums
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(b: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't blank."""
    gap = blank[b]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True]))
    return edge[::2], edge[1::2]


def hashed_words(texts: list[bytes], fold: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)  # a space is blank in every alphabet used here
    b = fold.astype(np.uint8)[joined]
    start, end = word_spans(b, blank)
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return span_hash(prefix_sums(b), start, end), np.diff(np.searchsorted(start, first))


def shingles(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles: (text index, hash), sorted by both, and the number for each text.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    m = len(h)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    place = np.arange(m)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        inside = place + j < end
        acc = acc * _MULT + np.where(inside, h[np.minimum(place + j, max(m - 1, 0))] if m else h, np.uint64(0))
    short = counts < n
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    keep = (place + n <= end) | (short[text] & (place == begin))
    acc = np.where(short[text], acc + counts[text].astype(np.uint64), acc)
    text, s = text[keep], mix(acc[keep])
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (s[1:] != s[:-1])] if len(s) else np.zeros(0, bool)
    text, s = text[new], s[new]
    return text, s, np.bincount(text, minlength=len(counts))


def forget() -> None:
    """Free the tables of powers."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
