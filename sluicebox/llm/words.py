"""Words of texts as 64-bit fingerprints, computed for whole batches in numpy.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text after
lower-casing A-Z. Fingerprints are polynomials over a fixed random table, mixed;
two different words agree with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_table = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, np.uint64, endpoint=True)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, 2 * PIECE), _INVERSE if inverse else _BASE, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i]: polynomial of the first i bytes. A string's fingerprint is a difference, shifted."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table[data] * powers(len(data)), out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the byte ranges [start, end) under prefix_sums."""
    found = (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]
    found += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(found)


def text_print(text: str | None) -> int:
    """A signed 64-bit number for a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return int(fingerprints(prefix_sums(data), np.array([0]), np.array([len(data)])).view(np.int64)[0])


def _pieces(data: bytes):
    """Cuts at white space where possible, so that no array is much longer than PIECE."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(b" ", at, at + PIECE), data.rfind(b"\n", at, at + PIECE))
        if cut <= at:
            found = [x for x in (data.find(b" ", at + 1), data.find(b"\n", at + 1)) if x > 0]
            cut = min(found, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_fingerprints(data: bytes) -> np.ndarray:
    """Fingerprints of all words of lower-cased bytes, in order."""
    out = []
    for piece in _pieces(data):
        x = np.frombuffer(piece, np.uint8)
        gap = np.ones(len(x) + 2, bool)
        gap[1:-1] = _space[x]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        if len(edge):
            out.append(fingerprints(prefix_sums(x), edge[0::2], edge[1::2]))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)


def batch_words(texts: list[bytes]):
    """Yields (first, last, words, counts): rows first..last-1 of the batch, their words one
    after another, and how many each has. Short texts share one pass; long ones stand alone."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) < PIECE):
            size += len(texts[last]) + 1
            last += 1
        if last == first + 1:
            words = word_fingerprints(texts[first])
            counts = np.array([len(words)])
        else:
            joined = b"\n".join(texts[first:last])
            x = np.frombuffer(joined, np.uint8)
            gap = np.ones(len(x) + 2, bool)
            gap[1:-1] = _space[x]
            edge = np.flatnonzero(gap[1:] != gap[:-1])
            start, end = edge[0::2], edge[1::2]
            words = fingerprints(prefix_sums(x), start, end) if len(start) else np.empty(0, np.uint64)
            ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
            counts = np.diff(np.searchsorted(start, ends), prepend=0)
        yield first, last, words, counts
        first = last


_WEIGHTS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct fingerprints of runs of ``width`` words; fewer words: the whole as one."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        total += mix(words[k : k + n] + _WEIGHTS[k % len(_WEIGHTS)] * np.uint64(k // len(_WEIGHTS) + 1)) * _WEIGHTS[k % len(_WEIGHTS)]
    total += np.uint64(min(width, len(words)))
    return np.unique(mix(total))
