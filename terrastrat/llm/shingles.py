"""Words, shingles and MinHash of many texts at once, in numpy.

Texts are joined into one byte buffer; words are runs of bytes other than ASCII white space. A word's
hash is a polynomial over its bytes taken from prefix sums modulo 2**64, then mixed; a shingle's hash
is a mixed linear form of five word hashes.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Texts are handled in runs of about this many bytes; one longer text makes a run of its own.
RUN_BYTES = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 1)
        both = []
        for r in (_R, _R_INV):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = (both[0], both[1])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (a multiply and xor-shift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of some UTF-8 texts: ``start``, ``end`` (bytes in ``buffer``), ``hash``, ``text`` (index)."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buffer = np.frombuffer(joined, np.uint8)
        self.bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])  # text i lies in bounds[i] .. bounds[i+1]-1
        gap = _GAP[self.buffer]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.end = edges[::2], edges[1::2]
        up, down = powers(len(self.buffer))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.buffer.astype(np.uint64) + np.uint64(1)) * up[: len(self.buffer)], dtype=np.uint64)])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.text = np.searchsorted(self.bounds, self.start, side="right") - 1
        # the first word of each text, and one past the last of all
        self.first = np.searchsorted(self.start, self.bounds)


_FORM = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of groups of words, and where each group's begin.

    first: where each group's words begin, and one past the last. A group of fewer words than *width*
    but at least one has one shingle, of all its words; a group without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    group = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - begin[group] + first[group]
    padded = np.concatenate([word_hash, np.zeros(width, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    length = np.minimum(n, width)[group]
    for k in range(width):
        term = padded[at + k] * _FORM[k % len(_FORM)]
        short = length <= k
        if short.any():
            term[short] = 0
        out += term
    return mixed(out + length.astype(np.uint64)), begin


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of k multiply-shift hash functions."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, k, dtype=np.uint64)


EMPTY = np.uint32(0xFFFFFFFF)


def minhash(hashes: np.ndarray, begin: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Signatures (groups x k, uint32); groups without shingles get EMPTY throughout."""
    a, b = permutations(k, seed)
    groups = len(begin) - 1
    out = np.full((groups, k), EMPTY, np.uint32)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    # blocks of whole groups that fit the processor's cache
    ends, lo = begin[1:][full], 0
    while lo < len(full):
        base = begin[full[lo]]
        hi = max(lo + 1, int(np.searchsorted(ends, base + 24_000, side="right")))
        h = hashes[base : ends[hi - 1]]
        at = begin[full[lo:hi]] - base
        for i in range(k):
            v = ((h * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
            out[full[lo:hi], i] = np.minimum.reduceat(v, at)
        lo = hi
    return out


def runs(texts: list, size=lambda t: len(t)):
    """Index ranges of consecutive texts of about RUN_BYTES together."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += size(t)
        if total >= RUN_BYTES:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
