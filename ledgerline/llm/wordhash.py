"""Words of a batch of texts as numpy arrays: byte classes, spans and 64-bit hashes.

Helpers for tasks that scan every word of a partition. A word's hash is a
random-table polynomial over its bytes, taken from prefix sums, so a batch costs
a few passes over its bytes whatever its words are.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: Random value of each byte and the odd multiplier of the polynomial.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_M64 = (1 << 64) - 1
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: range | list[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words of the n-gram join: all but space and \x09-\x0D.
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: Words of benchmark matching, after lower-casing: digits, a-z and all beyond ASCII.
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

#: Bytes whose words are hashed at a time, so memory doesn't grow with a text.
SPAN = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, grown by doubling; kept up to SPAN."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(SPAN, 1 << (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            take = min(filled, size - filled)
            have[filled : filled + take] = have[:take] * step
            filled += take
        if size <= SPAN:
            _POWERS[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of several texts laid end to end.

    ``data`` holds the lower-cased bytes, ``starts``/``ends`` the words' byte spans,
    ``first`` the index of each text's first word, with the total at the end.
    """

    def __init__(self, texts: list[bytes], keep: np.ndarray):
        raw = np.frombuffer(b"\x20".join([*texts, b""]), dtype=np.uint8)
        self.data = LOWER[raw]
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = keep[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; it doesn't depend on where the word stands."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + SPAN, "right")))
            low, n = self.starts[a], int(self.ends[b - 1] - self.starts[a])
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE_VALUES[self.data[low : low + n]] * _powers("up", MULTIPLIER, n), out=total[1:])
            start, end = self.starts[a:b] - low, self.ends[a:b] - low
            h = (total[end] - total[start]) * _powers("down", _INVERSE, n)[start]
            out[a:b] = mix(h + (end - start).astype(np.uint64))
            a = b
        return out


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive items; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + n])
    return out


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; shorter texts make one."""
    h = words.hashes()
    runs = chain(h, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[:1] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(chain(h[a:b], b - a) ^ np.uint64(0xA5A5A5A5 + int(b - a)))
        else:
            out.append(h[:0])
    return out


def in_batches(texts, limit: int = 1 << 19):
    """Cut a list of byte texts where a batch passes ``limit`` bytes; yields index ranges."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
