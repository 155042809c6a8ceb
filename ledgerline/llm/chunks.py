"""Texts in content-defined chunks, and a bounded cache of what is known of a chunk.

A rolling hash over the last WINDOW bytes ends a chunk wherever its top bits are zero, so equal passages of different
texts fall into equal chunks, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes that the rolling hash looks back over (a power of two), the bits that are zero where a chunk ends, and the longest chunk.
WINDOW, CUT_BITS, LONGEST = 32, 9, 4096
_GEAR = np.random.default_rng(20240311).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of its and the WINDOW - 1 earlier bytes' random values, each shifted by its distance."""
    out, step = _GEAR[data], 1
    while step < WINDOW:
        wider = out.copy()
        wider[step:] += out[:-step] << np.uint32(step)
        out, step = wider, 2 * step
    return out


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending ends of the chunks of texts that lie end to end; text i is data[offsets[i]:offsets[i + 1]], and UTF-8.

    No chunk spans two texts, splits a character or passes LONGEST bytes. A text's first WINDOW bytes have no cut of the
    hash's, as it would look back into the text before.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    cuts = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    cuts = cuts[cuts < len(data)]
    start = offsets[np.searchsorted(offsets, cuts, "right") - 1]
    cuts = cuts[(cuts - start >= WINDOW) & (data[cuts] & 0xC0 != 0x80)]
    ends = np.union1d(cuts, offsets[1:])
    ends = ends[ends > 0]
    sizes = np.diff(ends, prepend=0)
    more = []
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        at, end = int(ends[i] - sizes[i]), int(ends[i])
        while end - at > LONGEST:
            cut = at + LONGEST
            # A character has four bytes at most; what isn't UTF-8 is cut anywhere.
            back = next((b for b in range(4) if data[cut - b] & 0xC0 != 0x80), 0)
            at = cut - back
            more.append(at)
    return np.union1d(ends, np.array(more, dtype=np.int64)) if more else ends


class ChunkCache:
    """Values of chunks by their content, in two generations that are bounded in bytes.

    A chunk is found by its hash and its bytes are compared, so a value is always that of just these bytes. What
    is used stays, the rest goes when the older generation is dropped.
    """

    def __init__(self, compute: Callable[[bytes], tuple], weight: Callable[[tuple], int], most: int = 32 << 20):
        self.compute, self.weight, self.most = compute, weight, most
        self.now: dict[bytes, tuple] = {}
        self.before: dict[bytes, tuple] = {}
        self.size = 0

    def __getitem__(self, chunk: bytes) -> tuple:
        found = self.now.get(chunk)
        if found is None:
            found = self.before.get(chunk)
            if found is None:
                found = self.compute(chunk)
            if self.size > self.most:
                self.before, self.now, self.size = self.now, {}, 0
            self.now[chunk] = found
            self.size += len(chunk) + self.weight(found)
        return found
