"""Byte-pair merging of many words at once, exactly by merge rank."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

from ledgerline.llm.plain_tokens import binary_of, bytes_of

_NONE = np.iinfo(np.int32).max
#: Spreads pairs over the slots of a hash table by the high bits of a product.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes from which a word is merged by a heap: rounds over all words would each pass over it.
LONG = 2048


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class PairMerger:
    """A byte-level vocabulary and its merges as arrays; ``end`` is the suffix of a word's last symbol."""

    def __init__(self, model: dict, end: str = ""):
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        pair = (left << 32) | right
        by = np.argsort(pair, kind="stable")
        self.pairs, self.ranks, self.made = pair[by], by.astype(np.int32), made[by]
        self.by_pair = None
        # Open addressing: a pair lies in the first free slot from its own on; at most half of them are taken.
        bits = max(1, int(2 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank, self.slot_made = np.full(1 << bits, _NONE, dtype=np.int32), np.zeros(1 << bits, dtype=np.int64)
        waiting, slot = np.arange(len(self.pairs)), self._slot(self.pairs)
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = self.pairs[waiting[free]]
            lies = self.slots[slot] == self.pairs[waiting]
            self.slot_rank[slot[lies]], self.slot_made[slot[lies]] = self.ranks[waiting[lies]], self.made[waiting[lies]]
            waiting, slot = waiting[~lies], (slot[~lies] + 1) & (len(self.slots) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact token ids of each word."""
        return [np.frombuffer(x, dtype=np.int32) for x in self.merge_bytes(words, np.dtype(np.int32).str)]

    def merge_bytes(self, words: list[bytes], dtype: str) -> list[bytes]:
        """merge() as each word's ids in bytes."""
        if words and max(map(len, words)) >= LONG:
            short = iter(self.merge_bytes([w for w in words if len(w) < LONG], dtype))
            return [self._merged_long(w).astype(dtype).tobytes() if len(w) >= LONG else next(short) for w in words]
        flat, ends = self._merged(np.frombuffer(b"".join(words), dtype=np.uint8), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        data, cut = flat.astype(dtype).tobytes(), (ends * np.dtype(dtype).itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def merge_array(self, words: pa.Array, dtype: str) -> pa.Array:
        """merge_bytes() of large_binary words."""
        data, at = bytes_of(words)
        size = np.diff(at)
        if len(size) and size.max() >= LONG:
            return pa.array(self.merge_bytes(words.to_pylist(), dtype), pa.large_binary())
        flat, ends = self._merged(data, size)
        return binary_of(flat.astype(dtype).view(np.uint8), np.concatenate([[0], ends]) * np.dtype(dtype).itemsize)

    def _lookup(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, what it makes) of pairs; _NONE is the rank of a pair that doesn't merge."""
        slot = self._slot(pair)
        held = self.slots[slot]
        wrong = np.flatnonzero((held != pair) & (held >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[wrong]]
            wrong = wrong[(held != pair[wrong]) & (held >= 0)]
        return self.slot_rank[slot], self.slot_made[slot]

    def _merged_long(self, word: bytes) -> np.ndarray:
        """One long word's ids: pairs wait in a heap by rank, then place, so time grows little faster than the word."""
        data = np.frombuffer(word, dtype=np.uint8)
        first = self.inner[data]
        first[-1] = self.last[data[-1]]
        rank, made = self._lookup((first[:-1] << 32) | first[1:])
        at = np.flatnonzero(rank != _NONE)
        symbol = first.tolist()
        heap = list(zip(rank[at].tolist(), at.tolist(), first[at].tolist(), first[at + 1].tolist(), made[at].tolist()))
        heapq.heapify(heap)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self._merges()
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has gone
            symbol[i], symbol[j] = to, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (m := merges.get((to << 32) | symbol[k])) is not None:
                    heapq.heappush(heap, (m[0], i, to, symbol[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h] << 32) | to)) is not None:
                heapq.heappush(heap, (m[0], h, symbol[h], to, m[1]))
        return np.array([x for x in symbol if x >= 0], dtype=np.int64)

    def _merges(self) -> dict[int, tuple[int, int]]:
        """{pair: (rank, what it makes)}, made when a long word is first met."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        return self.by_pair

    def _merged(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order and where each word's end: at every step all occurrences of a word's lowest-ranked pair merge.

        ``data`` is the words' bytes, one word behind the other.
        """
        if not len(data):
            return np.zeros(0, dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        symbol = self.inner[data]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(size)), size)
        done_symbol, done_word = [], []
        rank = np.full(len(symbol), _NONE, dtype=np.int32)  # of the pair that begins at each symbol
        made = np.zeros(len(symbol), dtype=np.int64)  # what that pair makes
        look = np.arange(len(symbol))
        while len(symbol):
            # Only pairs beside the last round's merges are new.
            look = look[look + 1 < len(symbol)]
            inside = word[look] == word[look + 1]
            rank[look[~inside]] = _NONE
            look = look[inside]
            pair = (symbol[look] << 32) | symbol[look + 1]
            rank[look], made[look] = self._lookup(pair)
            rank[-1] = _NONE
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbol))))
            over = least == _NONE
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
            at = np.flatnonzero((rank == least) & ~over)
            if len(at):
                # In a run of overlapping equal pairs every other one merges, from the left.
                fresh = np.concatenate([[True], np.diff(at) != 1])
                run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = made[at]
            stay = ~over
            stay[at + 1] = False
            changed = np.zeros(len(symbol), dtype=bool)
            changed[at] = True
            symbol, word, rank, made, changed = symbol[stay], word[stay], rank[stay], made[stay], changed[stay]
            changed[:-1] |= changed[1:]
            look = np.flatnonzero(changed)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return symbol[by], np.cumsum(np.bincount(word, minlength=len(size)))
