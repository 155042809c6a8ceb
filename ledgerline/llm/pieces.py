"""Texts cut at white space into pieces that tokenizers treat alone, and bounded caches of them."""

from __future__ import annotations

import re
from collections import ChainMap

import regex

#: White space in any sense that a tokenizer's pattern may use, and the controls some call white.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎           ​    　﻿"
_WHITE_SPACE = re.compile(f"[{WHITE}] ")
_ENDS_WHITE = re.compile(f"[{WHITE}]$")
#: Bytes of one generation of a worker's cache, about, and what an entry takes besides its text and value.
CACHE_SIZE, ENTRY = 64 << 20, 110
#: Characters of the longest piece that is kept; longer ones, such as lines of scripts without spaces, are rarely met again.
LONGEST = 256


#: Texts of characters that have had one meaning in every Unicode version in use.
PLAIN = regex.compile(r"[\x20-\x7E\n\u00A1-\u00AC\u00AE-\u024F]*")


def spaced_pieces(text: str) -> list[str]:
    """``text`` cut at every single space that follows a character that isn't white; these spaces are left out.

    The text is the pieces with one space between. Patterns in which white space only ever begins
    a token, and which look no further back than it, treat the first piece, and each other
    one behind its space, alone.
    """
    parts = text.split(" ")
    if not _WHITE_SPACE.search(text) and not text.startswith(" "):
        return parts
    out = [parts[0]]
    for x in parts[1:]:
        if not out[-1] or _ENDS_WHITE.search(out[-1]):
            out[-1] += " " + x
        else:
            out.append(x)
    return out


class PieceCache:
    """Values of texts' pieces. Two generations, bounded in bytes: what is used stays, the rest goes when the older one is dropped.

    Pieces of more than LONGEST characters are computed each time.
    """

    def __init__(self, compute, most: int = CACHE_SIZE, sized: bool = True):
        """sized: values are bytes, which count; numbers don't."""
        self.compute, self.most, self.sized, self.size = compute, most, sized, 0
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}

    def values(self, texts: list[list[str]]) -> list[list]:
        """Each text's values; ``compute`` gets all unknown pieces at once."""
        if self.size > self.most:
            self.before, self.now, self.size = self.now, {}, 0
        get = self.now.get
        found = [list(map(get, p)) for p in texts]
        holes = [[i for i, y in enumerate(v) if y is None] if None in v else [] for v in found]
        lacking = {p[i] for p, at in zip(texts, holes) for i in at}
        if not lacking:
            return found
        old, now = self.before, self.now
        again = {x: old[x] for x in lacking if x in old}
        new = [x for x in lacking if x not in old]
        now.update(again)
        made = self.compute(new) if new else []
        long: dict[str, object] = {}
        if new and max(map(len, new)) > LONGEST:
            long = {x: y for x, y in zip(new, made) if len(x) > LONGEST}
            made = [y for x, y in zip(new, made) if len(x) <= LONGEST]
            new = [x for x in new if len(x) <= LONGEST]
        now.update(zip(new, made))
        for x, y in ((again.keys(), again.values()), (new, made)):
            self.size += ENTRY * len(x) + 2 * sum(map(len, x)) + (sum(map(len, y)) if self.sized else 0)
        if long:
            now = ChainMap(now, long)
        for p, v, at in zip(texts, found, holes):
            for i in at:
                v[i] = now[p[i]]
        return found


def batches_by_size(texts: list[str], limit: int = 1 << 18):
    """Index ranges of runs of texts that pass ``limit`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
