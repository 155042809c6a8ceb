"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from itertools import combinations


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(rows, percent=85):
    """{index: (n_shingles, component)} of [(id, text)]."""
    sets = [shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for n, s in enumerate(sets):
        for token in s:
            owners.setdefault(token, []).append(n)
    pairs = set()
    for group in owners.values():
        pairs.update(combinations(group, 2)) if len(group) < 200 else pairs.update((a, b) for a in group for b in group if a < b)
    for a, b in pairs:
        i, j = rows[a][0], rows[b][0]
        if i is None or j is None:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return [(i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(rows, items, window=13):
    found = {}
    wins = {}
    for item, text in items:
        w = alnum_words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    lengths = sorted({len(w) for w in wins})
    out = []
    for doc, text in rows:
        w = alnum_words(text)
        hit, got = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    got |= x
        digest = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(got), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
