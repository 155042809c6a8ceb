"""Exact Jaccard join of texts on word shingles, with token-combination prefixes.

Tokens (shingles) are ordered by how many sets they occur in, rare first, and fall into classes:
a rare token is a signature by itself; tokens of the frequent class are signatures
only in combinations of two from the same sub-class. A set's prefix is the
shortest run of its ordered tokens in which destroying every signature takes more
deletions than the threshold allows: sum over sub-classes of max(0, n - k + 1) >
size - least overlap. Two sets that link then share a signature of their prefixes,
so no link is lost where only pairs that share a signature are compared. Documents that signatures
connect fall into groups, and groups into blocks of bounded size; two blocks meet in a task only if they share a signature, and there
every pair that shares one, of sizes that allow a link, is verified exactly.

A token's class is told by an exact count over all documents, in two rounds: each set offers its tokens of
least hash, somewhat more than a prefix, and offers are counted by token; then sets that have too few
tokens that nobody else offers, as near copies do, offer all of theirs. Tokens that more than one set offers, and
those that more than RARE do, are listed in bitmaps, which grow with their number up to a bound.
Classes only order tokens, so a bitmap's collisions cost speed and never a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import wordhash as wh
from ledgerline.llm.bitmaps import MOST_BITS, bitmap, bits_for, listed
from ledgerline.llm.graph import connected_components
from ledgerline.llm.storage import discard, small_batches, written
from ledgerline.llm.workers import frugal

#: Sets that offer a token, at most, if it is rare and so a signature by itself.
RARE = 4
#: From which set size frequent tokens pair up, at least, and in how many sub-classes; pairs stay inside one.
SUBCLASSES = ((48, 4), (100, 8), (200, 16), (400, 32), (800, 64), (1600, 128), (3200, 256), (6400, 512))
#: Digests that a task remembers, to pass over repeated sets.
REMEMBERED = 200_000
#: Shingles and sets that one block of a group holds, about.
BLOCK_TOKENS, BLOCK_SETS = 1 << 17, 1000
#: Rows of a block whose candidates are held at a time.
STRIP = 256
#: Pairs up to which tokens are compared pair by pair.
FEW = 32


def least_overlap(size: int, percent: int) -> int:
    """Shared tokens that a set of ``size`` needs with any set it links to."""
    return -(-percent * size // 100)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a = wh.mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
        b = wh.mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(a.view(np.int64)), int(b.view(np.int64))


class _Seen:
    """The sets that a task has met lately."""

    def __init__(self):
        self.digests: set[tuple[int, int]] = set()

    def again(self, digest: tuple[int, int]) -> bool:
        if digest in self.digests:
            return True
        if len(self.digests) >= REMEMBERED:
            self.digests.clear()
        self.digests.add(digest)
        return False


def offered(size: int, percent: int) -> int:
    """How many tokens of least hash a set offers for counting."""
    need = size - least_overlap(size, percent) + 1
    return min(size, need + 3 * need // 4 + 4)


def _scan(k: int, percent: int, least_size: int):
    """Each document's set size and digest, and the tokens that it offers unless its set has been met."""
    schema = pa.schema([("row", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("offer", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, texts = batch.column("id"), _texts(batch, "text")
            for a, b in wh.in_batches(texts):
                sets = wh.shingles(wh.Words(texts[a:b], wh.SPACED), k)
                digests = [_digest(s) for s in sets]
                offers = [s[: offered(len(s), percent)] if len(s) >= least_size and not seen.again(d) else s[:0] for s, d in zip(sets, digests)]
                ends = np.cumsum([0, *map(len, offers)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        ids[a:b].cast(pa.int64()),
                        batch.column("text_hash")[a:b],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(offers).view(np.int64))),
                    ],
                    schema=schema,
                )

    return frugal(run), "row long, text_hash long, n long, h1 long, h2 long, offer array<long>"


def _short(percent: int, tables):
    """Ids of the sets whose offer holds fewer tokens of class 0 than a prefix needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offer = batch.column("offer")
            size = np.diff(offer.offsets.to_numpy())
            rare = ranks(offer.flatten().to_numpy(), tables.value) == 0
            ends = np.cumsum(size)
            rare = np.concatenate([[0], np.cumsum(rare)])
            n = batch.column("n").to_numpy()
            need = n + (-percent * n) // 100 + 1
            short = (size > 0) & (rare[ends] - rare[ends - size] < need)
            yield batch.filter(pa.array(short)).select(["rep"])

    return frugal(run)


def _all_tokens(k: int, least_size: int, flags):
    """Every token of every different set of a task, of rows (h, text) whose hash is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = _Seen(), np.frombuffer(flags.value, dtype=np.uint8)
        for batch in batches:
            texts = _texts(batch.filter(pa.array(listed(table, batch.column("h").to_numpy()))), "text")
            for a, b in wh.in_batches(texts):
                sets = [(d[0], s) for s in wh.shingles(wh.Words(texts[a:b], wh.SPACED), k) if len(s) >= least_size and not seen.again(d := _digest(s))]
                if sets:
                    nodes = np.repeat(np.array([node >> 32 for node, _ in sets], dtype=np.int32), [len(s) for _, s in sets])
                    yield pa.record_batch([pa.array(np.concatenate([s for _, s in sets]).view(np.int64)), pa.array(nodes)], names=["token", "node"])

    return frugal(run), "token long, node int"


def ranks(tokens: np.ndarray, tables: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Class of each token: 0 if no table lists it, 2 if one lists it as frequent, else 1."""
    out = np.zeros(len(tokens), dtype=np.int8)
    for often, frequent in tables:
        found = [listed(np.frombuffer(x, dtype=np.uint8), tokens) for x in (often, frequent)]
        np.maximum(out, found[0].astype(np.int8) + (found[0] & found[1]), out=out)
    return out


def token_classes(offers: DataFrame) -> tuple[tuple[bytes, bytes], int]:
    """((listed, frequent), singles) of offers (token, node): bitmaps of the tokens that sets offer often and of those they offer
    more than RARE times; and the last class whose tokens are signatures by themselves.

    Often means by two sets; a node stands for a set, which several tasks may offer. Where tokens of two sets are more than the
    largest bitmap can tell apart, it means the least power of two that leaves few enough.
    """
    counts = offers.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    counts = written(counts.where("low < high").select("token", "n"), "token-counts")
    # One row for each power of two.
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("tokens")).collect()
    least = 1
    while sum(r["tokens"] for r in levels if r["level"] >= least) > 1 << (MOST_BITS - 1):
        least += 1
    tables = []
    for often in (counts.where(F.col("n") >= 1 << least), counts.where(F.col("n") > max(RARE, (1 << least) - 1))):
        tables.append(bitmap(often, "token", bits_for(often.count())))
    discard(counts)
    return (tables[0], tables[1]), 1 if (1 << least) <= RARE + 1 else -1


def _schemes(percent: int) -> list[tuple[int, int]]:
    """(least size, sub-classes) of each band of set sizes; 0 sub-classes: single tokens only.

    With m sub-classes a set of n frequent tokens survives at least n - m deletions, which
    must exceed what the threshold allows also for the smallest partner of the band.
    """
    p = percent / 100
    return [(0, 0), *((max(low, int((m + 2) / p / p) + 2), m) for low, m in SUBCLASSES)]


def _pairs_of(tokens: np.ndarray, sub: np.ndarray) -> list[np.ndarray]:
    """Keys of all pairs of one sub-class; tokens are sorted by (sub, token)."""
    keys, step = [], 1
    while step < len(tokens):
        same = np.flatnonzero(sub[step:] == sub[:-step])
        if not len(same):
            break
        keys.append(wh.mix(tokens[same] * np.uint64(0x9FB21C651E98DF25) + wh.mix(tokens[same + step])))
        step += 1
    return keys


def _signatures_of(s: np.ndarray, rank: np.ndarray, singles: int, percent: int, schemes: list[tuple[int, int]]) -> np.ndarray:
    """Keys of one sorted set, given its tokens' classes: single rare tokens, and pairs of frequent ones, in its prefix.

    A set uses the scheme of its size's band, and the next band's too where a partner can be there. Tokens up
    to class ``singles`` are rare.
    """
    n = len(s)
    need = n - least_overlap(n, percent) + 1
    order = np.argsort(rank, kind="stable")
    s, rank = s[order], rank[order]
    rare = int(np.searchsorted(rank, singles, "right"))
    if rare >= need:
        return s[:need]
    bands = [
        (number, parts)
        for number, (low, parts) in enumerate(schemes)
        if 100 * n >= percent * low and n < (schemes[number + 1][0] if number + 1 < len(schemes) else n + 1)
    ]
    if not all(parts for _, parts in bands):
        keys = [s[:need]]
    else:
        keys = [s[:rare]]
    for number, parts in bands:
        if not parts:
            continue
        salt = wh.mix(np.full(1, number + 1, dtype=np.uint64))
        tail = s[rare:]
        sub = ((wh.mix(tail) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        # A frequent token costs one more deletion unless it is the first of its sub-class.
        gain = np.ones(len(tail), dtype=np.int64)
        gain[np.unique(sub, return_index=True)[1]] = 0
        upto = int(np.searchsorted(np.cumsum(gain) + rare, need)) + 1
        tail, sub = tail[:upto], sub[:upto]
        by = np.lexsort((tail, sub))
        keys.extend(k ^ salt for k in _pairs_of(tail[by], sub[by]))
    return np.concatenate(keys)


def _postings(k: int, percent: int, tables, singles: int, least_size: int):
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = _schemes(percent)
        seen = _Seen()
        for batch in batches:
            texts = _texts(batch, "text")
            for a, b in wh.in_batches(texts):
                sets = [(d[0], s) for s in wh.shingles(wh.Words(texts[a:b], wh.SPACED), k) if len(s) >= least_size and not seen.again(d := _digest(s))]
                if not sets:
                    continue
                tokens = np.concatenate([s for _, s in sets])
                classes = np.split(ranks(tokens, tables.value), np.cumsum([len(s) for _, s in sets])[:-1])
                keys = [_signatures_of(s, rank, singles, percent, schemes) for (_, s), rank in zip(sets, classes)]
                nodes = np.repeat(np.array([node for node, _ in sets], dtype=np.int64), [len(x) for x in keys])
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes)], schema=schema)

    return frugal(run), "key long, node long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key and node: those of keys that several nodes hold leave once, each with its key's first node."""
    last = (None, None, None, False)  # the row before: key, node, the key's first node, whether it has left
    for batch in batches:
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        if len(key):
            new[0] = (last[0], last[1]) != (key[0], node[0])
        key, node = key[new], node[new]
        if not len(key):
            continue
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        head[0] = last[0] is None or key[0] != last[0]
        place = np.where(head, np.arange(len(key)), -1)
        at = np.maximum.accumulate(place)
        first = np.where(at >= 0, node[np.maximum(at, 0)], last[2] if last[2] is not None else 0)
        # A first row leaves when a second one has come, which may be in the next batch.
        leaves = ~head
        leaves[:-1] |= ~head[1:]
        columns = [key[leaves], node[leaves], first[leaves]]
        if not head[0] and not last[3]:
            columns = [np.concatenate([[x], c]) for x, c in zip(last[:3], columns)]
        last = (key[-1], node[-1], first[-1], bool(leaves[-1]))
        if len(columns[0]):
            yield pa.record_batch([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["key", "node", "pivot"])


def _flags_of(ids: DataFrame):
    """A bitmap of bounded size, shared with the tasks, of the hashes of ``ids`` (rep)."""
    return ids.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("rep").alias("h")), "h", bits_for(ids.count())))


def _sets(k: int, flags):
    """The set and its digest of each row (id, text, h) whose hash is listed; a join drops those that the bitmap lets through by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(flags.value, dtype=np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(listed(table, batch.column("h").to_numpy())))
            ids, texts = batch.column("id"), _texts(batch, "text")
            for a, b in wh.in_batches(texts):
                sets = wh.shingles(wh.Words(texts[a:b], wh.SPACED), k)
                digests = [_digest(s) for s in sets]
                yield pa.record_batch(
                    [ids[a:b], pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "h1", "h2", "tokens"],
                )

    return frugal(run), "id long, h1 long, h2 long, tokens binary"


def candidates(keys: list[np.ndarray], size: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (one of ``left``, one of ``right``) that share a key and whose sizes allow a link, for a strip of ``left`` at a time.

    A pair inside one block comes once.
    """
    own = np.unique(np.concatenate([left, right]))
    flat = np.concatenate([keys[i] for i in own])
    owner = np.repeat(own, [len(keys[i]) for i in own])
    by = np.lexsort((owner, flat))
    flat, owner = flat[by], owner[by]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(starts, len(flat)))
    # Keys that the same sets hold say the same; sums of their owners' hashes tell them apart.
    hashes = wh.mix(owner.astype(np.uint64) + np.uint64(0x51ED270B))
    of = np.add.reduceat(hashes, starts) if len(starts) else hashes[:0]
    _, once = np.unique(of, return_index=True)
    groups = [owner[starts[i] : starts[i] + count[i]] for i in once[count[once] > 1].tolist()]
    place = np.full((2, len(keys)), -1)
    place[1, right] = np.arange(len(right))
    for first in range(0, len(left), STRIP):
        strip = left[first : first + STRIP]
        place[0] = -1
        place[0, strip] = np.arange(len(strip))
        mask = np.zeros((len(strip), len(right)), dtype=bool)
        for these in groups:
            a, b = place[0, these], place[1, these]
            mask[np.ix_(a[a >= 0], b[b >= 0])] = True
        low, high = np.minimum.outer(size[strip], size[right]), np.maximum.outer(size[strip], size[right])
        mask &= 100 * low >= percent * high
        mask &= strip[:, None] < right[None, :] if left is right else strip[:, None] != right[None, :]
        i, j = np.nonzero(mask)
        yield strip[i], right[j]


def shared_tokens(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shared tokens of each pair (i, j) of sorted ``sets``, by bits of a strip of tokens at a time."""
    if len(i) <= FEW:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    own = np.unique(np.concatenate([i, j]))
    row = np.full(len(sets), -1)
    row[own] = np.arange(len(own))
    tokens = np.concatenate([sets[x] for x in own])
    owner = np.repeat(np.arange(len(own)), [len(sets[x]) for x in own])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    keep = np.bincount(column)[column] > 1
    column, owner = column[keep], owner[keep]
    _, column = np.unique(column, return_inverse=True)
    top = int(column[-1]) + 1 if len(column) else 0
    step = max(64, (16 << 20) // len(own) // 64 * 64)
    both, a, b = np.zeros(len(i), dtype=np.int64), row[i], row[j]
    for low in range(0, top, step):
        x, y = np.searchsorted(column, [low, low + step])
        flags = np.zeros((len(own), min(step, -(-(top - low) // 64) * 64)), dtype=bool)
        flags[owner[x:y], column[x:y] - low] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        del flags
        part = max(1, (8 << 20) // bits.shape[1] // 8)
        for at in range(0, len(i), part):
            both[at : at + part] += np.bitwise_count(bits[a[at : at + part]] & bits[b[at : at + part]]).sum(axis=1, dtype=np.int64)
    return both


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after links (i, j): sets that they tie together share the smallest of their labels."""
    a, b = label[i], label[j]
    apart = a != b
    if not apart.any():
        return label
    names, of = np.unique(label, return_inverse=True)
    x, y = (np.searchsorted(names, c[apart]) for c in (a, b))
    low = names.copy()
    while True:
        least = np.minimum(low[x], low[y])
        if (least == low[x]).all() and (least == low[y]).all():
            return low[of]
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)


def degrees_and_roots(sets: list[np.ndarray], keys: list[np.ndarray], percent: int, vertex: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each set, its links between ``left`` and ``right`` and the smallest vertex it reaches by them; and how many pairs were compared."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    degree, root, compared = np.zeros(len(sets), dtype=np.int64), np.array(vertex, dtype=np.int64), 0
    for i, j in candidates(keys, size, percent, left, right):
        both = shared_tokens(sets, i, j)
        hit = 100 * both >= percent * (size[i] + size[j] - both)
        compared += len(i)
        i, j = i[hit], j[hit]
        degree += np.bincount(i, minlength=len(sets)) + np.bincount(j, minlength=len(sets))
        root = joined_labels(root, i, j)
    return degree, root, compared


def _verify(percent: int):
    """Rows arrive sorted by unit; each unit's links leave as a forest, with each set's links counted there, and the pairs compared."""
    names = ("u", "v", "vertex", "block", "tokens", "keys")

    def unit(rows: list[tuple]) -> pa.RecordBatch:
        u, v = rows[0][:2]
        sets, keys = ([np.frombuffer(r[c], dtype=np.uint64) for r in rows] for c in (4, 5))
        vertex, block = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows])
        # A pair inside one block belongs to that block's own unit.
        left = np.flatnonzero(block == u)
        right = left if u == v else np.flatnonzero(block == v)
        degree, root, compared = degrees_and_roots(sets, keys, percent, vertex, left, right)
        tied, linked = np.flatnonzero(root != vertex), np.flatnonzero(degree)
        a = np.concatenate([root[tied], vertex[linked], vertex[:1]])
        b = np.concatenate([vertex[tied], vertex[linked], vertex[:1]])
        n = np.concatenate([np.zeros(len(tied), dtype=np.int64), degree[linked], [0]])
        c = np.zeros(len(a), dtype=np.int64)
        c[-1] = compared
        return pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, n, c)], names=["a", "b", "n_links", "compared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        met: set[int] = set()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if rows and rows[0][:2] != row[:2]:
                    if len(rows) > 1:
                        yield unit(rows)
                    rows, met = [], set()
                if row[2] not in met:  # rows that repeat bring a set again
                    rows.append(row)
                    met.add(row[2])
        if len(rows) > 1:
            yield unit(rows)

    return frugal(run), "a long, b long, n_links long, compared long"


class Links:
    """The sets of a table and their links, as written tables: see near_copies()."""

    def __init__(self, rows: DataFrame, classes: DataFrame, found: DataFrame):
        #: (id, text_hash, n, h1, h2) of every row; (vertex, h1, h2, rep, n) of every different set; (a, b, n_links, compared).
        self.rows, self.classes, self.found = rows, classes, found

    def labels(self) -> DataFrame:
        """(h1, h2, component, low, n_links) of every different set; component is its smallest vertex, low the smallest id of its rows."""
        parts = connected_components(self.found.where("a <> b").select("a", "b"))
        degree = self.found.where("n_links > 0").groupBy(F.col("a").alias("vertex")).agg(F.sum("n_links").alias("n_links"))
        of = self.classes.join(parts, F.col("vertex") == F.col("node"), "left").withColumn("component", F.coalesce("component", "vertex")).drop("node")
        low = of.groupBy("component").agg(F.min("rep").alias("low"))
        return of.join(low, "component").join(degree, "vertex", "left").select("h1", "h2", "component", "low", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def link_sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> Links:
    """Find the links of the different shingle sets of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    # The smallest set that can link to a different set: one token more or less.
    least_size = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))
    run, schema = _scan(k, percent, least_size)
    scanned = written(rows.mapInArrow(run, schema), "scan")
    sizes = scanned.select(F.col("row").alias("id"), "text_hash", "n", "h1", "h2")
    offers = scanned.where("row is not null and size(offer) > 0").select(F.col("row").alias("rep"), "n", F.shiftright("h1", 32).cast("int").alias("node"), "offer")
    first, singles = token_classes(offers.select(F.explode("offer").alias("token"), "node"))
    short = written(offers.select("rep", "n", "offer").mapInArrow(_short(percent, spark.sparkContext.broadcast([first])), "rep long"), "short")
    run, schema = _all_tokens(k, least_size, _flags_of(short))
    second, also = token_classes(rows.where("id is not null").select("text", F.xxhash64("id").alias("h")).mapInArrow(run, schema))
    discard(short)
    run, schema = _postings(k, percent, spark.sparkContext.broadcast([first, second]), min(singles, also), least_size)
    postings = rows.where("id is not null").select("text").mapInArrow(run, schema).repartition("key").sortWithinPartitions("key", "node")
    shared = written(postings.mapInArrow(frugal(_shared), "key long, node long, pivot long"), "shared")
    groups = connected_components(shared.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    # A row's keys, and the smallest node that it shares one with.
    keys_of = written(shared.groupBy("node").agg(F.collect_list("key").alias("keys"), F.min("pivot").alias("near")), "keys")

    classes = sizes.where("id is not null and n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    classes = written(classes.withColumn("vertex", F.monotonically_increasing_id()), "classes")
    members = classes.join(groups, classes.h1 == groups.node).select("vertex", "rep", F.col("component").alias("cluster"), "n", "h1", "h2")
    members = members.join(keys_of.select("node", "near"), F.col("h1") == F.col("node")).drop("node")
    pieces = lambda: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_SETS))).cast("int")
    totals = members.groupBy("cluster").agg(pieces().alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    # A group that is larger than a block falls apart by the smallest node that its sets share a signature with, so sets that share some lie together.
    parts = members.groupBy("cluster", "near").agg(pieces().alias("pieces"))
    piece = F.pmod(F.xxhash64("h1", "h2"), F.col("pieces"))
    block = F.when(F.col("blocks") == 1, F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", "near", piece))
    blocks = members.join(totals, "cluster").join(parts, ["cluster", "near"]).select("vertex", "rep", "h1", "h2", block.alias("block"), (F.col("blocks") > 1).alias("parted"))
    blocks = written(blocks, "blocks")
    discard(groups)
    # Blocks meet where a signature is in both.
    spread = shared.join(blocks.where("parted").select(F.col("h1").alias("node"), "block"), "node").groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("met"))
    met = spread.where("size(met) > 1").select("met").distinct()
    across = met.select(F.explode("met").alias("u"), "met").select("u", F.explode("met").alias("v")).where("u < v").distinct()
    within = blocks.groupBy("block").agg(F.count("*").alias("m")).where("m > 1").select(F.col("block").alias("u"), F.col("block").alias("v"))
    units = written(across.union(within), "units")
    discard(shared)
    of_block = units.select(F.col("u").alias("block"), "u", "v").union(units.where("u <> v").select(F.col("v").alias("block"), "u", "v"))
    run, schema = _sets(k, _flags_of(blocks))
    # A repeated id brings its other texts' sets; only the class's own set stays.
    hashed = rows.where("id is not null").select("id", "text", F.xxhash64("id").alias("h"))
    near = hashed.mapInArrow(run, schema).withColumnRenamed("id", "rep")
    # Sets move twice: to where they are to go, and there.
    placed = blocks.join(keys_of.select(F.col("node").alias("h1"), _packed("keys").alias("keys")), "h1").join(of_block, "block")
    placed = placed.select("rep", "h1", "h2", "u", "v", "vertex", "block", "keys")
    sent = near.join(placed, ["rep", "h1", "h2"]).select("u", "v", "vertex", "block", "tokens", "keys").repartition("u", "v").sortWithinPartitions("u", "v")
    run, schema = _verify(percent)
    found = written(sent.mapInArrow(run, schema), "links")
    discard(blocks, keys_of, units)
    return Links(sizes, classes, found)


def _packed(keys: str) -> Column:
    """An array of longs as the bytes that numpy reads."""
    return F.unhex(F.array_join(F.transform(keys, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Every row's shingle count and component of links: (id, n_shingles, component_id, n_links).

    Two texts link when 100 * shared >= percent * union of their distinct k-word shingle
    sets. Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased; a
    text with fewer than k words has its whole sequence as its one shingle. Empty texts and
    null texts have no shingle, component themselves and link to nothing. Rows with a
    null id come back with a null component and link nothing. Equal sets are one class
    however many rows hold them; n_links counts the different sets that a row's set links
    to. Rows of one id with different texts are rows of their own, each with its own text's links and component; a component_id is
    the smallest id among the rows of the component. Other columns are ignored.
    """
    links = link_sets(docs, id_col, text_col, k, percent)
    out = links.rows.join(links.labels(), ["h1", "h2"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("low")).alias("component_id"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row left of each component of links: the one of the smallest id, then of the smallest hash of its text.

    Rows are judged one by one, by id and text, so an id that several texts have doesn't tie them together: of rows (1, A), (5, A),
    (5, B), (9, nearly B) the first and the third stay. Of rows that repeat both id and text one stays. Rows without an id, a text or words all stay.
    Columns pass through as they are, whatever their names.
    """
    links = link_sets(docs, id_col, text_col, k, percent)
    judged = links.rows.where("id is not null and n > 0").join(links.labels().select("h1", "h2", "component"), ["h1", "h2"])
    counts = judged.groupBy("component", "id", "text_hash").agg(F.count("*").alias("n_rows"))
    first = counts.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    stays = F.col("first") == F.struct("id", "text_hash")
    counts = written(counts.join(first, "component").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "n_rows", stays.alias("stays")), "judged")
    of_row = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash"))
    out = docs.join(counts.where("not stays").select("__id", "__hash"), of_row, "left_anti")
    again = counts.where("stays and n_rows > 1").select("__id", "__hash")
    if again.isEmpty():
        return out
    several = out.join(again, of_row, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(again, of_row, "left_anti").union(several)
