"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

A text's words are symbols (64-bit hashes); the patterns are the benchmark's windows. Patterns of
one length m form a group with a shift table over blocks of two symbols: a block that
ends j symbols before the end of some pattern's first m symbols allows a shift of j, any
other block of m - 1. Where the shift is 0, the block's bucket of patterns is compared
by a hash of its whole suffix, and then word by word as bytes. All cursors of a
batch move together as a numpy array, each over its own stretch of a text.

The benchmark is compiled once, in blocks of a bounded size and one task each, into files of flat
arrays in the shared folder; tasks map them into memory and search one after another in one pass over a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerline.llm import wordhash as wh
from ledgerline.llm.shared_files import packed, unpacked, write_bytes
from ledgerline.llm.storage import discard, new_path, small_batches, written
from ledgerline.llm.workers import frugal, kept

#: Least and largest size of a shift table (powers of two), and the symbols that one cursor covers.
LEAST_TABLE_BITS, MOST_TABLE_BITS = 12, 22
STRETCH = 192
#: Bytes of benchmark text in a compiled block, about, and of compiled blocks that a worker holds open.
BLOCK_BYTES = 16 << 20
OPEN_BYTES = 512 << 20


def _slots(h: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Table slot of the block that ends at each symbol."""
    if length == 1:
        return (h >> np.uint64(64 - bits)).astype(np.int64)
    out = np.zeros(len(h), dtype=np.int64)
    out[1:] = (wh.chain(h, 2) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def words_bytes(words: wh.Words, a: int, b: int) -> bytes:
    """Words a to b as lower-cased bytes, one space between."""
    data = words.data
    return b" ".join([data[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b])])


def compile_patterns(names: list[str], texts: list[bytes], window: int = 13) -> list[bytes]:
    """File parts of all items' windows; a shorter item is one window, an empty one none.

    Each length has a shift table and its distinct windows, sorted by hash, with the place of their text and the
    items they are in. Windows of one hash are one only if their texts are equal.
    """
    words = wh.Words(texts, wh.ALNUM)
    h, first = words.hashes(), words.first
    counts = np.diff(first)
    item = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(first[1:], counts) - np.arange(len(h))  # words from each to its item's end
    # The words' bytes with one space between, where windows are slices.
    size = words.ends - words.starts
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    inside = _inside(words)
    text[np.repeat(begin - words.starts, size) + np.flatnonzero(inside)] = words.data[inside]
    arrays, lengths = {"text": text}, []
    for m in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        starts = np.flatnonzero(left >= m) if m == window else first[:-1][counts == m]
        bits = min(MOST_TABLE_BITS, max(LEAST_TABLE_BITS, int(len(starts)).bit_length() + 4))
        slots, widest = _slots(h, m, bits), max(1, m - 1)
        shift = np.full(1 << bits, widest, dtype=np.uint8)
        for back in range(widest - 1, -1, -1):
            shift[slots[starts + m - 1 - back]] = back
        runs = wh.chain(h, m)[starts]
        order = np.lexsort((item[starts], runs))
        starts, runs = starts[order], runs[order]
        at, end = begin[starts], begin[starts + m - 1] + size[starts + m - 1]
        new = np.ones(len(runs), dtype=bool)
        repeated = np.flatnonzero(runs[1:] == runs[:-1]) + 1
        for i in repeated.tolist():
            new[i] = text[at[i] : end[i]].tobytes() != text[at[i - 1] : end[i - 1]].tobytes()
        fresh = new.copy()  # and one entry for each item of a window
        fresh[1:] |= item[starts][1:] != item[starts][:-1]
        of = np.cumsum(new) - 1
        arrays |= {
            f"shift{m}": shift,
            f"key{m}": runs[new],
            f"at{m}": at[new],
            f"end{m}": end[new],
            f"from{m}": np.concatenate([[0], np.cumsum(np.bincount(of[fresh], minlength=int(new.sum())))]).astype(np.int64),
            f"item{m}": item[starts][fresh].astype(np.int32),
        }
        lengths.append(m)
    return packed({"names": names, "lengths": lengths}, arrays)


def _inside(words: wh.Words) -> np.ndarray:
    """True for the bytes that lie in words."""
    edge = np.zeros(len(words.data) + 1, dtype=np.int8)
    edge[words.starts] = 1
    edge[words.ends] = -1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


class Group:
    """All windows of one length in a block, as views of its file."""

    def __init__(self, length: int, arrays: dict[str, np.ndarray]):
        self.length, self.text = length, arrays["text"]
        self.shift, self.key, self.at, self.end, self.first, self.item = (arrays[f"{x}{length}"] for x in ("shift", "key", "at", "end", "from", "item"))
        self.bits = len(self.shift).bit_length() - 1

    def items(self, place: int, run: int, body: bytes) -> np.ndarray | None:
        """Items of the window with this hash, from its place in ``key`` on, and this text."""
        while place < len(self.key) and self.key[place] == run:
            if self.text[self.at[place] : self.end[place]].tobytes() == body:
                return self.item[self.first[place] : self.first[place + 1]]
            place += 1
        return None

    def search(self, words: wh.Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, items) of every occurrence in the batch."""
        m, first = self.length, words.first
        # A cursor holds the position of the last symbol of its window, up to its stretch's end.
        counts = np.diff(first)
        pieces = np.maximum(0, -(-(counts - m + 1) // STRETCH))
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[:-1][text] + nth * STRETCH + m - 1
        end = np.minimum(at + STRETCH, first[1:][text])
        slots = _slots(h, m, self.bits)
        hits = []
        while len(at):
            move = self.shift[slots[at]]
            stop = at[move == 0]
            if len(stop):
                hits.append(stop)
            at = at + np.maximum(move, 1)
            live = at < end
            at, end = at[live], end[live]
        if not hits:
            return
        begin = np.sort(np.concatenate(hits)) - m + 1
        runs = np.zeros(len(begin), dtype=np.uint64)
        for i in range(m):
            runs = wh.mix(runs * np.uint64(0x9FB21C651E98DF25) + h[begin + i])
        place = np.searchsorted(self.key, runs)
        same = self.key[np.minimum(place, len(self.key) - 1)] == runs
        for start, run, at_key in zip(begin[same].tolist(), runs[same].tolist(), place[same].tolist()):
            items = self.items(at_key, run, words_bytes(words, start, start + m))
            if items is not None:
                yield start, items


class Block:
    """A compiled part of the benchmark."""

    def __init__(self, uri: str):
        meta, arrays = unpacked(uri)
        self.names = meta["names"]
        self.groups = [Group(m, arrays) for m in meta["lengths"]]


class Blocks:
    """The compiled benchmark; what doesn't fit OPEN_BYTES is opened anew for each batch."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files, self.open, room = files, {}, OPEN_BYTES
        for uri, size in files:
            if size <= room:
                room -= size
                self.open[uri] = Block(uri)

    def __iter__(self) -> Iterator[Block]:
        for uri, _ in self.files:
            yield self.open.get(uri) or Block(uri)


def find(blocks, texts: list[bytes]) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
    """(words, names of items found, spans (first, last) of hit words) of each text."""
    words = wh.Words(texts, wh.ALNUM)
    h, first = words.hashes(), words.first
    cover = np.zeros(len(h) + 1, dtype=np.int32)
    names: dict[int, set[str]] = {}
    for block in blocks:
        for group in block.groups:
            for start, items in group.search(words, h):
                cover[start] += 1
                cover[start + group.length] -= 1
                names.setdefault(int(np.searchsorted(first, start, "right")) - 1, set()).update(block.names[i] for i in items)
    hit = np.cumsum(cover)[:-1] > 0
    out = []
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        spans = []
        if t in names:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
            spans = list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))
        out.append((b - a, sorted(names.get(t, ())), spans))
    return out


def _compile(folder: str, window: int):
    """Rows (block, item, text) arrive sorted by block; each block leaves as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, texts = None, [], []

        def done() -> pa.RecordBatch:
            parts = compile_patterns(names, texts, window)
            uri = f"{folder}/block-{block:06d}-{uuid.uuid4().hex}.bin"
            write_bytes(uri, parts)
            return pa.record_batch([pa.array([uri]), pa.array([sum(map(len, parts))], pa.int64())], names=["uri", "size"])

        for batch in batches:
            for at, name, text in zip(batch.column("block").to_pylist(), batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if at != block and names:
                    yield done()
                    names, texts = [], []
                block = at
                names.append(name)
                texts.append(text)
        if names:
            yield done()

    return frugal(run)


def compiled(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[tuple[str, int]]:
    """(address, bytes) of the benchmark's compiled blocks: a row for each BLOCK_BYTES of its text."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where(F.length("text") > 0).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block").sortWithinPartitions("block", "item", "text")
    index = written(dealt.select("block", "item", "text").mapInArrow(_compile(new_path(spark, "patterns"), window), "uri string, size long"), "pattern-files")
    files = sorted((r["uri"], r["size"]) for r in index.collect())
    discard(index)
    return files


def _search(files: list[tuple[str, int]], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = kept(("patterns", *files), lambda: Blocks(files))
        for batch in batches:
            row = batch.column("row")
            texts = [b"" if t is None else t for t in row.field(text_col).cast(pa.string()).cast(pa.binary()).to_pylist()]
            found = [x for a, b in wh.in_batches(texts) for x in find(blocks, texts[a:b])]
            yield pa.record_batch(
                [
                    row,
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([names for _, names, _ in found], pa.list_(pa.string())),
                    pa.array([[{"first": x, "last": y} for x, y in spans] for _, _, spans in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                ],
                names=["row", "n_words", "items", "spans"],
            )

    return frugal(run)


FOUND = StructType([StructField("n_words", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType())])))])


def add_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """(row, n_words, n_hit, n_items, items, spans, contaminated): each row of ``docs`` as a struct, and what it holds.

    Words are runs of a-z (after lower-casing A-Z), 0-9 and everything beyond ASCII. A
    window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. A word inside any occurrence is hit; a row is contaminated when it has hits and
    they are at least a twentieth of its words. items are item ids as sorted strings, spans runs of
    hit words (first, last). Null or empty texts have no words; items without words never occur; an
    item with a null id is skipped; repeated items count once. An empty benchmark
    leaves every row clean. Rows may repeat.

    A large benchmark is compiled in blocks, which each batch of texts is searched for one after
    another in one task, without a shuffle of the texts.
    """
    small_batches(docs.sparkSession)
    files = compiled(benchmark, item_col, item_text_col, window)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = StructType(rows.schema.fields + FOUND.fields)
    found = rows.mapInArrow(_search(files, text_col), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    found = found.select("row", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """add_contamination() with the id alone of each row."""
    found = add_contamination(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, "text", item_col, item_text_col, window)
    return found.select(F.col("row.id").alias(id_col), "n_words", "n_hit", "n_items", "items", "spans", "contaminated")
