"""Fill-in-the-middle documents: cut at line ends that are found by combining what is known of shared chunks.

A text falls into content-defined chunks. A chunk's summary (its line ends, its characters up to each, whether it holds a
marker, and its first and last bytes) is made once and kept by content, so passages that documents share are read
once by a worker. A document's lines are the sum of its chunks' line ends; the sums before each chunk tell which chunk
holds a cut, and that chunk's summary tells where. A marker that spans chunks is found in their boundary bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.chunks import ChunkCache, chunk_ends
from ledgerline.llm.storage import small_batches
from ledgerline.llm.wordhash import in_batches
from ledgerline.llm.workers import frugal, kept

#: What precedes the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, key: object) -> list[int]:
    """Four random numbers of 32 bits for a document: its two cuts, whether it is transformed and into which form."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def summarize(chunk: bytes, markers: tuple[bytes, ...]) -> tuple:
    """(line ends, characters up to each, characters, holds a marker, first bytes, last bytes) of a chunk.

    The first and last bytes are one less than the longest marker's, enough to tell one that spans chunks.
    """
    ends, at = [], chunk.find(b"\n")
    while at >= 0:
        ends.append(at + 1)
        at = chunk.find(b"\n", at + 1)
    if chunk.isascii():
        chars, total = ends, len(chunk)
    else:
        upto = np.cumsum((np.frombuffer(chunk, dtype=np.uint8) & 0xC0) != 0x80)
        chars, total = [int(upto[e - 1]) for e in ends], int(upto[-1])
    edge = max(map(len, markers)) - 1
    return ends, chars, total, any(m in chunk for m in markers), chunk[:edge], chunk[len(chunk) - edge :] if len(chunk) > edge else chunk


def weight(summary: tuple) -> int:
    """About the bytes that a summary takes."""
    return 400 + 16 * len(summary[0]) + (32 * len(summary[0]) if summary[1] is not summary[0] else 0)


class Lines:
    """A text's line units and its cuts, from its chunks' summaries."""

    def __init__(self, chunks: list[tuple[int, tuple]], markers: tuple[bytes, ...]):
        """chunks: (size in bytes, summary) from first to last."""
        self.chunks = chunks
        self.lines = list(accumulate((len(s[0]) for _, s in chunks), initial=0))
        last = chunks[-1] if chunks else None
        open_end = bool(last) and not (last[1][0] and last[1][0][-1] == last[0])
        self.n = self.lines[-1] + open_end
        self.marked = self._marked(markers)

    def _marked(self, markers: tuple[bytes, ...]) -> bool:
        edge, carry = max(map(len, markers)) - 1, b""
        for _, (_, _, _, holds, head, tail) in self.chunks:
            if holds or any(m in carry + head for m in markers):
                return True
            carry = (carry + tail)[-edge:] if edge else b""
        return False

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, characters) of the first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units > self.lines[-1]:
            return self._before(len(self.chunks))
        i = bisect_left(self.lines, units) - 1
        ends, chars = self.chunks[i][1][:2]
        place = units - self.lines[i] - 1
        b, c = self._before(i)
        return b + ends[place], c + chars[place]

    def _before(self, i: int) -> tuple[int, int]:
        return sum(size for size, _ in self.chunks[:i]), sum(s[2] for _, s in self.chunks[:i])


def transformed(text: bytes, key: object, lines: Lines, seed: int, percent: int, spm: int, markers: tuple[bytes, ...]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws(seed, key)
    if not text or lines.marked or h3 % 100 >= percent:
        return lines.n, "plain", None, None, text
    a, b = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (first, first_chars), (second, second_chars) = lines.cut(a), lines.cut(b)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = markers
    if h4 % 100 < spm:
        return lines.n, "spm", first_chars, second_chars - first_chars, b"".join((s, suffix, p, prefix, m, middle))
    return lines.n, "psm", first_chars, second_chars - first_chars, b"".join((p, prefix, s, suffix, m, middle))


def _transform(seed: int, percent: int, spm: int, markers: tuple[bytes, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept(("chunk summaries", markers), lambda: ChunkCache(lambda chunk: summarize(chunk, markers), weight))
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("key").to_pylist()
            texts = [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in in_batches(texts):
                raw = b"".join(texts[a:b])
                offsets = np.cumsum([0, *map(len, texts[a:b])])
                ends = chunk_ends(np.frombuffer(raw, dtype=np.uint8), offsets)
                first = np.searchsorted(ends, offsets, "right").tolist()
                ends = [0, *ends.tolist()]
                rows = []
                for i in range(a, b):
                    chunks = [(ends[j + 1] - ends[j], cache[raw[ends[j] : ends[j + 1]]]) for j in range(first[i - a], first[i - a + 1])]
                    rows.append(transformed(texts[i], keys[i], Lines(chunks, markers), seed, percent, spm, markers))
                n, form, before, middle, output = zip(*rows)
                yield pa.record_batch(
                    [ids[a:b], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return frugal(run)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: its text cut at line ends into prefix, middle and suffix.

    n counts the lines, each with its line end. ``percent`` of the documents are transformed, ``spm`` percent of these suffix first,
    told by a hash of seed and id alone, so reruns and repeated rows agree. form is psm (prefix, suffix, middle), spm (suffix,
    prefix, middle), or plain, where output is the text as it is and both counts of characters are null: an empty text, one that
    holds a marker, or one that isn't chosen. A null text counts as an empty one, a null id as an empty one too; no row is lost. Any part may
    be empty. Other columns are ignored. One pass without a shuffle; a task holds a batch of texts and a cache of bounded bytes.
    """
    if not len(set(markers)) == 3 or not all(markers):
        raise ValueError("markers must be three different texts that aren't empty")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_transform(seed, percent, spm, tuple(m.encode() for m in markers)), f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column | str, form: Column | str, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of; a transformed text holds no marker, so the three of its output part it."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
