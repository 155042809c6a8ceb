"""Token ids as Arrow IPC files of fixed-size-list batches, with zero-copy random access.

Documents are range-partitioned by id. Each task writes one file whose rows are
sequences of equal length and their masks; a document runs on from one sequence into the next, and only
a file's last sequence is padded (mask false). A file's batches have equal numbers
of rows, so a token's batch, row and column follow from its position alone, and a mapped
file gives views of its own bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe_merge import PairMerger
from ledgerline.llm.pieces import CACHE_SIZE, ENTRY, LONGEST, PLAIN, PieceCache, spaced_pieces
from ledgerline.llm.plain_tokens import TokenTable, bytes_of, encoded, in_two_ways, plain_texts, text_slices
from ledgerline.llm.shared_files import filesystem, mapped
from ledgerline.llm.storage import new_path, small_batches, written
from ledgerline.llm.workers import frugal, kept

SEQUENCE = 2048
ROWS = 256
#: The usual split of byte-level vocabularies, as their pre-tokenizer documents it.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class LibraryIds:
    """Texts' ids as bytes, equal to those of the tokenizers library for the same file.

    Each distinct token of the split is merged once, in bulk, by the file's own merges. Texts with special
    tokens or characters whose class could depend on the Unicode version are cut into pieces, and pieces with these go
    through the library itself.
    """

    def __init__(self, tokenizer_file: str, dtype: str):
        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = dtype
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(tokenizer_file, encoding="utf-8") as f:
            self.merger = PairMerger(json.load(f)["model"])
        self.table = TokenTable(lambda tokens: self.merger.merge_array(tokens, dtype))
        # A piece behind its space, and a text's first piece.
        self.spaced = PieceCache(lambda pieces: self._compute(pieces, " "))
        self.first = PieceCache(self._compute)
        self.tokens: dict[str, bytes] = {}
        self.held = 0

    def _compute(self, pieces: list[str], space: str = "") -> list[bytes]:
        """Ids of pieces, each behind a ``space``."""
        if self.held > CACHE_SIZE:
            self.tokens.clear()
            self.held = 0
        plain, findall, tokens = PLAIN.fullmatch, _SPLIT.findall, self.tokens
        out: list[bytes] = [b""] * len(pieces)
        words: list[int] = []  # pieces that are one token
        split: dict[int, list[str]] = {}
        new: dict[str, None] = {}
        for i, p in enumerate(pieces):
            ascii_ = p.isascii()
            if ascii_ and p.isalpha():
                words.append(i)
            elif not (ascii_ and p.isprintable() or plain(p)) or "<" in p and any(s in p for s in self.special):
                out[i] = np.array(self.library.encode(space + p, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
            elif space and p.isalpha():
                words.append(i)
            else:
                split[i] = found = findall(space + p)
                for t in found:
                    if t not in tokens:
                        new[t] = None
        merged = self.merger.merge_bytes([(space + pieces[i]).encode() for i in words] + [t.encode() for t in new], self.dtype)
        for i, ids in zip(words, merged):
            out[i] = ids
        tokens.update(zip(new, merged[len(words) :]))
        self.held += sum(ENTRY + 2 * len(t) for t in new)
        for i, found in split.items():
            out[i] = b"".join([tokens[t] for t in found])
        for t in new:
            if len(t) > LONGEST:
                del tokens[t]
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        return in_two_ways(texts, plain_texts(texts, self.special), lambda x: encoded(self.table, *bytes_of(x), spaced=True), self.by_pieces)

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        """encode() of texts of any characters."""
        pieces = [spaced_pieces(t) for t in texts]
        heads = self.first.values([p[:1] for p in pieces])
        rest = self.spaced.values([p[1:] for p in pieces])
        return [b"".join(h + r) for h, r in zip(heads, rest)]


def library_ids(tokenizer_file: str, dtype: str) -> LibraryIds:
    """One encoder a worker."""
    return kept(("ids", tokenizer_file, dtype), lambda: LibraryIds(tokenizer_file, dtype))


def id_type(tokenizer_file: str, end_id: int) -> str:
    """The smallest unsigned type that holds every id."""
    return "<u2" if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


class SequenceWriter:
    """Writes ids as fixed-size-list batches of a growing file."""

    def __init__(self, uri: str, dtype: str, sequence: int, rows: int):
        self.sequence, self.rows, self.dtype = sequence, rows, np.dtype(dtype)
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        system, path = filesystem(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.rows * self.sequence * self.dtype.itemsize * 4:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
        unit = self.rows * self.sequence
        whole = len(flat) // unit * unit
        for at in range(0, whole, unit):
            self._batch(flat[at : at + unit], unit)
        rest = flat[whole:]
        self.waiting, self.bytes = [rest.tobytes()], rest.nbytes
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.sequence) * self.sequence, dtype=self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to a written file; arrays are views of the mapped bytes."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(mapped(uri))
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self.batches: dict[int, tuple[np.ndarray, pa.Array]] = {}

    def _batch(self, i: int) -> tuple[np.ndarray, pa.Array]:
        if i not in self.batches:
            batch = self.reader.get_batch(i)
            self.batches[i] = (batch.column("ids").values.to_numpy(zero_copy_only=True), batch.column("mask").values)
        return self.batches[i]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence i."""
        ids, mask = self._batch(i // self.rows)
        at = i % self.rows * self.sequence
        return ids[at : at + self.sequence], mask.slice(at, self.sequence).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from a position of the file; a view unless they span batches."""
        unit = self.rows * self.sequence
        parts = []
        while n > 0:
            at = start % unit
            part = self._batch(start // unit)[0][at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _write(folder: str, tokenizer_file: str, dtype: str, end_id: int, sequence: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = library_ids(tokenizer_file, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width = len(end)
        uri, writer, at = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow", None, 0
        for batch in batches:
            ids = batch.column("id")
            for a, b, texts in text_slices(batch.column("text")):
                sizes = []
                for found in encoder.encode(texts):
                    writer = writer or SequenceWriter(uri, dtype, sequence, rows)
                    writer.add(found + end)
                    sizes.append(len(found) // width + 1)
                n = np.array(sizes, dtype=np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch([pa.array([part] * (b - a), pa.int32()), pa.array([uri] * (b - a)), ids[a:b], pa.array(local), pa.array(n)], names=["part", "file", "id", "local", "n_tokens"])
        if writer:
            writer.close()

    return frugal(run)


def write_token_files(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, sequence: int = SEQUENCE, rows: int = ROWS) -> DataFrame:
    """Write all rows' ids as files in the shared folder; returns where each row's ids are.

    (part, file, id, local, n_tokens, start): rows in ascending id order, equal ids
    by text, null ids first; ``local`` is the position in the file, ``start`` that among all ids, and
    n_tokens counts the end id that follows each text. A null text is an empty one and
    has just its end id. No rows make no files. A task that runs again writes a new
    file, and the index names only files of tasks that ended.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "tokens")
    dtype = id_type(tokenizer_file, end_id)
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    ordered = rows_in.repartitionByRange("id").sortWithinPartitions("id", "text")
    index = written(ordered.mapInArrow(_write(folder, tokenizer_file, dtype, end_id, sequence, rows), f"part int, file string, id {kind}, local long, n_tokens long"), "token-index")
    # One row a file: its ids' number, and so the position at which it begins.
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in totals])
    begin = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before)], "part int, begin long")
    return index.join(F.broadcast(begin), "part").select("part", "file", "id", "local", "n_tokens", (F.col("begin") + F.col("local")).alias("start"))


def _read_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, opened = None, None
    for batch in batches:
        out = []
        for file, local, n in zip(batch.column("file").to_pylist(), batch.column("local").to_pylist(), batch.column("n_tokens").to_pylist()):
            if file != name:
                name, opened = file, SequenceFile(file)
            out.append(zlib.crc32(opened.tokens(local, n).astype("<u4").tobytes()))
        yield pa.record_batch([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_checksums(index: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every indexed row, from its file's mapped bytes."""
    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(_read_crc, f"id {kind}, start long, n_tokens long, ids_crc32 long")
