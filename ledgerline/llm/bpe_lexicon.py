"""Word-level BPE over a minimal acyclic transducer of frequent words.

The corpus's most frequent words are compiled, sorted, into an automaton in which equal
suffixes are one path. Arcs carry outputs whose sum along a word is the word's number;
the number points at its token ids. The automaton is one file of flat arrays, which
tasks map into memory and walk for all distinct words of a batch at once. A word that
it doesn't hold is merged exactly, by merge rank, again for all such words at once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe_merge import PairMerger, byte_chars
from ledgerline.llm.pieces import LONGEST, PLAIN, PieceCache
from ledgerline.llm.plain_tokens import TokenTable, binary_of, bytes_of, distinct_tokens, encoded, in_two_ways, lowered, plain_texts, text_slices, token_starts
from ledgerline.llm.shared_files import packed, unpacked, write_bytes
from ledgerline.llm.storage import discard, new_path, small_batches, written
from ledgerline.llm.workers import frugal, kept

#: Frequent words that are compiled.
LEXICON_WORDS = 1 << 16
#: Bytes of one generation of a worker's cache of pieces.
CACHED = 20 << 20
#: The split that plain_tokens knows; files with another one go by pieces.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBpe:
    """A word-level BPE vocabulary file: word splitting, merging and decoding."""

    def __init__(self, path: str):
        self.path = path
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merger = PairMerger(spec["model"], spec["model"]["end_of_word_suffix"] or "")
        self.merge, self.merge_bytes, self.merge_array = merger.merge, merger.merge_bytes, merger.merge_array
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.byte_of = {c: b for b, c in enumerate(byte_chars())}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split, regex.V0)
        self.known_split = split == _KNOWN_SPLIT

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts are cut into words as arrays."""
        return plain_texts(texts, list(self.special), small=True) & self.known_split

    def words(self, piece: str) -> list[bytes | int]:
        """A piece's words as UTF-8 bytes, and ids of special tokens inside it."""
        if self.cut_special and "<" in piece and self.cut_special.search(piece):
            out: list[bytes | int] = []
            for part in self.cut_special.split(piece):
                out.extend([self.special[part]] if part in self.special else self.words(part))
            return out
        if PLAIN.fullmatch(piece):
            if not piece.isascii():
                piece = "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])
            return [w.encode() for w in self.split.findall(piece.lower() if piece.isascii() else piece)]
        normal = self.library.normalizer.normalize_str(piece)
        return [bytes([self.byte_of[c] for c in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def decode(self, ids) -> str:
        """The tokens, one space between, as the file's missing decoder says."""
        return " ".join([self.tokens[i] for i in ids])


def compile_lexicon(words: list[bytes], ids: list[np.ndarray]) -> list[bytes]:
    """File parts of the minimal acyclic transducer of sorted distinct words and their ids."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple[tuple[int, int], ...]] = []
    final: list[bool] = []
    count: list[int] = []  # words below each state

    def settle(edges: list[tuple[int, int]], accepts: bool) -> int:
        key = (tuple(edges), accepts)
        found = register.get(key)
        if found is None:
            found = register[key] = len(arcs_of)
            arcs_of.append(key[0])
            final.append(accepts)
            count.append(accepts + sum(count[t] for _, t in edges))
        return found

    # The path of the last word, as (edges so far, accepts, label that leads on).
    path: list[list] = [[[], False, -1]]
    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        while len(path) > common + 1:
            edges, accepts, _ = path.pop()
            path[-1][0].append((path[-1][2], settle(edges, accepts)))
        for label in word[common:]:
            path[-1][2] = label
            path.append([[], False, -1])
        path[-1][1] = True
        previous = word
    while len(path) > 1:
        edges, accepts, _ = path.pop()
        path[-1][0].append((path[-1][2], settle(edges, accepts)))
    root = settle(path[0][0], path[0][1])
    key, target, output = [], [], []
    for state, edges in enumerate(arcs_of):
        before = int(final[state])
        for label, to in edges:
            key.append(state * 256 + label)
            target.append(to)
            output.append(before)
            before += count[to]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8")
    arrays = {
        "key": np.array(key, dtype="<i8"),
        "offsets": offsets,
        "target": np.array(target, dtype="<i4"),
        "output": np.array(output, dtype="<i4"),
        "ids": (np.concatenate(ids) if ids else np.zeros(0)).astype("<i4"),
        "final": np.array(final, dtype="u1"),
    }
    return packed({"root": root}, arrays)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, uri: str):
        head, arrays = unpacked(uri)
        self.root = head["root"]
        vars(self).update(arrays)
        self.words_ids = binary_of(self.ids.view(np.uint8), self.offsets * 4)

    def numbers(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Each word's number, -1 for one that isn't held; all words walk together."""
        n = len(words)
        if not n or not len(self.key):
            return np.full(n, -1, dtype=np.int64)
        data, at = bytes_of(words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary()))
        start, size = at[:-1], np.diff(at)
        state = np.full(n, self.root, dtype=np.int64)
        number = np.zeros(n, dtype=np.int64)
        live = np.flatnonzero(size > 0)
        alive = size >= 0
        step = 0
        while len(live):
            key = state[live] * 256 + data[start[live] + step]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[place] == key
            alive[live[~ok]] = False
            live, place = live[ok], place[ok]
            state[live] = self.target[place]
            number[live] += self.output[place]
            step += 1
            live = live[size[live] > step]
        return np.where(alive & (self.final[state] > 0), number, -1)

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def _pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Encoder:
    """What a worker keeps: a vocabulary, and the words and pieces that it has met under one lexicon."""

    def __init__(self, tokenizer_file: str):
        self.bpe = WordBpe(tokenizer_file)
        self.names = pa.array(self.bpe.tokens, pa.string())
        self.uri, self.lexicon, self.table, self.cache = "", None, None, None

    def under(self, uri: str) -> Encoder:
        """This encoder with a lexicon; a new one drops what was met under the earlier one."""
        if uri != self.uri:
            self.lexicon, self.uri = Lexicon(uri), uri
            self.table, self.cache = TokenTable(self._word_ids), PieceCache(self._ids, CACHED)
        return self

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids: words of plain texts are told apart as arrays, other texts are cut into pieces."""

        def by_arrays(plain: pa.Array) -> list[bytes]:
            data, ends = bytes_of(plain)
            return encoded(self.table, lowered(data), ends, spaced=False)

        def by_pieces(others: list[str]) -> list[bytes]:
            return [b"".join(v) for v in self.cache.values([_pieces(t) for t in others])]

        return in_two_ways(texts, self.bpe.plain(texts), by_arrays, by_pieces)

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of words as an array; white space has none."""
        number = self.lexicon.numbers(words)
        data, at = bytes_of(words)
        number[np.isin(data[at[:-1]], np.frombuffer(b" \n", dtype=np.uint8))] = -2
        held, rest = np.flatnonzero(number >= 0), np.flatnonzero(number == -1)
        parts = [self.lexicon.words_ids.take(pa.array(number[held])), self.bpe.merge_array(words.take(pa.array(rest)), "<i4"), pa.array([b""], pa.large_binary())]
        place = np.full(len(words), len(held) + len(rest))
        place[held], place[rest] = np.arange(len(held)), len(held) + np.arange(len(rest))
        return pa.concat_arrays(parts).take(pa.array(place))

    def decoded(self, ids: np.ndarray, offsets: pa.Array) -> pa.Array:
        """The texts of lists of ids, one space between tokens."""
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(ids))), " ")

    def _ids(self, pieces: list[str]) -> list[bytes]:
        split = [self.bpe.words(p) for p in pieces]
        words = list({w for ws in split for w in ws if isinstance(w, bytes)})
        number = self.lexicon.numbers(words).tolist()
        value = {w: self.lexicon.ids_of(n).tobytes() for w, n in zip(words, number) if n >= 0}
        rest = [w for w, n in zip(words, number) if n < 0]
        value.update(zip(rest, self.bpe.merge_bytes(rest, "<i4")))
        return [b"".join([value[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in ws]) for ws in split]


def _encoder(tokenizer_file: str) -> Encoder:
    return kept(("words", tokenizer_file), lambda: Encoder(tokenizer_file))


#: Distinct pieces or words that a task counts before it tells the words.
COUNTED_PIECES = 200_000


def _plain_word_counts(texts: pa.Array) -> pa.Table:
    """Numbers of plain texts' words; long words are left out, as they are always merged where they are met."""
    data, ends = bytes_of(texts)
    data = lowered(data)
    codes, words = distinct_tokens(data, token_starts(data, ends, spaced=False)[0])
    first = pc.binary_slice(words, 0, 1)
    count = pa.table({"word": words, "n": np.bincount(codes, minlength=len(words))})
    return count.filter(pc.and_(pc.invert(pc.is_in(first, pa.array([b" ", b"\n"], first.type))), pc.less_equal(pc.binary_length(words), LONGEST)))


def _word_counts(tokenizer_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer_file).bpe
        pieces: Counter = Counter()
        words: Counter = Counter()
        tables: list[pa.Table] = []

        def flush() -> pa.RecordBatch:
            for piece, n in pieces.items():
                for w in bpe.words(piece):
                    if isinstance(w, bytes):
                        words[w] += n
            out = pa.record_batch([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            pieces.clear()
            words.clear()
            return out

        def summed() -> pa.Table:
            found = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": found["word"], "n": found["n_sum"]})

        def out_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.set_column(0, "word", table["word"].cast(pa.binary())).to_batches()

        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                plain = bpe.plain(texts)
                if plain.any():
                    tables.append(_plain_word_counts(texts.filter(pa.array(plain))))
                    if sum(map(len, tables)) > 4 * COUNTED_PIECES:
                        tables[:] = [summed()]
                        if len(tables[0]) > COUNTED_PIECES:
                            yield from out_of(tables.pop())
                for text in texts.filter(pa.array(~plain)).to_pylist():
                    found = _pieces(text)
                    if len(text) > LONGEST and max(map(len, found)) > LONGEST:
                        # Of long pieces, as scripts without spaces make them, the short words count at once.
                        words.update(w for p in found if len(p) > LONGEST for w in bpe.words(p) if isinstance(w, bytes) and len(w) <= LONGEST)
                        found = [p for p in found if len(p) <= LONGEST]
                    pieces.update(found)
                    if len(pieces) + len(words) > COUNTED_PIECES:
                        yield flush()
        if tables:
            yield from out_of(summed())
        yield flush()

    return frugal(run)


def frequent_words(docs: DataFrame, text_col: str, tokenizer_file: str, n_words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, sorted: all of the least count that leaves at most ``n_words``."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_word_counts(tokenizer_file), "word binary, n long")
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    # How many words have each count; counts are grouped by leading digits, so there are few rows.
    step = F.pow(F.lit(10), F.greatest(F.lit(0), F.length(F.col("n").cast("string")) - 3)).cast("long")
    level = F.floor(F.col("n") / step).cast("long") * step
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, words in levels:
        total += words
        if total > n_words:
            break
        least = at
    found = [] if least is None else counts.where(F.col("n") >= least).select("word").collect()
    discard(counts)
    return sorted(bytes(r["word"]) for r in found)


def _encode(tokenizer_file: str, lexicon_uri: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file).under(lexicon_uri)
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                ids = encoder.encode(texts)
                size = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                columns = [batch.column("id")[a:b], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
                if with_text:
                    columns.append(encoder.decoded(flat, offsets))
                yield pa.record_batch(columns, names=["id", "ids", "decoded"][: len(columns)])

    return frugal(run)


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", n_words: int = LEXICON_WORDS, with_text: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded): every row's token ids and, if asked for, the ids' decoded text.

    Ids equal those of the tokenizers library for the same file without special tokens added;
    special tokens that a text spells out are recognised as it does. A null text
    is an empty one: no ids, empty decoded text. Rows may repeat and ids may be null. The
    lexicon holds the most frequent words of all of ``docs``, ``n_words`` at most, and its file is
    in the session's shared folder. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = frequent_words(docs, text_col, tokenizer_file, n_words)
    uri = new_path(spark, "lexicon") + "/lexicon.bin"
    write_bytes(uri, compile_lexicon(words, WordBpe(tokenizer_file).merge(words)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, ids array<int>" + ", decoded string" * with_text
    out = rows.mapInArrow(_encode(tokenizer_file, uri, with_text), schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text. A column ``to`` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer_file).bpe
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(ids_col).to_pylist()]
            keep = [f.name for f in batch.schema if f.name != to]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, to])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([f for f in encoded.schema.fields if f.name != to] + [StructField(to, StringType())])
    return encoded.mapInArrow(frugal(run), schema)
