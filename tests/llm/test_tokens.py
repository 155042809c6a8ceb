import hashlib
import random
import struct
import time
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe_merge
from ledgerline.llm import pieces as pc
from ledgerline.llm.bpe_lexicon import Lexicon, WordBpe, compile_lexicon, decode, encode
from ledgerline.llm.length_histogram import at_limits, encoded_lengths, length_histogram, length_quantiles, suffix_sums
from ledgerline.llm.shared_files import write_bytes
from ledgerline.llm.token_files import LibraryIds, SequenceFile, read_checksums, write_token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_texts(n=400, seed=3):
    r = random.Random(seed)
    chars = list(" \n\t'ab1é,. \x1c日😀Σsİ ́")
    fixed = ["", "  a  b", " a", "a ", "\n\n a", "it's they'LL  x", "<|endoftext|>a <|startoftext|>b", "aaaaaaaaaaa aaaa", "Σ ΑΣ", "\x85 a", "word " * 3000]
    return fixed + ["".join(r.choice(chars) for _ in range(r.randint(0, 40))) for _ in range(n)]


def rows():
    out = [(i, t) for i, t in enumerate(odd_texts())]
    return [*out, (5000, None), (7, "again"), (8, out[8][1])]


def test_encode_equals_the_library(spark, docs):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in encode(docs(rows()), WORD, n_words=50).collect()), key=str)
    want = []
    for i, t in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_decode_column(spark, docs):
    encoded = encode(docs(rows()), WORD, n_words=50)
    again = decode(encoded.drop("decoded"), WORD)
    assert sorted(map(str, again.select("doc_id", "decoded").collect())) == sorted(map(str, encoded.select("doc_id", "decoded").collect()))
    assert decode(spark.createDataFrame([(1, None)], "a long, ids array<int>"), WORD).first()["decoded"] is None


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    bpe = WordBpe(WORD)
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in "stuvw"} | {b"a", b"ab", "é".encode()})
    ids = bpe.merge(words)
    write_bytes(str(tmp_path / "x" / "lexicon.bin"), compile_lexicon(words, ids))
    lexicon = Lexicon(str(tmp_path / "x" / "lexicon.bin"))
    assert lexicon.numbers(words).tolist() == list(range(len(words)))
    assert [lexicon.ids_of(i).tolist() for i in range(len(words))] == [x.tolist() for x in ids]
    assert lexicon.numbers([b"", b"abc", b"asin", b"zzz"]).tolist() == [-1] * 4
    assert len(lexicon.final) < 25


def test_merge_equals_the_library():
    bpe, r = WordBpe(WORD), random.Random(1)
    words = ["".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 25))) for _ in range(3000)]
    library = Tokenizer.from_file(WORD)
    assert [x.tolist() for x in bpe.merge([w.encode() for w in words])] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_token_files_round_trip(spark, docs):
    library = Tokenizer.from_file(BYTE)
    library.no_truncation()
    index = write_token_files(docs([(i, t, "x") for i, t in rows()], "doc_id long, text string, file string"), BYTE, sequence=16, rows=4)
    got = [(r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_checksums(index).collect()]
    start, want = 0, []
    for i, t in sorted(rows(), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(got) == sorted(want)


def test_sequences_are_views_with_masks(spark, docs):
    index = write_token_files(docs([(1, "a b c d e f g h"), (2, "x")]).coalesce(1), BYTE, sequence=4, rows=2)
    total = index.agg({"n_tokens": "sum"}).first()[0]
    files = [r["file"] for r in index.select("file").distinct().collect()]
    real = 0
    for f in files:
        opened = SequenceFile(f)
        n = sum(opened.reader.get_batch(i).num_rows for i in range(opened.reader.num_record_batches))
        for i in range(n):
            ids, mask = opened.row(i)
            assert len(ids) == len(mask) == 4 and not ids.flags.owndata
            real += int(mask.sum())
    assert real == total


def test_token_files_of_no_rows(spark, docs):
    assert read_checksums(write_token_files(docs([]), BYTE)).collect() == []


def test_piece_cache_forgets_and_recalls():
    cache = pc.PieceCache(lambda new: [len(x) for x in new], most=3 * pc.ENTRY, sized=False)
    for texts in ([["a", "bb"]], [["ccc", "a"]], [["dddd", "eeeee"]], [["a", "ccc"]]):
        assert cache.values(texts) == [[len(x) for x in t] for t in texts]


@pytest.fixture
def lengths(spark, docs):
    return encoded_lengths(docs(rows()), RANKS, public_tokenizers.PATTERN)


def test_length_histogram(spark, lengths):
    n = sorted(r["length"] for r in lengths.collect())
    sums = suffix_sums(length_histogram(lengths))
    for r in sums.collect():
        limit = r["length"]
        assert r["n_docs"] == n.count(limit)
        assert r["docs_over"] == sum(x > limit for x in n)
        assert r["tokens_over"] == sum(x for x in n if x > limit)
        assert r["truncated_total"] == sum(min(x, limit) for x in n)
        assert r["docs_upto"] + r["docs_over"] == len(n)
    for r in at_limits(sums, [0, 3, 77, 10**7]).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in n)
        assert r["docs_over"] == sum(x > r["context_limit"] for x in n)
    for r in length_quantiles(sums, [0.01, 0.5, 0.95, 1.0]).collect():
        assert r["length"] == next(x for x in n if sum(y <= x for y in n) >= r["quantile"] * len(n))


def test_lengths_equal_the_encoder(spark, lengths):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(encoding.encode_ordinary(t or ""))) for i, t in rows())
    assert sorted((r["id"], r["length"]) for r in lengths.collect()) == want


def test_empty_histogram(spark, docs):
    assert suffix_sums(length_histogram(spark.createDataFrame([], "length long"))).collect() == []


def test_digest_of_ids(spark):
    from ledgerline.llm.queries import op1_bpe_lexicon

    library = Tokenizer.from_file(WORD)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op1_bpe_lexicon(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_empty_tables_null_ids_and_clashing_names(spark, docs):
    kind = "doc_id long, text string, ids string, decoded string, length int, id long"
    some = docs([(1, "a bc", "x", "y", 3, 9), (None, "a bc", "x", "y", 3, 9), (None, None, None, None, None, None)], kind)
    library = Tokenizer.from_file(WORD)
    ids = library.encode("a bc", add_special_tokens=False).ids
    assert sorted(((r["doc_id"], r["ids"]) for r in encode(some, WORD).collect()), key=str) == sorted([(1, ids), (None, ids), (None, [])], key=str)
    assert encode(docs([], kind), WORD).collect() == []
    lengths = encoded_lengths(some, RANKS, public_tokenizers.PATTERN)
    assert sorted((r["n_docs"], r["length"]) for r in length_histogram(lengths).collect())[0] == (1, 0)
    assert suffix_sums(length_histogram(encoded_lengths(docs([], kind), RANKS, public_tokenizers.PATTERN))).collect() == []


def test_workers_keep_one_operators_tables(spark):
    from ledgerline.llm import workers

    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [workers.kept("a", make(1)), workers.kept("a", make(2)), workers.kept("b", make(3)), workers.kept("a", make(4))] == [1, 1, 3, 4]
    assert made == [1, 3, 4] and list(workers._KEPT) == ["a"]


def unspaced(n, length, seed=1):
    """Texts without spaces, of a script that has none."""
    r = random.Random(seed)
    return ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(length)) for _ in range(n)]


def test_texts_without_spaces_equal_the_libraries(spark, docs):
    texts = unspaced(6, 700) + ["文" * 400 + "\n" + "字母abc" * 200, "ไทยไม่มีช่องว่าง" * 60, "x" * 5000, "ab" * 3000 + "é" * 2000]
    df = docs(list(enumerate(texts)))
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    assert {r["doc_id"]: r["ids"] for r in encode(df, WORD, n_words=20).collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    bytes_library = Tokenizer.from_file(BYTE)
    bytes_library.no_truncation()
    got = {r["id"]: (r["n_tokens"], r["ids_crc32"]) for r in read_checksums(write_token_files(df, BYTE)).collect()}
    for i, t in enumerate(texts):
        ids = [*bytes_library.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))


def test_caches_are_bounded_in_bytes():
    cache = pc.PieceCache(lambda new: [x.encode() for x in new], most=1 << 20)
    for i in range(300):
        texts = [[f"piece {i} {j}" for j in range(50)], unspaced(2, 3000, i), ["漢" * 200 + str(i)]]
        assert cache.values(texts) == [[x.encode() for x in t] for t in texts]
        held = sum(len(k.encode()) + len(v) + pc.ENTRY for g in (cache.now, cache.before) for k, v in g.items())
        assert held < 3 << 20 and max(map(len, cache.now)) <= pc.LONGEST


def test_long_words_merge_as_short_ones_do(monkeypatch):
    merger = LibraryIds(BYTE, "<u2").merger
    r = random.Random(8)
    words = [bytes(r.choice(b"abetinghors") for _ in range(r.randrange(1, 90))) for _ in range(300)] + [b"a" * n for n in range(1, 40)] + ["é漢字".encode() * 9]
    short = merger.merge_bytes(words, "<i4")
    monkeypatch.setattr(bpe_merge, "LONG", 1)
    assert merger.merge_bytes(words, "<i4") == short
    monkeypatch.undo()
    one = bytes(r.choice(b"abetinghors") for _ in range(300_000))
    began = time.monotonic()
    merger.merge_bytes([one], "<i4")
    assert time.monotonic() - began < 20
