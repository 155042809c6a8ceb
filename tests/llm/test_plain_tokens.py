import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from ledgerline.llm import bpe_lexicon as bl
from ledgerline.llm import plain_tokens as pt
from ledgerline.llm.bpe_merge import PairMerger
from ledgerline.llm.pieces import LONGEST, PLAIN
from ledgerline.llm.shared_files import write_bytes
from ledgerline.llm.token_files import LibraryIds

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
APART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\s+")


def plain(n=600, seed=4):
    r = random.Random(seed)
    chars = list(" \n\n  '''stTrevm lld12²½éÈß«¿×ÿŸİȺ.,!?<|>")
    fixed = ["", " ", "it's", "they'LL we've'd", "''s 's's", "a  \n b \n\n", "'", "x'r", "'l"]
    return fixed + ["".join(r.choice(chars) for _ in range(r.randint(0, 30))) for _ in range(n)]


def flat(texts):
    return pt.bytes_of(pa.array(texts, pa.large_string()))


def test_tokens_are_the_patterns():
    texts = plain()
    data, ends = flat(texts)
    for spaced, pattern in ((True, SPACED), (False, APART)):
        starts, _ = pt.token_starts(data, ends, spaced)
        cuts = np.append(starts, len(data)).tolist()
        got = [bytes(data[a:b]).decode() for a, b in zip(cuts, cuts[1:])]
        want = [w for t in texts for w in pattern.findall(t)]
        if not spaced:
            got, want = ([w for w in found if not w.isspace()] for found in (got, want))
        assert got == want


def test_plain_means_the_same_in_both_dialects():
    chars = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    assert pt.plain_texts(pa.array(chars, pa.large_string()), []).tolist() == [bool(PLAIN.fullmatch(c)) for c in chars]


def test_plain_texts_are_encoded_as_arrays(monkeypatch):
    """No piece of them becomes a Python object; others among them have their ids in place."""

    def refuse(*_):
        raise AssertionError("pieces of plain texts")

    library = Tokenizer.from_file(BYTE)
    library.no_truncation()
    want = lambda texts: [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    texts = [*plain(), "ab" * 4000 + " " + "z" * 3000]
    mixed = ["日本 a", *texts[:20], "<|endoftext|>x", "a\tb", *texts[20:40], "é\xa0 's"]
    assert LibraryIds(BYTE, "<u2").encode(mixed) == want(mixed)
    monkeypatch.setattr(LibraryIds, "_compute", refuse)
    encoder = LibraryIds(BYTE, "<u2")
    assert encoder.encode(texts) == want(texts)
    assert encoder.encode(texts[::-1]) == want(texts[::-1])
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_table_is_bounded_and_exact():
    asked = []

    def compute(tokens):
        asked.append(len(tokens))
        return pa.array([t[::-1] for t in tokens.to_pylist()], pa.large_binary())

    table = pt.TokenTable(compute, most=4000)
    r = random.Random(2)
    for _ in range(200):
        words = {bytes(r.choices(b"abc", k=r.randint(1, 5))) for _ in range(30)} | {b"x" * (LONGEST + 1)}
        tokens = pa.array(sorted(words), pa.large_binary())
        assert table.values(tokens).to_pylist() == [t[::-1] for t in tokens.to_pylist()]
        assert table.tokens.nbytes + table.ids.nbytes < 4000 + 31 * 40
        assert b"x" * (LONGEST + 1) not in table.tokens.to_pylist()
    assert 200 < sum(asked) < 30 * 200


def test_pairs_are_found_by_hash():
    merger = PairMerger({"vocab": Tokenizer.from_file(BYTE).get_vocab(), "merges": _merges()})
    at = random.Random(1).sample(range(len(merger.pairs)), 2000)
    rank, made = merger._lookup(merger.pairs[at])
    assert rank.tolist() == merger.ranks[at].tolist() and made.tolist() == merger.made[at].tolist()
    other = np.setdiff1d(merger.pairs[at] + 1, merger.pairs)
    assert (merger._lookup(other)[0] == np.iinfo(np.int32).max).all()


def _merges():
    import json

    with open(BYTE, encoding="utf-8") as f:
        return json.load(f)["model"]["merges"]


def test_small_letters_in_place():
    chars = [chr(i) for i in range(0x250) if PLAIN.fullmatch(chr(i))]
    texts = pa.array(chars, pa.large_string())
    small = pt.plain_texts(texts, [], small=True)
    assert [c for c, ok in zip(chars, small) if not ok] == [c for c in chars if len(c.lower().encode()) != len(c.encode())]
    data, _ = pt.bytes_of(texts.filter(pa.array(small)))
    assert bytes(pt.lowered(data)).decode() == "".join([c.lower() for c, ok in zip(chars, small) if ok])


def _encoded(texts, path):
    """Ids and decoded texts of one task, under a lexicon of a few words."""
    words = sorted([b"it", b"stt", "é".encode(), b"ll", b"xx"])
    write_bytes(path, bl.compile_lexicon(words, bl.WordBpe(WORD).merge(words)))
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    return [(r["ids"], r["decoded"]) for out in bl._encode(WORD, path, True)(iter([batch])) for r in out.to_pylist()]


def _want(texts):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    found = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(ids, library.decode(ids, skip_special_tokens=False)) for ids in found]


def test_plain_words_are_encoded_as_arrays(tmp_path, monkeypatch):
    """Words of plain texts are never Python objects; other texts among them have their ids in place."""

    def refuse(*_):
        raise AssertionError("words of plain texts")

    texts = [None, *[t for t in plain(seed=9) if not set(t) & set("İȺ")], "Ab" * 3000 + " It ÉÈ'S"]
    mixed = ["日本 a", *texts[:20], "<|endoftext|>X", "A\tB", "İstanbul Ⱥ", *texts[20:40], "é\xa0 'S", "e\u0301"]
    assert _encoded(mixed, str(tmp_path / "a.bin")) == _want(mixed)
    monkeypatch.setattr(bl.WordBpe, "words", refuse)
    assert _encoded(texts, str(tmp_path / "b.bin")) == _want(texts)


def test_plain_words_are_counted_as_arrays(monkeypatch):
    texts = [*plain(seed=11), "日本 日本 a", "<|endoftext|>X it", None, "y" * (LONGEST + 1) + " short"]
    bpe, want = bl.WordBpe(WORD), Counter()
    for t in texts:
        for p in bl._pieces(t or ""):
            want.update(w for w in bpe.words(p) if isinstance(w, bytes) and len(w) <= LONGEST)
    batches = [pa.record_batch([pa.array(texts[i : i + 50], pa.string())], names=["text"]) for i in range(0, len(texts), 50)]
    for most in (bl.COUNTED_PIECES, 30):
        monkeypatch.setattr(bl, "COUNTED_PIECES", most)
        got = Counter()
        for out in bl._word_counts(WORD)(iter(batches)):
            assert out.schema.field("word").type == pa.binary()
            for r in out.to_pylist():
                got[r["word"]] += r["n"]
        assert got == want
