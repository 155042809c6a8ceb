import hashlib
import random
import re

import numpy as np
import pytest

from ledgerline.llm import chunks, fill_in_middle as fim
from ledgerline.llm.fill_in_middle import fill_in_middle, restored


def brute(key, text, seed=7, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    r = random.Random(5)
    shared = "".join(f"shared passage {i} ünïcode 漢字\n" * (i % 3 + 1) for i in range(300))
    texts = [None, "", "\n", "\n\n\n", "no line end", "a\nb", "<P>", "x<M>\ny", "<", "<P\n>", "é" * 5000 + "\n" + "漢" * 9000, "a" * 20000, shared, shared + shared, "tail " + shared + "end"]
    texts += ["<" * 5000, "a" * 4095 + "<P>" + "b" * 100, "a" * 4094 + "<S>", "\n" * 9000]
    texts += ["".join(r.choice(["word ", "longer word ", "\n", "é", "<", "P>", "漢字 ", "\r\n"]) for _ in range(r.randrange(2000))) for _ in range(60)]
    return texts + [shared[i:] for i in range(0, 3000, 611)]


@pytest.mark.parametrize("percent, spm", [(100, 50), (40, 0), (100, 100)])
def test_against_brute_force(spark, docs, percent, spm):
    rows = [(i if i % 7 else None, t, "n", i) for i, t in enumerate(odd_texts())]
    rows += rows[5:9]
    df = docs(rows, "doc_id long, text string, n string, output int")
    out = fill_in_middle(df, percent=percent, spm=spm).withColumn("back", restored("output", "form"))
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) + (r["back"],) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(i, t, percent=percent, spm=spm), t or "") for i, t, *_ in rows), key=str)


def test_empty_table_and_texts_as_ids(spark, docs):
    assert fill_in_middle(docs([])).collect() == []
    out = fill_in_middle(docs([("k", "a\nb\nc")], "key string, body string"), "key", "body").collect()
    assert [tuple(out[0])[1:]] == [brute("k", "a\nb\nc")]
    with pytest.raises(ValueError):
        fill_in_middle(docs([]), markers=("<P>", "<P>", "<M>"))


def test_chunks_follow_content():
    texts = [t.encode() for t in odd_texts() if t]
    raw = b"".join(texts)
    offsets = np.cumsum([0, *map(len, texts)])
    ends = chunks.chunk_ends(np.frombuffer(raw, dtype=np.uint8), offsets)
    starts = np.concatenate([[0], ends[:-1]])
    assert set(offsets[1:]) <= set(ends.tolist()) and (ends - starts).max() <= chunks.LONGEST and (ends > starts).all()
    for a, b in zip(starts.tolist(), ends.tolist()):
        raw[a:b].decode()  # no character is split
    # A passage that stands elsewhere falls into the same chunks, but for its ends.
    r = random.Random(1)
    body = bytes(r.randrange(97, 123) for _ in range(60_000))

    def cut(text):
        ends = chunks.chunk_ends(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])).tolist()
        return {text[a:b] for a, b in zip([0, *ends], ends)}

    one, two = cut(body), cut(b"something before " * 7 + body)
    assert len(one & two) > 0.9 * len(one)


def test_cache_compares_content_and_stays_bounded():
    made = []

    def compute(chunk):
        made.append(chunk)
        return (chunk.decode(),)

    cache = chunks.ChunkCache(compute, lambda s: 100, most=10_000)
    for _ in range(3):
        for i in range(20):
            assert cache[b"chunk %d" % i] == (f"chunk {i}",)
    assert len(made) == 20
    for i in range(1000):
        assert cache[b"other chunk %d" % i] == (f"other chunk {i}",)
    assert len(cache.now) + len(cache.before) < 250
