import random

import pytest

from ledgerline.llm import decontaminate as dc
from ledgerline.llm.decontaminate import contamination
from tests.llm.brute import contamination as brute


def answer(df):
    import hashlib

    rows = df.collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows)


def expect(rows, items):
    return sorted((str(r[0]), *r[1:]) for r in brute(rows, items))


def table(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "x1", "日本"]
    say = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 5, 13, 14, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (None, "w1 w2")]
    items += [(93, items[3][1]), (3, items[3][1])]
    rows = [(i, say(r.randint(0, 300))) for i in range(40)]
    for i in range(40, 80):
        rows.append((i, say(r.randint(0, 60)) + " " + (r.choice(items[:25])[1]).upper() + " " + say(r.randint(0, 400))))
    rows += [(100, None), (101, ""), (102, "!!"), (None, items[4][1]), (40, "again"), (103, "w1 " * 5000)]
    return rows, items


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_against_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rows, items = table()
    out = contamination(docs([(i, t, "c") for i, t in rows], "doc_id long, text string, items string"), docs(items, "item_id long, text string"))
    assert answer(out) == expect(rows, items)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_blocks_that_do_not_stay_open(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    rows, items = table(3)
    files = dc.compiled(docs(items, "item_id long, text string"), "item_id", "text", 13)
    assert len(files) > 3
    monkeypatch.setattr(dc, "OPEN_BYTES", files[0][1] + 1)
    some = [(t or "").encode() for _, t in rows]
    blocks = dc.Blocks(files)
    assert len(blocks.open) == 1
    assert [(n, len(names)) for n, names, _ in dc.find(blocks, some)] == [(x[1], x[3]) for x in brute(rows, items)]


def test_windows_of_one_hash_and_of_many_items():
    # Equal windows of different items are one entry with both; a window that repeats in an item counts once.
    parts = dc.compile_patterns(["a", "b", "c"], [b"one two three one two three", b"zero one two three", b"x"], 3)
    assert b"".join(parts)
    import tempfile

    from ledgerline.llm.shared_files import write_bytes

    with tempfile.TemporaryDirectory() as folder:
        write_bytes(f"{folder}/p.bin", parts)
        block = dc.Block(f"{folder}/p.bin")
        got = dc.find([block], [b"One, two; THREE!", b"x", b"zero one two", b"two three one"])
    assert [(names, spans) for _, names, spans in got] == [(["a", "b"], [(0, 2)]), (["c"], [(0, 0)]), (["b"], [(0, 2)]), (["a"], [(0, 2)])]


def test_empty_tables(spark, docs):
    assert contamination(docs([]), docs([(1, "a b")], "item_id long, text string")).collect() == []
    rows = [(1, "a b c"), (2, None)]
    assert answer(contamination(docs(rows), docs([], "item_id long, text string"))) == expect(rows, [])
