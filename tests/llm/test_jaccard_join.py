import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import jaccard_join as jj
from ledgerline.llm import wordhash as wh
from ledgerline.llm.bitmaps import bitmap, bits_for, listed
from ledgerline.llm.graph import connected_components
from ledgerline.llm.jaccard_join import shingle_components
from tests.llm.brute import components


def answer(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None)


def expect(rows, **how):
    return sorted(x for x in components(rows, **how) if x[0] is not None)


def mixed(seed=5, n=120):
    """Groups of near copies with edits, exact copies, short texts and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = []
    for g in range(n // 6):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 90, 200]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            text = " ".join(copy) + (" " + passage if r.random() < 0.2 else "")
            rows.append((len(rows), text))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, docs):
    rows = mixed()
    assert answer(shingle_components(docs(rows))) == expect(rows)


def test_frequent_tokens_pair_up(spark, docs, monkeypatch):
    # Every token counts as frequent, so only pairs inside sub-classes can find the links.
    monkeypatch.setattr(jj, "_postings", lambda k, percent, tables, singles, least, f=jj._postings: f(k, percent, tables, -1, least))
    rows = mixed(seed=9)
    assert answer(shingle_components(docs(rows))) == expect(rows)


def test_large_groups_split_into_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_TOKENS", 500)
    rows = mixed(seed=11, n=60)
    assert answer(shingle_components(docs(rows))) == expect(rows)


def short_copies(n):
    """Sets of 13 tokens of which any two differ in one."""
    return [np.sort(np.append(np.arange(12, dtype=np.uint64), np.uint64(1000 + i))) for i in range(n)]


def unit_of(sets, vertex, block, keys=None):
    keys = keys or [np.array([5], dtype=np.uint64)] * len(sets)
    rows = {"u": [0] * len(sets), "v": [max(block)] * len(sets), "vertex": vertex, "block": block, "tokens": [s.tobytes() for s in sets], "keys": [k.tobytes() for k in keys]}
    batch = pa.record_batch([pa.array(x) for x in rows.values()], names=list(rows))
    return [r for b in jj._verify(85)[0](iter([batch])) for r in b.to_pylist()]


def test_many_short_copies_need_no_list_of_pairs():
    n = 2500
    tracemalloc.start()
    out = unit_of(short_copies(n), list(range(n, 0, -1)), [0] * n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r["a"], r["b"]) for r in out if not r["n_links"] and not r["compared"]} == {(1, x) for x in range(2, n + 1)}
    assert sorted(r["a"] for r in out if r["n_links"] == n - 1) == list(range(1, n + 1))
    assert sum(r["compared"] for r in out) == n * (n - 1) // 2
    assert peak < 150 << 20


def test_links_between_two_blocks_only():
    n = 30
    out = unit_of(short_copies(n), list(range(1, n + 1)), [int(x >= 20) for x in range(n)])
    assert {(r["a"], r["b"]) for r in out if not r["n_links"] and not r["compared"]} == {(1, x) for x in range(2, n + 1)}
    assert {r["a"]: r["n_links"] for r in out if r["n_links"]} == {x: 10 if x <= 20 else 20 for x in range(1, n + 1)}
    assert sum(r["compared"] for r in out) == 200


def test_only_pairs_with_a_key_in_common_are_compared():
    r = np.random.default_rng(6)
    n = 90
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(n)]
    keys = [np.unique(r.integers(0, 25, 2).astype(np.uint64)) for _ in range(n)]
    size = np.array([len(s) for s in sets])
    for left, right in ((np.arange(n), None), (np.arange(40), np.arange(40, n))):
        right = left if right is None else right
        want = {(i, j) for i in left for j in right if (i < j if left is right else True) and set(keys[i].tolist()) & set(keys[j].tolist()) and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])}
        got = [(i, j) for a, b in jj.candidates(keys, size, 80, left, right) for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
        a, b = np.array(got).T
        assert jj.shared_tokens(sets, a, b).tolist() == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in got]


def test_shared_signatures_over_batches():
    """Rows of keys with several nodes leave once, wherever batches end; lonely and repeated rows don't."""
    r = np.random.default_rng(2)
    rows = sorted({(int(k), int(n)) for k, n in zip(r.integers(0, 60, 150), r.integers(-4, 4, 150))}) + [(99, 1)]
    rows = sorted(rows + rows[::3])
    by = {}
    for k, n in rows:
        by.setdefault(k, set()).add(n)
    want = sorted((k, n, min(s)) for k, s in by.items() if len(s) > 1 for n in s)
    for size in (1, 2, 3, 7, 1000):
        batches = [pa.record_batch([pa.array([x[i] for x in rows[a : a + size]], pa.int64()) for i in (0, 1)], names=["key", "node"]) for a in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in jj._shared(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == want


def paragraphs(pool, name):
    return [" ".join(f"{name}{p}word{w}" for w in range(30)) for p in range(pool)]


def compared_of(spark, docs, rows):
    """Pairs that are compared, and the distinct pairs that share a signature."""
    kept = []
    whole = jj.written
    try:
        jj.written = lambda df, name: (out := whole(df, name), kept.append(out.toPandas()) if name == "shared" else None)[0]
        links = jj.link_sets(docs(rows), "doc_id", "text", 4, 85)
    finally:
        jj.written = whole
    nodes, of = np.unique(kept[0]["node"], return_inverse=True)
    both = np.zeros((len(nodes), len(nodes)), dtype=bool)
    for these in kept[0].assign(at=of).groupby("key")["at"]:
        at = these[1].to_numpy()
        both[np.ix_(at, at)] = True
    return links.found.agg({"compared": "sum"}).first()[0], (int(both.sum()) - len(nodes)) // 2


def test_stock_paragraphs_compare_what_shares_a_signature(spark, docs):
    r, stock = random.Random(4), paragraphs(60, "p")
    rows = [(i, "\n".join([stock[p] for p in r.sample(range(60), 6)] + [" ".join(f"own{i}x{w}" for w in range(8))])) for i in range(1500)]
    compared, sharing = compared_of(spark, docs, rows)
    assert compared <= sharing and compared < 0.3 * len(rows) ** 2 / 2


def test_chained_templates_compare_few_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 100)
    r, pools = random.Random(5), [paragraphs(12, f"g{g}p") for g in range(41)]
    rows = []
    for g in range(40):
        for i in range(30):
            own = [r.choice(pools[g]) for _ in range(3)] + [r.choice(pools[g + 1]) for _ in range(3)]
            rows.append((len(rows), "\n".join(own + [" ".join(f"own{g}x{i}x{w}" for w in range(8))])))
    compared, sharing = compared_of(spark, docs, rows)
    assert compared <= sharing and compared < 0.1 * len(rows) ** 2 / 2


def test_blocks_are_bounded_in_sets(spark, docs, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 10)
    counts = []
    monkeypatch.setattr(jj, "written", lambda df, name, f=jj.written: (counts.append(df.select("block").distinct().count()) if name == "blocks" else None, f(df, name))[1])
    notice = " ".join(f"word{i}" for i in range(15))
    rows = [(i, f"{notice} {i}") for i in range(60)] + [(100, "other words that are not near")]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in shingle_components(docs(rows)).collect()}
    assert counts == [6]
    assert got == {i: (0, 59) for i in range(60)} | {100: (100, 0)}


def test_edge_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "A b"), (5, "a B"), (6, "x y z w v u t"), (7, "x y z w v u t"), (7, "x y z w v u t"), (None, "a b"), (None, None), (8, "q " * 30000), (9, "q " * 20000)]
    out = shingle_components(docs([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, n long"))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 4, 6), (7, 4, 6), (8, 1, 8), (9, 1, 8), (None, 1, None), (None, 0, None)}
    assert out.count() == len(rows)


def test_empty_table(spark, docs):
    assert shingle_components(docs([])).collect() == []


def test_stage_parameters(spark, docs):
    rows = mixed(seed=2, n=48)
    from tests.llm import brute

    def five(text):
        return brute.shingle_set(text, 5)

    got = {r["doc_id"]: r["component_id"] for r in shingle_components(docs(rows), k=5, percent=80).collect()}
    sets = {i: five(t) for i, t in rows}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert got[i] == got[j]


@pytest.mark.parametrize("shares", [(0.9, 0.08, 0.02), (0.1, 0.1, 0.8), (0.0, 0.0, 1.0), (0.05, 0.3, 0.65)])
def test_signatures_cover_every_link(shares):
    r = np.random.default_rng(1)
    rank = lambda s: np.searchsorted(np.cumsum(shares), wh.mix(s).astype(np.float64) / 2**64, "right").clip(0, 2)
    schemes, linked = jj._schemes(85), 0
    for size in (6, 7, 20, 45, 50, 60, 300, 1500, 1700):
        for _ in range(6):
            base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            lost = max(0, int(0.07 * size))
            other = np.unique(np.concatenate([base[lost:], r.integers(0, 2**63, lost // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both >= 85 * (len(base) + len(other) - both):
                linked += 1
                keys = [set(jj._signatures_of(x, rank(x), 1, 85, schemes).tolist()) for x in (base, other)]
                assert keys[0] & keys[1]
    assert linked > 20


def test_rare_tokens_are_single_signatures(spark, docs):
    # Unrelated texts share nothing that is rare, so none of their tokens pair up; of a token in many sets nothing is single.
    r = random.Random(3)
    rows = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(80))) for i in range(60)]
    offers = [(t, 0) for t in range(1000)] + [(7, n) for n in range(9)] + [(8, 1), (8, 2)] + [(9, 0)] * 50
    table, singles = jj.token_classes(spark.createDataFrame(offers, "token long, node int"))
    got = jj.ranks(np.arange(1000), [table])
    assert singles == 1 and got.nonzero()[0].tolist() == [7, 8] and got[7] == 2 and got[8] == 1
    seen = []
    for text in [t for _, t in rows]:
        s = wh.shingles(wh.Words([text.encode()], wh.SPACED), 4)[0]
        keys = jj._signatures_of(s, np.zeros(len(s), dtype=np.int8), 1, 85, jj._schemes(85))
        seen.append(set(keys.tolist()) <= set(s.tolist()) and len(keys) == len(s) - jj.least_overlap(len(s), 85) + 1)
    assert all(seen)
    assert answer(shingle_components(docs(rows))) == expect(rows)


def test_bitmaps(spark):
    values = [3, -5, 1 << 60, 12345]
    flags = np.frombuffer(bitmap(spark.createDataFrame([(v,) for v in values], "h long"), "h", 12), dtype=np.uint8)
    assert len(flags) == 512 and listed(flags, np.array(values)).all() and not listed(flags, np.arange(100, 200)).any()
    assert not np.frombuffer(bitmap(spark.createDataFrame([], "h long"), "h", 10), dtype=np.uint8).any()
    assert bits_for(0) == 10 and bits_for(1 << 40) == 28


@pytest.mark.parametrize("edges", [[(3, 1), (1, 3), (5, 5), (2, 7), (7, 9)], [(i, i + 1) for i in range(40)], [(i + 1, i) for i in range(40, 0, -1)], []])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent}
