from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pareto_mix as pm
from ledgerline.llm.pareto_mix import ordered_sample, pareto_mix, source_targets, word_count


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """The excess of capped sources is shared again until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, set(names)
    while True:
        rest = share * sum(sizes.values()) - sum(capped.values())
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > most * sizes[s]} if total else set()
        if not over:
            return capped | {s: rest * weight[s] / total for s in left}
        capped |= {s: most * sizes[s] for s in over}
        left -= over


def test_words(spark, docs):
    texts = [None, "", " ", "a", " a b\t\nc ", "x\x0by\x0cz\r", "nbsp joins", "\n" * 50_000 + "w" + " " * 50_000, "漢字 é", "a\x1fb"]
    rows = docs([(i, t) for i, t in enumerate(texts)]).withColumn("n", word_count(F.col("text"))).orderBy("doc_id").collect()
    assert [r["n"] for r in rows] == [0, 0, 0, 1, 3, 3, 1, 1, 2, 1]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70, "é": 300, "B": 41}, {"only": 9}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 1000}, {str(i): i * i for i in range(40)}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def first_fit(docs, rest):
    """Ranks taken of (rank, size), in order, each that fits; documents of one rank go together."""
    groups = defaultdict(int)
    for rank, size in docs:
        groups[rank] += size
    taken = set()
    for rank in sorted(groups):
        if groups[rank] <= rest:
            rest -= groups[rank]
            taken.add(rank)
    return taken


@pytest.mark.parametrize("rows", [4096, 30])
def test_order_sample_against_sorting(spark, monkeypatch, rows):
    monkeypatch.setattr(pm, "RANGE", rows)
    draws = [(s, (i * 2654435761 + ord(s) * 97) % (1 << 50) if i % 50 else 7 << 40, 1 + (i * i) % 400) for s in "ab" for i in range(1, 2000)] + [("c", 5, 10)] * 40
    ranked = spark.createDataFrame(draws, "source string, rank long, size long")
    wanted = [("a", 100_000, 1999), ("b", 0, 1999), ("c", 400, 40)]
    ends = {r["source"]: r for r in ordered_sample(ranked, spark.createDataFrame(wanted, "source string, rest long, n long")).collect()}
    for s, rest, n in wanted:
        own = [(k, z) for x, k, z in draws if x == s]
        got = {k for k, _ in own if s in ends and (k < ends[s]["low"] or k in ends[s]["ranks"])}
        if rows >= n:
            assert got == first_fit(own, rest)
        words = sum(z for k, z in own if k in got)
        # In order up to the cut's range, which is left with less than fits.
        assert words <= rest and (not rest or rest - words <= max(z for _, z in own))
        if rest:
            assert {k for k, _ in own if k < ends[s]["low"]} <= got


def sized(n, source, i=0):
    return " ".join(["w"] * n) + f" {source}{i}"


def test_mix_meets_its_targets(spark, docs):
    rows = [(i, sized(3 + i % 40, "x", i), ["hot", "hot", "b", "c", None, "é"][i % 6], "row") for i in range(1200)]
    rows += [(2000, None, "b", "row"), (2001, "", "empty only", "row"), (2002, " \n ", "b", "row"), (None, "no id here", "b", "row"), (5, rows[5][1], "é", "row"), (5, rows[5][1], "é", "row")]
    df = docs(rows, "doc_id long, text string, source string, size string")
    out = [r.asDict() for r in pareto_mix(df).select("row.doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()]
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    want = plain_targets(sizes)
    for s, x in by.items():
        assert {r["source_size"] for r in x} == {sizes[s]} and all(abs(r["target"] - want[s]) < 1e-6 for r in x)
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(3, 0.01 * want[s])
    twice = [r for r in out if r["doc_id"] == 5 and r["source"] == "é"]
    assert len({r["copies"] for r in twice}) == 1
    again = pareto_mix(df.repartition(5)).select("row.doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert sorted(map(str, (r.asDict() for r in again))) == sorted(map(str, out))
    assert pareto_mix(docs([], "doc_id long, text string, source string")).collect() == []


def test_likelier_documents_are_taken_as_often_as_their_weights_say(spark, docs):
    """Inclusion follows the weights: over many seeds, a document is taken about as often as its expected copies."""
    rows = [(i, sized(9, "d", i), "s", [1.0, 2.0, 4.0, 0.0, None][i % 5]) for i in range(500)]
    df = docs(rows, "doc_id long, text string, source string, w double").cache()
    kept, seeds = defaultdict(int), range(6)
    for seed in seeds:
        for r in pareto_mix(df, weight_col="w", share=0.3, keep=("doc_id", "w"), seed=seed).where("copies > 0").select("row.w", "copies").collect():
            kept[r["w"]] += r["copies"]
    each = {w: kept[w] / (100 * len(seeds)) for w in (1.0, 2.0, 4.0)}
    # 0.3 of 500 documents by weights 1, 2, 4: 21, 43 and 86 of 100.
    for w, want in {1.0: 3 / 14, 2.0: 3 / 7, 4.0: 6 / 7}.items():
        assert abs(each[w] - want) < 0.06
    assert not kept[0.0] and not kept[None]


def test_weights_beyond_the_most_copies(spark, docs):
    """A heavy document stops at two copies and the others make up for it."""
    rows = [(i, sized(9, "d", i), "s", 100.0 if i < 10 else 1.0) for i in range(200)]
    out = pareto_mix(docs(rows, "doc_id long, text string, source string, w double"), weight_col="w", share=1.0, keep=("doc_id", "w")).select("row.w", "copies", "size").collect()
    assert all(r["copies"] == 2 for r in out if r["w"] == 100) and abs(sum(r["copies"] for r in out) - 200) <= 1
