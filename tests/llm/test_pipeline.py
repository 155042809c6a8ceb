import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ledgerline.llm import toxicity as tx
from tests.llm.brute import contamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(20)) for i in range(5)]
    line = say(12)
    rows, labels = [], []
    for i in range(300):
        text, toxic = say(r.randint(30, 80)), i % 5 == 0
        if toxic:
            text = " ".join(w if r.random() > 0.15 else "venom" for w in text.split())
        if i % 10 == 1:
            text += "\n" + line
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(400 + i, rows[2 + i][1] + " extra") for i in range(3)]
    rows += [(500, items[0][1]), (501, say(30) + " " + items[1][1]), (600, None), (601, ""), (None, say(30))]
    table = [(i, t, "en", f"s{n % 9}", len(t or "")) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(table, DOCS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {i: t for i, t in rows}, items, line


def test_stages(spark, corpus):
    sf, text, items, line = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, sf), "stage")
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
    left = seen["toxicity"]
    toxic = {i for i in range(300) if i % 5 == 0}
    assert len(toxic - left.keys()) > 45 and len(set(text) - left.keys() - toxic) < 6
    cut = seen["line dedup"]
    holders = [i for i in cut if i is not None and line in (cut[i]["text"] or "")]
    assert holders == [min(i for i in left if i is not None and line in (left[i]["text"] or ""))]
    assert cut.keys() == left.keys() and all(r["n_chars"] == len(r["text"] or "") for r in cut.values())
    near = seen["near duplicates"]
    gone = cut.keys() - near.keys()
    assert all(400 <= i < 403 for i in gone) and len(gone) == sum(2 + i in cut and 400 + i in cut for i in range(3))
    clean = seen["decontamination"]
    bad = {r[0] for r in contamination([(i, x["text"]) for i, x in near.items()], items) if r[-1]}
    assert near.keys() - clean.keys() == bad >= {500, 501}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in seen["bpe"].items():
        assert r["ids"] == library.encode(clean[i]["text"] or "", add_special_tokens=False).ids
    assert seen["bpe"].keys() == clean.keys()


def test_run_and_empty_corpus(spark, corpus, tmp_path_factory):
    sf, *_ = corpus
    assert cp.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]
    empty = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).collect() == []
    assert tx.EMPTY < 0


def test_near_copies_go_by_row(spark, docs):
    """An id of several texts doesn't tie their families together; of rows that repeat one stays."""
    r = random.Random(3)
    a, b = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "ab")
    rows = [(1, a, "n", 1), (5, a, "n", 2), (5, b, "n", 3), (9, b + " x", "n", 4), (9, b + " x", "m", 5), (20, "c d e f g h", "n", 6), (20, "c d e f g h", "n", 6), (20, "C d e f g h", "n", 7)]
    rows += [(None, a, "n", 8), (None, None, "n", 9), (30, None, "n", 10), (30, None, "n", 11), (31, "", "n", 12), (None, b, "n", 13)]
    df = docs(rows, "doc_id long, text string, n string, component long")
    out = cp.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    kept = [(x["doc_id"], x["text"].lower()) for x in out.collect() if x["doc_id"] is not None and x["text"] is not None]
    assert sorted(kept) == [(1, a), (5, b), (20, "c d e f g h"), (31, "")]
    assert sorted((x["component"] for x in out.collect() if x["component"] >= 8)) == [8, 9, 10, 11, 12, 13]
