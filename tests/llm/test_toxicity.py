import random
import zlib

import numpy as np

from ledgerline.llm import toxicity as tx

BAD = ["venom", "spite", "scorn"]


def sample(n=400, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(text) // 12):
                text[r.randrange(len(text))] = r.choice(BAD)
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_gradient_matches_differences():
    net = tx.Network(3)
    net.p = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in net.p.items()}
    words = tx.wh.Words([b"one two three four five six seven eight"], tx._TOKEN)
    distinct, inverse = tx.distinct_words(words)
    _, start, end = tx.windows(words.first)
    index, mask = tx._grid(inverse, start, end)
    label, shown = np.ones(len(start)), np.ones(len(distinct.hashes))

    def loss():
        p = tx._sigmoid(net.forward(net.gates(net.inputs(distinct).astype(np.float64)), index, mask))
        return -np.log(p).mean()

    before = {k: v.copy() for k, v in net.p.items()}
    net.step(distinct, index, mask, label, 0.0, shown)
    net.p = before
    for name, at in [("w", (3,)), ("uf", (2, 5)), ("ub", (1, 25)), ("xf", (4, 12)), ("av", (7, 2)), ("a", (1,)), ("cb", (8,)), ("gram", (int(distinct.grams[0]), 1))]:
        gradient = net.m[name][at] / 0.1
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - gradient) < 2e-3 * max(1, abs(gradient)), name


def plain_window(net, texts):
    """Logit of a window of words, told word by word."""
    p, sig = net.p, lambda x: 1 / (1 + np.exp(-x))
    words = tx.wh.Words([" ".join(texts).encode()], tx._TOKEN)
    vectors = []
    for i, h in enumerate(words.hashes()):
        body = b"^" + words.data[words.starts[i] : words.ends[i]].tobytes() + b"^"
        grams = []
        for n in tx.GRAMS:
            for a in range(len(body) - n + 1):
                total = (n + sum(int(c) * int(s) for c, s in zip(body[a : a + n], tx._SPREAD))) % 2**64
                grams.append(int(tx.wh.mix(np.array([total], dtype=np.uint64))[0]) % tx.GRAM_BUCKETS)
        known = np.flatnonzero(p["known"] == h)
        vectors.append(np.concatenate([p["word"][known[0] if len(known) else -1], p["gram"][grams].mean(axis=0)]))
    states = {}
    for d in "fb":
        h, seen = np.zeros(tx.HIDDEN), []
        for x in vectors if d == "f" else vectors[::-1]:
            g, u = x @ p[f"x{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            (gz, gr, gc), (uz, ur, uc) = np.split(g, 3), np.split(u, 3)
            z, r = sig(gz + uz), sig(gr + ur)
            h = z * h + (1 - z) * np.tanh(gc + r * uc)
            seen.append(h)
        states[d] = seen if d == "f" else seen[::-1]
    both = np.array([np.concatenate(x) for x in zip(states["f"], states["b"])])
    energy = np.tanh(both @ p["av"]) @ p["a"]
    weight = np.exp(energy - energy.max())
    return (weight / weight.sum()) @ both @ p["w"] + p["b"][0]


def test_scores_against_a_plain_network():
    rows = sample(120)
    net = tx.train([t for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    for text in (rows[0][1], "venom", " ".join(["a", "bb", "spite", "ccc"] * 20)):
        words = text.split()
        starts = [*range(0, max(1, len(words) - tx.WINDOW + 1), tx.STRIDE)]
        if starts[-1] + tx.WINDOW < len(words):
            starts.append(starts[-1] + tx.STRIDE)
        logits = np.array([plain_window(net, words[a : a + tx.WINDOW]) for a in starts])
        said = tx._summary(logits, np.zeros(len(logits), dtype=np.int64), 1)
        want = tx._sigmoid(said @ net.p["doc"].astype(np.float64))[0]
        assert abs(net.text_scores([text.encode()])[0] - want) < 1e-4


def test_held_out_accuracy():
    rows = sample()
    net = tx.train([t for _, t, _ in rows[:300]], [y for *_, y in rows[:300]])
    score = net.text_scores([t.encode() for _, t, _ in rows[300:]])
    label = np.array([y for *_, y in rows[300:]])
    assert ((score >= 0.7) == (label == 1)).mean() > 0.9


def test_windows_cover_and_overlap():
    for n in (0, 1, 23, 24, 25, 40, 41, 1000):
        _, start, end = tx.windows(np.array([0, n]))
        covered = np.zeros(n, dtype=int)
        for a, b in zip(start, end):
            covered[a:b] += 1
        assert (covered > 0).all() and (n == 0) == (len(start) == 0)
        if n > tx.WINDOW:
            assert (start[1:] < end[:-1]).all()


def test_scores_of_a_table(spark, docs):
    rows = sample(120)
    net = tx.train([t for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    table = [(i, t, 0.5) for i, t, _ in rows] + [(None, rows[0][1], 1.0), (0, rows[0][1], 1.0), (900, None, 1.0), (901, "", 1.0), (902, "...", 1.0), (903, "word " * 30000, 1.0)]
    out = tx.add_scores(docs(table, "doc_id long, text string, score double"), net).collect()
    assert len(out) == len(table) and all(0 <= r["score"] <= 1 for r in out)
    of = {r["doc_id"]: r["score"] for r in out}
    assert of[900] == of[901] == of[902] and of[0] == of[None]


def test_held_out_rows_and_sample(spark, docs, monkeypatch):
    rows = sample(200)
    labels = docs([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in labels.where(tx.is_held_out()).collect()}
    assert held == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    texts, found = tx.training_sample(docs([(i, t) for i, t, _ in rows]), labels.where(~tx.is_held_out()))
    assert sorted(zip(texts, found)) == sorted((t, y) for i, t, y in rows if i not in held)
    monkeypatch.setattr(tx, "SAMPLE_EACH", 5)
    assert len(tx.training_sample(docs([(i, t) for i, t, _ in rows]), labels)[0]) == 10


def test_rare_label_keeps_its_share(spark, docs, monkeypatch):
    # Joint hash order would spend the characters on the clean texts of the lowest hashes.
    monkeypatch.setattr(tx, "SAMPLE_EACH", 20)
    monkeypatch.setattr(tx, "SAMPLE_CHARS", 2400)
    rows = [(i, "abcde " * 20, int(i % 100 == 0)) for i in range(2000)]
    _, found = tx.training_sample(docs([(i, t) for i, t, _ in rows]), docs([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert found.count(0) == found.count(1) == 10
    # What one label leaves goes to the other.
    _, found = tx.training_sample(docs([(i, t) for i, t, _ in rows]), docs([(i, y) for i, _, y in rows if not y or i < 200], "doc_id long, toxic int"))
    assert (found.count(0), found.count(1)) == (18, 2)


def test_long_document_does_not_end_the_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE_CHARS", 6000)
    rows = [(i, "abcde " * 10, i % 2) for i in range(20)]
    labels = docs([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    for long in (3, 8):
        texts, found = tx.training_sample(docs([(i, t * 100 if i == long else t) for i, t, _ in rows]), labels)
        assert len(texts) == 19 and found.count(long % 2) == 9
    # Where no text of a label fits, a part of one does.
    texts, found = tx.training_sample(docs([(i, t * 100 if y else t) for i, t, y in rows]), labels)
    assert found.count(1) == 1 and len(texts[found.index(1)]) == 6 * 900


def test_no_labels(spark, docs):
    net = tx.learned(docs([(1, "a b")]), docs([], "doc_id long, toxic int"))
    assert tx.add_scores(docs([(1, "a b")]), net).first()["score"] < 0.01
    assert tx.add_scores(docs([]), net).collect() == []
