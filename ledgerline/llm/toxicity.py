"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its learned vector, one for all words that training saw in few documents, beside
the mean of its character n-grams' vectors. Overlapping windows of words go through a GRU in both directions; attention
pools the states and a logistic unit scores the window. A document's score comes
from its highest window, the mean over all of them, and their number. The network is trained in numpy on a bounded sample of
labelled documents; tasks then score every window of every text, with the gates' input
parts computed once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.llm import wordhash as wh
from ledgerline.llm.storage import discard, small_batches, written
from ledgerline.llm.workers import frugal

#: Words of a window and between the starts of two.
WINDOW, STRIDE = 24, 16
GRAM_BUCKETS = 1 << 14
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 10, 8
#: Lengths in bytes of the character n-grams, which count a mark before and after the word.
GRAMS = (3, 6)
#: Words with a vector of their own: those of so many training documents, so many at most; others share one.
LEAST_DOCS, MOST_WORDS = 8, 1 << 13
#: Labelled documents that training reads at most (of each label), and the characters of all.
SAMPLE_EACH, SAMPLE_CHARS = 1500, 4_800_000
#: Texts of more than this part of their label's characters are sampled last.
LONG = 20
EPOCHS, SEED = 6, 7
#: Weight decay by parameter, 0.01 for the others; and the part of words whose characters a step leaves out.
DECAY, LEFT_OUT = {"gram": 0.1, "word": 0.1}, 0.2

_TOKEN = wh.byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


_SPREAD = np.random.default_rng(11).integers(1, 2**63, max(GRAMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Distinct:
    """Distinct words of a batch: hashes, and the n-gram buckets of each in its span."""

    hashes: np.ndarray
    grams: np.ndarray
    cuts: np.ndarray  # first n-gram of each word; every word has at least one


def distinct_words(words: wh.Words) -> tuple[Distinct, np.ndarray]:
    """The batch's distinct words and, for each of its words, which one it is."""
    h = words.hashes()
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    start, end = words.starts[first], words.ends[first]
    size = end - start
    # Each distinct word's bytes between two marks, laid end to end.
    width = size + 2
    begin = np.cumsum(width) - width
    data = np.full(int(width.sum()), 0x5E, dtype=np.uint64)
    inside = np.repeat(start - begin - 1, width) + np.arange(len(data))
    body = np.ones(len(data), dtype=bool)
    body[begin] = body[begin + width - 1] = False
    data[body] = words.data[inside[body]]
    owner = np.repeat(np.arange(len(first)), width)
    room = (begin + width)[owner] - np.arange(len(data))
    counts = [np.maximum(width - n + 1, 0) for n in GRAMS]
    cuts = np.cumsum(sum(counts)) - sum(counts)
    flat = np.empty(int(sum(counts).sum()), dtype=np.int64)
    place = np.arange(len(data)) + (cuts - begin)[owner]
    for n, count in zip(GRAMS, counts):
        run = np.full(max(0, len(data) - n + 1), n, dtype=np.uint64)
        for i in range(n):
            run += data[i : i + len(run)] * _SPREAD[i]
        ok = room[: len(run)] >= n
        flat[place[: len(run)][ok]] = (wh.mix(run[ok]) % np.uint64(GRAM_BUCKETS)).astype(np.int64)
        place += count[owner]
    return Distinct(h[first], flat, cuts), inverse


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all windows; the last ends with its text, and a text without words has none."""
    n = np.diff(first)
    per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = first[:-1][text] + nth * STRIDE
    return text, start, np.minimum(start + WINDOW, first[1:][text])


class Network:
    """The parameters, scoring, and one training step."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        size = WORD_DIM + GRAM_DIM

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "known": np.zeros(0, dtype=np.uint64),  # sorted hashes of the words with a vector; the last vector is all others'
            "word": normal(1, WORD_DIM, scale=0.05),
            "gram": normal(GRAM_BUCKETS, GRAM_DIM, scale=0.1),
            "av": normal(2 * HIDDEN, ATTENTION, scale=0.3),
            "a": normal(ATTENTION, scale=0.3),
            "w": normal(2 * HIDDEN, scale=0.3),
            "b": np.array([-1.5], dtype=np.float32),
            "doc": np.zeros(5, dtype=np.float32),  # weights of a text's summary, the last a constant
        }
        for d in "fb":
            self.p |= {f"x{d}": normal(size, 3 * HIDDEN, scale=0.4), f"c{d}": np.zeros(3 * HIDDEN, dtype=np.float32), f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3)}
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.steps = 0

    def know(self, hashes: np.ndarray) -> None:
        """Give these words vectors of their own."""
        self.p["known"] = np.sort(hashes)
        self.p["word"] = (np.random.default_rng(SEED).standard_normal((len(hashes) + 1, WORD_DIM)) * 0.05).astype(np.float32)

    def word_rows(self, words: Distinct) -> np.ndarray:
        known = self.p["known"]
        if not len(known):
            return np.zeros(len(words.hashes), dtype=np.int64)
        place = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
        return np.where(known[place] == words.hashes, place, len(known))

    def inputs(self, words: Distinct) -> np.ndarray:
        counts = np.diff(np.append(words.cuts, len(words.grams)))
        mean = np.add.reduceat(self.p["gram"][words.grams], words.cuts, axis=0) / counts[:, None]
        return np.concatenate([self.p["word"][self.word_rows(words)], mean], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _run(self, d: str, g: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction over all windows; keep collects what the way back needs."""
        n, steps = index.shape
        u, h = self.p[f"u{d}"], np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.empty((steps, n, HIDDEN), dtype=np.float32)
        two = 2 * HIDDEN
        full = mask.all(axis=0)
        # A sigmoid is a shifted tanh of half its argument, and half the gates' inputs serve all steps.
        half_zr, own, half_u = g[:, :two] * np.float32(0.5), np.ascontiguousarray(g[:, two:]), u[:, :two] * np.float32(0.5)
        u_own = np.ascontiguousarray(u[:, two:])
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            at = index[:, t]
            zr = h @ half_u
            zr += half_zr.take(at, axis=0)
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rec = h @ u_own
            cand = r * rec
            cand += own.take(at, axis=0)
            np.tanh(cand, out=cand)
            new = out[t]
            np.subtract(h, cand, out=new)
            new *= z
            new += cand
            if not full[t]:
                np.copyto(new, h, where=~mask[:, t : t + 1])
            if keep is not None:
                keep.append((t, h, z, r, cand, rec))
            h = new
        return out

    def forward(self, gates: dict, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window logits; index (windows, steps) points at the distinct words."""
        tapes = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._run(d, gates[d], index, mask, tapes[d]) for d in "fb"], axis=2)
        tanh = np.tanh(states @ self.p["av"])
        energy = np.where(mask.T, tanh @ self.p["a"], -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"tapes": tapes, "states": states, "tanh": tanh, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def step(self, words: Distinct, index: np.ndarray, mask: np.ndarray, label: np.ndarray, rate: float, shown: np.ndarray) -> float:
        """One Adam step of the windows' cross-entropy; gradients go back through time by hand.

        shown: 1 for the words whose characters are shown, 0 for those left out this time, by which
        words that have vectors learn to do without.
        """
        x = self.inputs(words)
        x[:, WORD_DIM:] *= shown[:, None]
        gates, keep = self.gates(x), {}
        p = _sigmoid(self.forward(gates, index, mask, keep))
        n, steps = index.shape
        fixed = ("doc", "known")
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in fixed}
        d_logit = ((p - label) / n).astype(np.float32)
        g["b"][0], g["w"] = d_logit.sum(), keep["pooled"].T @ d_logit
        d_pooled = d_logit[:, None] * self.p["w"]
        states, weight, tanh = keep["states"], keep["weight"], keep["tanh"]
        d_states = weight[:, :, None] * d_pooled[None]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["a"] = np.einsum("tna,tn->a", tanh, d_energy)
        d_tanh = d_energy[:, :, None] * self.p["a"] * (1 - tanh**2)
        g["av"] = np.einsum("tnh,tna->ha", states, d_tanh)
        d_states = d_states + d_tanh @ self.p["av"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, d_h = self.p[f"u{d}"], np.zeros((n, HIDDEN), dtype=np.float32)
            d_gate = np.zeros_like(gates[d])
            for t, h, z, r, cand, rec in reversed(keep["tapes"][d]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                on = mask[:, t : t + 1]
                d_new = np.where(on, d_h, 0)
                d_cand = d_new * (1 - z) * (1 - cand**2)
                d_z = d_new * (h - cand) * z * (1 - z)
                d_r = d_cand * rec * r * (1 - r)
                d_rec = np.concatenate([d_z, d_r, d_cand * r], axis=1)
                g[f"u{d}"] += h.T @ d_rec
                np.add.at(d_gate, index[:, t], np.concatenate([d_z, d_r, d_cand], axis=1))
                d_h = np.where(on, d_new * z, d_h) + d_rec @ u.T
            g[f"x{d}"], g[f"c{d}"] = x.T @ d_gate, d_gate.sum(axis=0)
            d_x += d_gate @ self.p[f"x{d}"].T
        np.add.at(g["word"], self.word_rows(words), d_x[:, :WORD_DIM])
        d_x[:, WORD_DIM:] *= shown[:, None]
        counts = np.diff(np.append(words.cuts, len(words.grams)))
        np.add.at(g["gram"], words.grams, np.repeat(d_x[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        self.steps += 1
        for k in g:
            grad = g[k]
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * grad
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * grad**2
            up = self.m[k] / (1 - 0.9**self.steps)
            self.p[k] *= 1 - rate * DECAY.get(k, 0.01)
            self.p[k] -= (rate * up / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)
        return float(-np.mean(np.log(np.where(label > 0, p, 1 - p) + 1e-9)))

    def window_logits(self, gates: dict, inverse: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 2048) -> np.ndarray:
        out = np.zeros(len(start), dtype=np.float32)
        # Windows of one length go together, so most steps need no mask.
        order = np.argsort(end - start, kind="stable")
        for a in range(0, len(start), size):
            these = order[a : a + size]
            index, mask = _grid(inverse, start[these], end[these])
            out[these] = self.forward(gates, index, mask)
        return out

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text from all its windows; one without words has the constant's."""
        words = wh.Words(texts, _TOKEN)
        distinct, inverse = distinct_words(words)
        text, start, end = windows(words.first)
        logits = self.window_logits(self.gates(self.inputs(distinct)), inverse, start, end) if len(text) else np.zeros(0)
        return _sigmoid(_summary(logits, text, len(texts)) @ self.p["doc"].astype(np.float64))


#: Window logit that stands for a text without words.
EMPTY = -6.0


def _summary(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """What each text's windows say together: highest logit, mean probability and its logit, number of windows; and 1."""
    highest = np.full(n, -np.inf)
    np.maximum.at(highest, text, logits)
    count = np.bincount(text, minlength=n)
    mean = np.bincount(text, weights=_sigmoid(logits), minlength=n) / np.maximum(count, 1)
    highest = np.where(count > 0, np.clip(highest, -12, 12), EMPTY)
    mean = np.where(count > 0, mean, _sigmoid(np.array(EMPTY)))
    near = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([highest / 4, 4 * mean, np.log(near / (1 - near)) / 2, np.log1p(count) / 2, np.ones(n)], axis=1)


def _grid(inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    mask = at < end[:, None]
    return inverse[np.where(mask, at, start[:, None])], mask


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit the network to labelled texts: in each epoch a text's highest windows stand for it.

    A toxic text teaches by its two highest windows, a clean one by its two highest and one at random. In the
    first epoch windows are drawn at random, as none is known yet. Texts of one label alone give a network that says so.
    """
    r = np.random.default_rng(seed)
    net = Network(seed)
    words = wh.Words([b"" if t is None else t.encode() for t in texts], _TOKEN)
    label = np.array(labels, dtype=np.float32)
    if not len(label) or label.min() == label.max():
        net.p["doc"] = np.array([0, 0, 0, 0, 8 if len(label) and label[0] > 0 else -8], dtype=np.float32)
        return net
    distinct, inverse = distinct_words(words)
    text, start, end = windows(words.first)
    counts = np.diff(np.append(distinct.cuts, len(distinct.grams)))
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    pairs = np.unique(np.stack([owner, inverse], axis=1), axis=0)
    seen = np.bincount(pairs[:, 1], minlength=len(distinct.hashes))
    often = np.argsort(-seen, kind="stable")[:MOST_WORDS]
    net.know(distinct.hashes[often[seen[often] >= LEAST_DOCS]])
    for epoch in range(epochs):
        if epoch == 0:
            rank = r.random(len(text))
        else:
            rank = net.window_logits(net.gates(net.inputs(distinct)), inverse, start, end)
        order = np.lexsort((-rank, text))
        place = np.empty(len(text), dtype=np.int64)
        firsts = np.searchsorted(text[order], np.arange(len(texts)))
        place[order] = np.arange(len(text)) - firsts[text[order]]
        pick = place < (4 if epoch == 0 else 2)
        if epoch:
            pick |= (label[text] == 0) & (r.random(len(text)) < 1 / np.maximum(1, np.bincount(text, minlength=len(texts))[text]))
        chosen = r.permutation(np.flatnonzero(pick))
        for a in range(0, len(chosen), 128):
            w = chosen[a : a + 128]
            index, mask = _grid(inverse, start[w], end[w])
            used, local = np.unique(index, return_inverse=True)
            cut = np.cumsum(counts[used]) - counts[used]
            flat = np.repeat(distinct.cuts[used] - cut, counts[used]) + np.arange(counts[used].sum())
            part = Distinct(distinct.hashes[used], distinct.grams[flat], cut)
            net.step(part, local.reshape(index.shape), mask, label[text[w]], 0.01 if epoch < 3 else 0.003, (r.random(len(used)) >= LEFT_OUT).astype(np.float32))
    said = _summary(net.window_logits(net.gates(net.inputs(distinct)), inverse, start, end), text, len(texts))
    net.p["doc"] = _fit_document(said, label)
    return net


def _fit_document(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic weights of the texts' summaries, by Newton steps with a penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - label) + w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w.astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Up to SAMPLE_EACH texts of each label, by the ids' hashes, of SAMPLE_CHARS characters in all.

    Each label has half of the characters, and what the other leaves of its half. A text that doesn't fit is passed over;
    those of more than a LONG-th of the label's share come after the others. If no text of a label fits, a run of
    characters of its shortest stands for it. Texts are chosen by their sizes, so only what is chosen reaches the driver.
    """
    keyed = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("label")).distinct()
    order = F.xxhash64(id_col)
    chosen = keyed.where("label = 1").orderBy(order, id_col).limit(SAMPLE_EACH).union(keyed.where("label = 0").orderBy(order, id_col).limit(SAMPLE_EACH))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # 2 * SAMPLE_EACH rows of two numbers: small enough to send to every task.
    joined = docs.join(F.broadcast(chosen), id_col)
    rows = written(joined.select(F.col(id_col).alias("id"), text.alias("text"), "label", F.greatest(F.lit(1), F.length(text)).cast("long").alias("size"), F.xxhash64(id_col, text).alias("key")), "sample")
    total = {r["label"]: r["size"] for r in rows.groupBy("label").agg(F.sum("size").alias("size")).collect()}
    texts, found = [], []
    for label in sorted(total):
        share = max(SAMPLE_CHARS // 2, SAMPLE_CHARS - total.get(1 - label, 0))
        of_label = rows.where(F.col("label") == label)
        # A row of three numbers for each text, SAMPLE_EACH at most, though an id may have repeated rows.
        sizes = of_label.where(F.col("size") <= share).orderBy(F.col("size") > share // LONG, F.xxhash64("id"), "id", "key").select("size", "key").limit(SAMPLE_EACH).collect()
        left, picked = share, []
        for row in sizes:
            if row["size"] <= left:
                left -= row["size"]
                picked.append(row["key"])
        if picked:
            got = {r["key"]: r["text"] for r in of_label.where(F.col("key").isin(picked)).select("key", "text").dropDuplicates(["key"]).collect()}
            some = [got[key] for key in dict.fromkeys(picked)]
        else:
            # A run at a place that its id tells, so that a long text isn't always known by its beginning.
            at = F.pmod(F.xxhash64("id"), F.length("text") - share + 1) + 1
            shortest = of_label.orderBy("size", F.xxhash64("id"), "id", "key").limit(1)
            some = [shortest.select(F.col("text").substr(at.cast("int"), F.lit(share))).first()[0]]
        texts += some
        found += [label] * len(some)
    discard(rows)
    return texts, found


def add_scores(docs: DataFrame, network: Network, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from all windows of each row's whole text, as column ``to``, replaced if it is there.

    A null text is an empty one; a text without words scores as one quiet window does. Nothing but the
    text is an input. Rows may repeat, and other columns pass through whatever they hold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop(to)
    model = spark.sparkContext.broadcast(network.p)
    schema = StructType([*rows.schema.fields, StructField(to, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = model.value
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            out = [net.text_scores(texts[a:b]) for a, b in wh.in_batches(texts)]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(score.astype(np.float64))], names=[*batch.schema.names, to])

    return rows.mapInArrow(frugal(run), schema)


def is_held_out(id_col: str = "doc_id"):
    """Rows that training never reads: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network trained on labelled rows that aren't held out."""
    return train(*training_sample(docs, labels.where(~is_held_out(id_col)), id_col, text_col))
