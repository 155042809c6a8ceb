import numpy as np
import pytest

from ledgerline.llm import chroma as ch


def melody(notes, noise=0.0, seed=0):
    t = np.arange(ch.NOTE) / ch.RATE
    wave = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])
    wave = wave + noise * np.random.default_rng(seed).standard_normal(len(wave))
    return (wave * 12000).astype("<i2")


def test_integral_image_equals_plain_sums():
    c = ch.chroma(melody(np.random.default_rng(0).integers(0, 24, 40)))
    assert np.allclose((c**2).sum(axis=1), 1)
    packed, sound = ch.fingerprint(melody(np.random.default_rng(0).integers(0, 24, 40)))
    assert len(packed) == len(c) - ch.SPAN + 1 and sound.all()
    for i, (shape, y, h, w) in enumerate(ch._filters()):
        if shape == 0:
            a, b = c[: w // 2, y : y + h].sum(), c[w // 2 : w, y : y + h].sum()
            ratio = np.log((1e-3 + b) / (1e-3 + a))
            level = int(ratio > -0.35) + int(ratio > 0) + int(ratio > 0.35)
            assert (int(packed[0]) >> (2 * (15 - i))) & 3 == level ^ (level >> 1)


def test_silence_and_short_recordings():
    packed, sound = ch.fingerprint(np.zeros(20000, dtype="<i2"))
    assert len(packed) and not sound.any()
    assert len(ch.fingerprint(np.zeros(10, dtype="<i2"))[0]) == 0


def test_alignment(spark, docs):
    r = np.random.default_rng(4)
    songs = [r.integers(0, 24, 60) for _ in range(12)]
    rows = [(i, melody(s).tobytes()) for i, s in enumerate(songs)] + [(20, melody(songs[3]).tobytes()), (30, None), (31, b""), (32, b"\0" * 40001), (None, melody(songs[1]).tobytes())]
    media = spark.createDataFrame(rows, "id long, pcm binary")
    asked = spark.createDataFrame([(3, melody(songs[3][16:48], 0.05).tobytes()), (7, melody(songs[7], 0.05).tobytes()), (99, melody(r.integers(0, 24, 40)).tobytes()), (50, None)], "id long, pcm binary")
    prints = ch.fingerprints(media, "id")
    got = {(x["query"], x["match"]): x["offset"] for x in ch.align(ch.fingerprints(asked, "id"), prints).collect()}
    assert got == {(3, 3): 32, (3, 20): 32, (7, 7): 0}
    best = {x["query"]: (x["match"], x["n_matches"]) for x in ch.best_match(ch.align(ch.fingerprints(asked, "id"), prints)).collect()}
    assert best == {3: (3, 2), 7: (7, 1)}


PRINTS = "id long, n_positions long, codes array<int>, sounds array<boolean>, runs array<long>"


def prints_of(spark, rows):
    keyed = [(i, len(codes), codes, sounds, ch.run_keys(np.array(codes, dtype=np.int32).view(np.uint32)).view(np.int64).tolist()) for i, codes, sounds in rows]
    return spark.createDataFrame(keyed, PRINTS)


def test_bit_errors(spark, docs):
    row = ch.align(prints_of(spark, [(9, [2, 3, 5], [True] * 3)]), prints_of(spark, [(1, [1, 2, 3, 4], [True] * 4)]), least_votes=2).first()
    assert (row["offset"], row["votes"], row["n_compared"], row["bit_errors"]) == (1, 2, 3, 1)


def test_runs():
    keys = ch.run_keys(np.array([5, 5, 5, 7, 7, 5, 5, 7, 5], dtype=np.uint32))
    assert [int(k > 0) for k in keys] == [1, 0, 0, 1, 0, 1, 0, 1, 1]
    assert keys[0] == keys[5] and len({*keys[keys > 0].tolist()}) == 4
    assert len(ch.run_keys(np.zeros(0, dtype=np.uint32))) == 0


def plain_alignment(asked, stored, frequent):
    """What align() says, from every pair of positions: recordings meet by a mark in common, and then all their codes vote."""
    held = {}
    for codes, sounds in {(tuple(c), tuple(s)) for _, c, s in stored}:
        for c, s in zip(codes, sounds):
            if s:
                held[c] = held.get(c, 0) + 1

    def marks(codes, sounds):
        starts = [i for i in range(len(codes)) if i == 0 or codes[i] != codes[i - 1]]
        follow = {i: tuple(codes[j] for j in starts[n : n + 3]) for n, i in enumerate(starts)}
        for i, (c, s) in enumerate(zip(codes, sounds)):
            if s and held.get(c, 0) <= frequent:
                yield i, c
            elif s and i in follow:
                yield i, follow[i]

    out = {}
    for q, qc, qs in asked:
        for r, rc, rs in stored:
            if not {x for _, x in marks(qc, qs)} & {x for _, x in marks(rc, rs)}:
                continue
            votes = {}
            for i, (x, heard) in enumerate(zip(qc, qs)):
                for j, (y, sounds) in enumerate(zip(rc, rs)):
                    if x == y and heard and sounds:
                        votes[j - i] = votes.get(j - i, 0) + 1
            if not votes:
                continue
            offset = min(votes, key=lambda o: (-votes[o], o))
            a, b = max(0, -offset), max(0, offset)
            n = min(len(qc) - a, len(rc) - b)
            wrong = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in zip(qc[a : a + n], rc[b : b + n]))
            if votes[offset] >= ch.LEAST_VOTES and wrong <= ch.MOST_ERRORS * 32 * n:
                out[q, r] = (offset, votes[offset], n, wrong)
    return out


@pytest.mark.parametrize("frequent", [3, 10**6])
def test_against_brute_force(spark, docs, monkeypatch, frequent):
    # Few codes in long runs, so most are frequent; ties, equal recordings and silence among them.
    monkeypatch.setattr(ch, "FREQUENT", frequent)
    r = np.random.default_rng(8)
    stored = []
    for i in range(14):
        codes = np.repeat(r.integers(-3, 6, 30), r.integers(1, 5, 30)).tolist()
        stored.append((i, codes, [bool(x) for x in r.random(len(codes)) < 0.95]))
    stored += [(50, *stored[2][1:]), (51, [4] * 40, [True] * 40), (52, [], [])]
    asked = [(100 + i, c[5:45], s[5:45]) for i, c, s in stored[:6]] + [(120, [4] * 12, [True] * 12), (121, [1, 2], [True, True])]
    got = {(x["query"], x["match"]): (x["offset"], x["votes"], x["n_compared"], x["bit_errors"]) for x in ch.align(prints_of(spark, asked), prints_of(spark, stored)).collect()}
    assert got == plain_alignment(asked, stored, frequent) and len(got) >= 6
    # Where codes are frequent, what is found is as it would be otherwise, and all copies are found that have more than one code.
    everything = plain_alignment(asked, stored, 10**6)
    assert got.items() <= everything.items()
    assert {k for k, v in everything.items() if v[3] == 0 and k[0] < 120} <= got.keys()


@pytest.mark.parametrize("frequent", [0, 3, 40])
def test_exact_misses_nothing(spark, docs, monkeypatch, frequent):
    """Whatever counts as frequent, and over several blocks, pairs are those of all positions against all."""
    monkeypatch.setattr(ch, "FREQUENT", frequent)
    for name, bound in (("BLOCK", 300), ("COUNTED", 400), ("LISTED", 50)):
        monkeypatch.setattr(ch, name, bound)
    r = np.random.default_rng(8)
    stored = []
    for i in range(14):
        codes = np.repeat(r.integers(-3, 6, 30), r.integers(1, 5, 30)).tolist()
        stored.append((i, codes, [bool(x) for x in r.random(len(codes)) < 0.95]))
    stored += [(50, *stored[2][1:]), (51, [4] * 40, [True] * 40), (52, [], []), (53, [900, 4, 901, 4, 902], [True] * 5)]
    asked = [(100 + i, c[5:45], s[5:45]) for i, c, s in stored[:6]] + [(120, [4] * 12, [True] * 12), (121, [1, 2], [True, True]), (122, [900, 5, 901, 5, 902], [True] * 5)]
    got = {(x["query"], x["match"]): (x["offset"], x["votes"], x["n_compared"], x["bit_errors"]) for x in ch.align(prints_of(spark, asked), prints_of(spark, stored), exact=True).collect()}
    assert got == plain_alignment(asked, stored, 10**6) and (122, 53) in got


def test_recall_where_integers_are_frequent(spark, monkeypatch):
    """Of noisy parts among 500 recordings, with nearly every integer frequent: the same answers, 0.9 of them at least."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    recordings = ch.written(ch.fingerprints(ch.melodies(vectors, "vec_id", "embedding"), "id"), "recordings")
    parts = ch.written(ch.fingerprints(ch.melodies(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", first=16, last=48, noise=0.05), "id"), "parts")
    found = []
    for frequent in (10**9, 0):
        monkeypatch.setattr(ch, "FREQUENT", frequent)
        found.append({(r["query"], r["match"]): (r["offset"], r["votes"], r["bit_errors"]) for r in ch.align(parts, recordings).collect()})
    both = found[0].keys() & found[1].keys()
    assert all(found[0][k] == found[1][k] for k in both) and not found[1].keys() - found[0].keys()
    print(f"recall {len(both)} of {len(found[0])}")
    assert len(both) >= 0.9 * len(found[0]) >= 0.9 * 25


def test_votes_of_long_tones():
    r = np.random.default_rng(3)
    for a, b in ((r.integers(0, 4, 90), r.integers(0, 4, 120)), (np.full(3000, 7), np.full(2500, 7)), (np.array([1]), np.array([2])), (np.zeros(0, dtype=np.int64), np.array([1]))):
        counts = {}
        for i, x in enumerate(a.tolist()):
            for j in np.flatnonzero(b == x).tolist():
                counts[j - i] = counts.get(j - i, 0) + 1
        votes, offset = ch.offset_votes(a, b)
        assert votes == max(counts.values(), default=0) and (not counts or offset == min(o for o, n in counts.items() if n == votes))


def test_long_recordings_in_pieces(monkeypatch):
    samples = melody(np.random.default_rng(2).integers(0, 24, 90))
    whole = ch.fingerprint(samples)[0]
    monkeypatch.setattr(ch, "FRAMES", 7)
    assert np.array_equal(ch.fingerprint(samples)[0], whole)


def test_clashing_names_and_odd_vectors(spark, docs):
    vectors = spark.createDataFrame([(1, [0.1, float("nan"), None, float("inf")], 7), (1, [0.1, float("nan"), None, float("inf")], 7), (2, [], 7), (None, None, 7)], "pcm long, v array<double>, id int")
    out = ch.fingerprints(ch.melodies(vectors, "pcm", "v"), "id").collect()
    assert sorted((r["id"] or 0, r["n_positions"]) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 0)]


def test_empty_tables(spark, docs):
    media = spark.createDataFrame([], "id long, pcm binary")
    prints = ch.fingerprints(media, "id")
    assert ch.align(prints, prints).collect() == []
