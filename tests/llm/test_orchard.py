import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import orchard
from ledgerline.llm.orchard import Neighbours, books_digest, label_errors, vector_codes


def plain(vectors, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks of [(id, vector)], by comparing everything with everything."""
    good = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v in good], dtype=np.int64).reshape(len(good), parts, -1)
    books = [np.array([v for _, v in order[:entries]], dtype=np.int64).reshape(-1, parts, x.shape[2])[:, p].copy() for p in range(parts)]
    away = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            near = away(p).argmin(axis=1)
            for e in set(near.tolist()):
                books[p][e] = [int(s) // int((near == e).sum()) for s in x[near == e, p].sum(axis=0)]
    nearest = [away(p) for p in range(parts)]
    code = ["".join(f"{nearest[p][i].argmin():02x}" for p in range(parts)) for i in range(len(good))]
    return [(i, c, int(sum(nearest[p][k].min() for p in range(parts)))) for k, ((i, _), c) in enumerate(zip(good, code))], books


@pytest.mark.parametrize("kind", ["spread", "ties", "clusters", "one", "equal"])
def test_search_against_all_distances(kind):
    r = np.random.default_rng(3)
    entries = {"spread": r.integers(-99, 99, (256, 16)), "ties": r.integers(-1, 2, (200, 3)), "clusters": r.integers(-9, 9, (256, 16)) + 500 * r.integers(0, 3, (256, 1)), "one": r.integers(0, 9, (1, 4)), "equal": np.ones((40, 5), dtype=int)}[kind]
    rows = np.concatenate([entries[r.integers(0, len(entries), 400)] + r.integers(-2, 3, (400, entries.shape[1])), r.integers(-99, 600, (200, entries.shape[1]))])
    entry, distance, compared = Neighbours(entries).nearest(rows.astype(np.int64))
    away = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (entry == away.argmin(axis=1)).all() and (distance == away.min(axis=1)).all()
    assert compared <= away.size
    if kind == "clusters":
        assert compared < 0.7 * away.size  # lists end early where entries lie in clusters


def test_walkers_beyond_one_batch(monkeypatch):
    monkeypatch.setattr(orchard, "WALKERS", 7)
    r = np.random.default_rng(4)
    entries, rows = r.integers(-50, 50, (90, 6)), r.integers(-50, 50, (100, 6))
    assert (Neighbours(entries).nearest(rows)[0] == ((rows[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def vectors():
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.1, 16).astype(np.float32)], int(i) % 3 if i % 5 else None, "x") for i in r.permutation(300)]
    return rows + [(400, None, 1, "x"), (401, [0.5] * 15 + [float("nan")], 1, "x"), (402, [float("inf")] + [0.0] * 15, 1, "x"), (403, [None] + [0.0] * 15, 1, "x"), rows[0], (rows[1][0], rows[2][1], 2, "x"), (None, [0.25] * 16, 0, "x")]


def test_codes_against_the_plain_version(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(5)
    codes, books = vector_codes(df, keep=("vec_id", "label"))
    got = label_errors(codes.select("row.vec_id", "row.label", "code", "error")).collect()
    want, want_books = plain([(i, v) for i, v, *_ in rows])
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=str) == sorted(want, key=str)
    assert all((a == b).all() for a, b in zip(books, want_books))
    assert books_digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for x in b.ravel()).encode()).hexdigest()
    for r in got:
        assert r["label_error"] == sum(x["error"] for x in got if x["label"] == r["label"])


def test_odd_tables(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0, 5.0, -1.0, 0.0, 9.0]) for i in range(5)], "vec_id long, embedding array<double>")
    codes, books = vector_codes(few)
    assert [len(b) for b in books] == [5] * 4
    assert sorted((r["vec_id"], r["error"]) for r in codes.select("row.vec_id", "error").collect()) == [(i, 0) for i in range(5)]
    # Vectors of another length than the first one's are left out, and so is what can't be cut into parts.
    mixed = few.union(spark.createDataFrame([(9, [1.0] * 4), (10, [])], few.schema))
    assert vector_codes(mixed)[0].count() == 5
    assert vector_codes(few.select("vec_id", F.slice("embedding", 1, 6).alias("embedding")))[0].count() == 0
    empty, books = vector_codes(few.where("vec_id < 0"))
    assert empty.collect() == [] and books == [] and empty.columns == ["row", "code", "error"]
    huge = spark.createDataFrame([(1, [1e300] * 4), (2, [-1e300] * 4)], "vec_id long, embedding array<double>")
    assert sorted(r["error"] for r in vector_codes(huge)[0].collect()) == [0, 0]
    with pytest.raises(ValueError):
        vector_codes(few, entries=257)
