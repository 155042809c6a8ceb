"""Vector codes: vectors cut into parts, each coded by the nearest entry of its part's codebook, which Orchard's search finds.

Vectors are whole numbers (components times SCALE, rounded down), so distances are exact and answers the same on any machine.

Orchard's search keeps, for every entry of a codebook, the other entries sorted by their distance from it. A part
starts at some entry and goes along that entry's list; when it meets an entry that is nearer, it jumps to that one's list. Entries
that have been compared are marked and passed over. It stops where the list reaches beyond twice the current distance, since by the
triangle inequality nothing from there on can be nearer. The parts of a batch walk together, each along its own list, a strip of it
at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import small_batches, written
from ledgerline.llm.workers import frugal

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a list that are compared at a time, and parts that walk at a time.
STRIP, WALKERS = 32, 8192


def largest(width: int) -> int:
    """Bound of a component, so that four times a distance of ``width`` of them fits 64 bits."""
    return 1 << ((58 - max(1, width).bit_length()) // 2)


class Neighbours:
    """A codebook (entries x components, whole numbers) with each entry's list of the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n = len(entries)
        apart = np.empty((n, n), dtype=np.int64)
        for i in range(n):
            apart[i] = ((self.entries - self.entries[i]) ** 2).sum(axis=1)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance) of each row, ties to the lower entry, and how many distances it took."""
        current, best, compared = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), 0
        for a in range(0, len(rows), WALKERS):
            current[a : a + WALKERS], best[a : a + WALKERS], n = self._walk(rows[a : a + WALKERS])
            compared += n
        return current, best, compared

    def _walk(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, k, most = len(rows), len(self.entries), np.iinfo(np.int64).max
        away = rows - self.entries[0]
        current, best, compared = np.zeros(n, dtype=np.int64), np.einsum("ij,ij->i", away, away), n
        marked = np.zeros((n, k), dtype=bool)
        marked[:, 0] = True
        at, active, strip = np.zeros(n, dtype=np.int64), np.arange(n), np.arange(STRIP)
        while len(active):
            place = at[active][:, None] + strip
            of = (current[active][:, None], np.minimum(place, k - 1))
            entries, near = self.order[of], best[active]
            # Beyond twice the distance nothing is nearer; just at it an entry could be as near.
            reach = (place < k) & (self.apart[of] <= 4 * near[:, None])
            fresh = reach & ~marked[active[:, None], entries]
            walker, step = np.nonzero(fresh)
            entry = entries[walker, step]
            away = rows[active[walker]] - self.entries[entry]
            found = np.full(fresh.shape, most)
            found[walker, step] = np.einsum("ij,ij->i", away, away)
            marked[active[walker], entry] = True
            compared += len(walker)
            low = found.min(axis=1)
            # Of entries that are as near, the lower one.
            first = np.where(found == low[:, None], entries, k).min(axis=1)
            better = (low < near) | ((low == near) & (first < current[active]))
            at[active] += STRIP
            jump = active[better]
            current[jump], best[jump], at[jump] = first[better], low[better], 0
            active = active[better | reach[:, -1]]
        return current, best, compared


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold WALKERS rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n >= WALKERS:
            yield pa.concat_batches(waiting)
            waiting, n = [], 0
    if n:
        yield pa.concat_batches(waiting)


def _numbers(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assign(books: list[np.ndarray]):
    """Codes and errors of batches (row, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Neighbours(b) for b in books]
        for batch in _in_turn(batches):
            rows = np.split(_numbers(batch.column("vector")), len(lists), axis=1)
            found = [n.nearest(r)[:2] for n, r in zip(lists, rows)]
            code = ["".join(f"{int(x):02x}" for x in row) for row in zip(*(c for c, _ in found))]
            error = reduce(np.add, (d for _, d in found))
            yield pa.record_batch([batch.column("row"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    return frugal(run)


def _sums(books: list[np.ndarray]):
    """Each task's number and sum of the parts nearest to each entry: (part, entry, n, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Neighbours(b) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in _in_turn(batches):
            rows = np.split(_numbers(batch.column("vector")), len(lists), axis=1)
            for p, (n, r) in enumerate(zip(lists, rows)):
                entry = n.nearest(r)[0]
                count[p] += np.bincount(entry, minlength=len(count[p]))
                np.add.at(total[p], entry, r)
        used = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
        yield pa.record_batch(
            [
                pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
                pa.array([int(count[p][e]) for p, e in used], pa.int64()), pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return frugal(run)


def train_codebooks(vectors: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after so many rounds over all ``vectors`` (vector): every entry becomes the mean, rounded down, of the parts nearest to it."""
    width = books[0].shape[1] if books else 0
    for _ in range(rounds if width else 0):
        sums = vectors.select("vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        # A row for each entry is left: parts x entries of them reach the driver.
        merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in merged.collect():
            books[r["part"]][r["entry"]] = [x // r["n"] for x in r["sums"]]
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """((row, code, error) of the vectors, the codebooks): every vector as one byte, in hexadecimal, for each part.

    Each part position's codebook starts as that part of the ``entries`` vectors of smallest id (ties by the vector, null ids last) and is trained
    for ``rounds`` over all vectors; entries that nothing is nearest to stay. error is the squared distance to the code's entries, over all parts.
    row holds the columns ``keep``.

    Left out are vectors that are null or empty, hold null, NaN or infinite components, can't be cut into equal parts, or differ
    in length from the vector of smallest id. Components beyond LARGEST / SCALE count as that bound. Rows that repeat are coded
    each. With no vector left there are no codebooks. At most 256 entries; fewer vectors make fewer entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1..256 entries")
    small_batches(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    there = vectors.where(F.coalesce(finite, F.lit(False)) & (F.size(vector_col) > 0)).select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), v.alias("vector"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = there.orderBy(*order).select(F.size("vector").alias("n")).first()
    length = first["n"] if first and first["n"] % parts == 0 else 0
    bound = float(largest(length // parts))
    whole = F.transform("vector", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x * SCALE))).cast("long"))
    ready = written(there.where(F.size("vector") == length).select("row", "id", whole.alias("vector")), "vectors")
    seeds = [r["vector"] for r in ready.orderBy(*order).limit(entries).select("vector").collect()]
    books = [b.copy() for b in np.split(np.array(seeds, dtype=np.int64), parts, axis=1)] if seeds else []
    books = train_codebooks(ready, books, rounds)
    kind = ready.schema["row"].dataType.simpleString()
    if not books:
        return ready.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    return ready.select("row", "vector").mapInArrow(_assign(books), f"row {kind}, code string, error long"), books


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` with label_error, the error summed over equal labels; rows without a label share one sum."""
    sums = codes.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
