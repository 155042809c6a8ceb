"""Chroma audio fingerprints of a media column, and alignment of recordings by them.

A recording becomes frames of energy in the twelve pitch classes. Rectangle filters over the
frames, summed from an integral image, each give two bits; sixteen of them pack into one
32-bit integer a position. Recordings align where their integers agree: equal integers vote for
an offset in a histogram, and the bit errors over the aligned stretch confirm it. Where an integer is in many recordings' positions,
recordings meet by it only where a run of it begins, and only with the two that follow the run, so sustained tones don't bring everything
together; the votes of recordings that have met are then counted over all their integers. ``exact`` has the recordings with such integers meet
in blocks instead, each against each, and misses none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import wordhash as wh
from ledgerline.llm.storage import small_batches, written
from ledgerline.llm.workers import frugal

#: Samples a second, of a frame, and between two frames' starts.
RATE, FRAME, HOP = 5512, 1024, 256
#: Lowest and highest frequency that count, in Hz.
LOW, HIGH = 110.0, 1760.0
#: Frames that the widest filter spans, and the smoothing of each pitch class over time.
SPAN = 16
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Votes for one offset, and the largest part of different bits, of recordings that align.
LEAST_VOTES, MOST_ERRORS = 3, 0.25
#: Positions of all recordings that hold an integer, at most, if it votes by itself.
FREQUENT = 2000
#: Positions of a block of recordings, about, where all are compared; agreeing positions that are listed, and offsets that are counted, at a time.
BLOCK, LISTED, COUNTED = 1 << 17, 1 << 20, 1 << 22
#: Frames whose spectrum is held at a time.
FRAMES = 4096


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, lowest class, classes, frames) of the sixteen filters, by rule: shapes take turns, sizes grow."""
    out = []
    for i in range(16):
        height = 2 + 2 * (i % 3)
        out.append((i % 5, (5 * i) % (13 - height), height, 4 + 4 * (i % 4)))
    return out


def _classes() -> np.ndarray:
    """Pitch class of each bin, 12 for bins that don't count."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    note = np.round(12 * np.log2(np.maximum(hz, 1e-9) / 440.0)).astype(int) % 12
    return np.where((hz >= LOW) & (hz <= HIGH), note, 12)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) of pitch-class energy, smoothed and each of length 1; a silent frame is all zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    window = np.hanning(FRAME).astype(np.float32)
    fold = np.zeros((FRAME // 2 + 1, 13))
    fold[np.arange(len(fold)), _classes()] = 1
    energy = np.empty((n, 12))
    for a in range(0, n, FRAMES):
        power = np.abs(np.fft.rfft(frames[a : a + FRAMES].astype(np.float32) * window, axis=1)) ** 2
        energy[a : a + FRAMES] = (power @ fold)[:, :12]
    padded = np.concatenate([np.repeat(energy[:1], 2, axis=0), energy, np.repeat(energy[-1:], 2, axis=0)])
    smooth = sum(w * padded[i : i + n] for i, w in enumerate(SMOOTH))
    length = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(length > 1e-3 * FRAME, smooth / np.maximum(length, 1e-9), 0)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers, one for each position that a full span follows, and whether its span has sound."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    packed = np.zeros(n, dtype=np.uint32)
    for shape, y, h, w in _filters():
        whole, half, top, third = (0, w, y, y + h), w // 2, y + h // 2, max(1, w // 3)
        if shape == 0:  # later against earlier
            a = area(half, w, y, y + h)
        elif shape == 1:  # upper against lower classes
            a = area(0, w, top, y + h)
        elif shape == 2:  # opposite quarters
            a = area(0, half, y, top) + area(half, w, top, y + h)
        elif shape == 3:  # the middle of the time
            a = 1.5 * area(third, w - third, y, y + h)
        else:  # the class band against all classes
            a = area(0, w, y, y + h)
            whole = (0, w, 0, 12)
        b = area(*whole) - (a / 1.5 if shape == 3 else a)
        ratio = np.log((1e-3 + a) / (1e-3 + b))
        middle = np.log(h / (12 - h)) if shape == 4 else 0.0
        level = (ratio > middle - 0.35).astype(np.uint32) + (ratio > middle) + (ratio > middle + 0.35)
        packed = (packed << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    sound = (image[at + SPAN, 12] - image[at, 12]) > 0
    return packed, sound


def run_keys(codes: np.ndarray) -> np.ndarray:
    """Where a run of equal codes begins, a hash of it and the codes of the two runs after it (0 where there are none); else 0."""
    out = np.zeros(len(codes), dtype=np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
    run = np.concatenate([codes[begins].astype(np.uint64) + np.uint64(1), np.zeros(2, dtype=np.uint64)])
    key = wh.chain(run, 3)
    out[begins] = np.where(key == 0, np.uint64(1), key)
    return out


def fingerprints(media: DataFrame, id_col: str, pcm_col: str = "pcm") -> DataFrame:
    """(id, n_positions, codes array<int>, sounds array<boolean>, runs array<long>) of 16-bit little-endian mono PCM at RATE.

    runs: run_keys() of the codes. Null, empty and too short recordings have no positions. Rows may repeat, ids may be null. Samples
    are 16-bit, so there are no values that aren't numbers. A recording's spectrum is taken in pieces of FRAMES frames.
    """
    kind = media.schema[id_col].dataType.simpleString()
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pcm in batch.column("pcm"):
                raw = pcm.as_py() or b""
                packed, sound = fingerprint(np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2"))
                found.append((packed.view(np.int32), sound, run_keys(packed).view(np.int64)))
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([len(x) for x, _, _ in found], pa.int64()),
                    pa.array([x for x, _, _ in found], pa.list_(pa.int32())),
                    pa.array([x for _, x, _ in found], pa.list_(pa.bool_())),
                    pa.array([x for _, _, x in found], pa.list_(pa.int64())),
                ],
                names=["id", "n_positions", "codes", "sounds", "runs"],
            )

    rows = media.select(F.col(id_col).alias("id"), F.col(pcm_col).alias("pcm"))
    return rows.mapInArrow(frugal(run), f"id {kind}, n_positions long, codes array<int>, sounds array<boolean>, runs array<long>")


def _postings(prints: DataFrame, name: str, frequent: DataFrame) -> DataFrame:
    """(key, name, at) of all positions that vote: by their code, or by their run where the code is frequent."""
    at = F.posexplode(F.arrays_zip("codes", "sounds", "runs"))
    rows = prints.select(F.col("digest").alias(name), at.alias("at", "x")).where("x.sounds").select(F.col("x.codes").alias("code"), F.col("x.runs").alias("run"), name, "at")
    known = rows.join(frequent.select(F.col("code").alias("often")), F.col("code") == F.col("often"), "left")
    # A code's key and a run's lie in ranges of their own.
    key = F.when(F.col("often").isNull(), F.col("code").cast("long")).otherwise(F.col("run"))
    return known.where(F.col("often").isNull() | (F.col("run") != 0)).select(key.alias("key"), F.col("often").isNull().alias("single"), name, "at")


def offset_votes(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(votes, offset) of the offset, position in ``b`` less position in ``a``, at which most integers agree; ties: the smallest."""
    counts = np.zeros(len(a) + len(b), dtype=np.int64)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    each = high - low
    done = 0
    while done < len(a):
        # Some positions of a at a time, so equal integers of a long tone aren't listed at once.
        upto = max(done + 1, done + int(np.searchsorted(np.cumsum(each[done:]), 1 << 20, "right")))
        n = each[done:upto]
        at = np.repeat(np.arange(done, upto), n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[done:upto], n)
        counts += np.bincount(order[place] - at + len(a), minlength=len(counts))
        done = upto
    best = int(counts.argmax()) if len(counts) else 0
    return (int(counts[best]) if len(counts) else 0), best - len(a)


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, r, codes and sounds of both) with the votes of all their integers."""
    for batch in batches:
        found = []
        for qc, qs, rc, rs in zip(*(batch.column(c) for c in ("qc", "qs", "rc", "rs"))):
            (a, x), (b, y) = ((np.array(c.as_py(), dtype=np.int64), np.array(s.as_py(), dtype=bool)) for c, s in ((qc, qs), (rc, rs)))
            # Positions without sound agree with nothing.
            found.append(offset_votes(np.where(x, a, -(1 << 40)), np.where(y, b, 1 << 40)))
        yield pa.record_batch([batch.column("q"), batch.column("r"), pa.array([v for v, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int32())], names=["q", "r", "votes", "offset"])


def _blocks(prints: DataFrame, frequent: DataFrame, name: str) -> DataFrame:
    """(block, h1, h2, codes, sounds: arrays of the block's recordings): recordings that hold a frequent integer, dealt by their digest to blocks of about BLOCK positions."""
    codes = prints.select("digest", F.explode(F.arrays_zip("codes", "sounds")).alias("x")).where("x.sounds").select("digest", F.col("x.codes").alias("code"))
    held = written(prints.join(codes.join(frequent, "code").select("digest").distinct(), "digest", "left_semi"), f"{name}-frequent")
    n = -(-(held.agg(F.sum(F.size("codes"))).first()[0] or 0) // BLOCK) or 1
    lists = [F.collect_list(F.struct("digest.h1", "digest.h2", "codes", "sounds")).alias("x")]
    return held.groupBy(F.pmod(F.col("digest.h1"), F.lit(n)).alias(f"{name}_block")).agg(*lists).select(f"{name}_block", *[F.col(f"x.{c}").alias(f"{name}_{c}") for c in ("h1", "h2", "codes", "sounds")])


def _laid(codes: pa.ListScalar, sounds: pa.ListScalar, silent: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions of a block's recordings one after another, silent ones as ``silent``, and where each recording begins."""
    lists, heard = codes.values, sounds.values
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(heard.flatten().to_numpy(zero_copy_only=False), flat, silent), np.concatenate([[0], sizes.cumsum()])


def block_votes(q: np.ndarray, q_from: np.ndarray, r: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the block's recordings q, votes, offset) that have ``least`` votes at least for their best offset against r; ties: the smallest offset.

    q: (integers in order, their positions in the block); each recording begins at q_from, which has the end too.
    """
    codes, place = q
    sizes = np.diff(q_from)
    # Each recording's offsets, from -size to the size of r.
    begins = np.concatenate([[0], (sizes + len(r)).cumsum()])
    counts = np.zeros(begins[-1], dtype=np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    zero = begins[:-1][of] + sizes[of] - (np.arange(len(of)) - q_from[:-1][of])  # offset of r's position 0 against every position
    low, high = np.searchsorted(codes, r, "left"), np.searchsorted(codes, r, "right")
    each = high - low
    total = np.concatenate([[0], each.cumsum()])
    done = 0
    while done < len(r):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + LISTED, "right")) - 1)
        n = each[done:upto]
        at = np.repeat(np.arange(done, upto), n)
        which = np.arange(len(at)) - np.repeat(total[done:upto] - total[done], n) + np.repeat(low[done:upto], n)
        np.add.at(counts, zero[place[which]] + at, 1)
        done = upto
    most = np.maximum.reduceat(counts, begins[:-1])
    found = np.flatnonzero(most >= least)
    offsets = np.array([int(counts[begins[i] : begins[i + 1]].argmax()) - sizes[i] for i in found], dtype=np.int64)
    return found, most[found], offsets


def _compare_blocks(least: int):
    """Rows (a block of queries, a block of recordings) as (q, r, votes, offset) of those with ``least`` votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for row in range(batch.num_rows):
                flat, q_from = _laid(col["q_codes"][row], col["q_sounds"][row], -(1 << 40))
                stored, r_from = _laid(col["r_codes"][row], col["r_sounds"][row], 1 << 40)
                h = {n: col[n][row].values.to_numpy() for n in ("q_h1", "q_h2", "r_h1", "r_h2")}
                found, which, ordered, longest = [], [], {}, int(np.diff(q_from).max())
                for at, (a, b) in enumerate(zip(r_from, r_from[1:])):
                    # So many queries at a time that their offsets are COUNTED, about.
                    step = 1 << (max(1, min(len(q_from) - 1, COUNTED // int(longest + b - a))).bit_length() - 1)
                    for first in range(0, len(q_from) - 1, step):
                        part = q_from[first : first + step + 1]
                        if (first, step) not in ordered:
                            order = np.argsort(flat[part[0] : part[-1]], kind="stable")
                            ordered[first, step] = flat[part[0] : part[-1]][order], order
                        asks, votes, offset = block_votes(ordered[first, step], part - part[0], stored[a:b], least)
                        found.append((asks + first, votes, offset))
                        which.append(np.full(len(asks), at))
                which = np.concatenate(which)
                asks, votes, offset = (np.concatenate([f[k] for f in found]) for k in range(3))
                pair = lambda n, at: pa.StructArray.from_arrays([pa.array(h[f"{n}_h1"][at]), pa.array(h[f"{n}_h2"][at])], ["h1", "h2"])
                yield pa.record_batch([pair("q", asks), pair("r", which), pa.array(votes), pa.array(offset.astype(np.int32))], names=["q", "r", "votes", "offset"])

    return run


def align(queries: DataFrame, recordings: DataFrame, least_votes: int = LEAST_VOTES, most_errors: float = MOST_ERRORS, exact: bool = False) -> DataFrame:
    """(query, match, offset, votes, n_compared, bit_errors, error_rate) of the recordings that queries align with.

    Both sides are as fingerprints() gives them; they are read several times, so give written tables. ``offset`` is the match's position less the
    query's, of the most votes (ties: the smallest); recordings with fewer than least_votes for it, or
    a larger part of different bits over the common stretch than most_errors, are left out. Recordings
    of equal codes are compared once and share the answer. Positions without sound don't vote. Null ids are left out.

    Every equal integer votes, whatever the table's size. Recordings that have only integers in common that more than FREQUENT positions hold, and
    no run of them with what follows, don't meet and aren't found, unless ``exact`` asks for all: then recordings that hold such integers are
    compared in blocks, each block of queries with each block of recordings in a task, and every pair that meets the thresholds is found.
    """
    key = F.struct(F.xxhash64("codes", "sounds").alias("h1"), F.xxhash64(F.lit(1), "codes", "sounds").alias("h2"))
    some = lambda df: df.where("id is not null and n_positions > 0").withColumn("digest", key)
    q, r = some(queries), some(recordings)
    one = lambda df: df.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("codes", "sounds", "runs")])
    q_classes, classes = written(one(q), "asked"), written(one(r), "prints")
    counts = classes.select(F.explode(F.arrays_zip("codes", "sounds")).alias("x")).where("x.sounds").groupBy(F.col("x.codes").alias("code")).agg(F.count("*").alias("n"))
    frequent = written(counts.where(F.col("n") > FREQUENT), "frequent-codes")
    q_side = q_classes.select(F.col("digest").alias("q"), F.col("codes").alias("qc"), F.col("sounds").alias("qs"))
    r_side = classes.select(F.col("digest").alias("r"), F.col("codes").alias("rc"), F.col("sounds").alias("rs"))
    met = _postings(q_classes, "q", frequent).withColumnRenamed("at", "q_at").join(_postings(classes, "r", frequent), ["key", "single"])
    kind = "struct<h1:bigint,h2:bigint>"
    none = frequent.isEmpty()
    if none or exact:
        votes = met.where("single").groupBy("q", "r", (F.col("at") - F.col("q_at")).alias("offset")).count()
        counted = votes.select("q", "r", F.col("count").alias("votes"), (-F.col("offset")).alias("minus"))
        if not none:
            # Of a pair that comes both ways, the blocks have all votes.
            both = _blocks(q_classes, frequent, "q").crossJoin(_blocks(classes, frequent, "r"))
            dealt = both.repartition(F.xxhash64("q_block", "r_block"))
            compared = dealt.mapInArrow(frugal(_compare_blocks(least_votes)), f"q {kind}, r {kind}, votes long, offset int")
            counted = counted.unionByName(compared.select("q", "r", "votes", (-F.col("offset")).alias("minus")))
        best = counted.groupBy("q", "r").agg(F.max(F.struct("votes", "minus")).alias("best"))
        best = best.select("q", "r", "best.votes", (-F.col("best.minus")).alias("offset"))
    else:
        both = met.select("q", "r").distinct().join(q_side, "q").join(r_side, "r")
        best = both.mapInArrow(frugal(_recount), f"q {kind}, r {kind}, votes long, offset int")
    best = best.where(F.col("votes") >= least_votes)
    pairs = best.join(q_side.drop("qs"), "q").join(r_side.drop("rs"), "r")
    q_from, r_from = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    n = F.least(F.size("qc") - q_from, F.size("rc") - r_from)
    cut = pairs.select("q", "r", "offset", "votes", n.alias("n"), F.slice("qc", q_from + 1, n).alias("a"), F.slice("rc", r_from + 1, n).alias("b"))
    wrong = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0).cast("long"), lambda s, x: s + x)
    judged = cut.select("q", "r", "offset", "votes", F.col("n").cast("long").alias("n_compared"), wrong.alias("bit_errors"))
    judged = judged.withColumn("error_rate", F.col("bit_errors") / (32 * F.col("n_compared"))).where(F.col("error_rate") <= most_errors)
    named = judged.join(q.select(F.col("id").alias("query"), F.col("digest").alias("q")), "q").join(r.select(F.col("id").alias("match"), F.col("digest").alias("r")), "r")
    return named.select("query", "match", F.col("offset").cast("long").alias("offset"), F.col("votes").cast("long").alias("votes"), "n_compared", "bit_errors", "error_rate")


def best_match(aligned: DataFrame) -> DataFrame:
    """The match of the fewest errors of each query (ties: the smallest id), and how many it had."""
    row = F.struct("error_rate", "match", "offset", "votes", "n_compared", "bit_errors")
    best = aligned.groupBy("query").agg(F.min(row).alias("best"), F.count("*").alias("n_matches"))
    return best.select("query", "best.match", "best.offset", "best.votes", "best.n_compared", "best.bit_errors", "best.error_rate", "n_matches")


#: Samples of a melody's note.
NOTE = 512


def melodies(vectors: DataFrame, id_col: str, vector_col: str, first: int = 0, last: int | None = None, noise: float = 0.0) -> DataFrame:
    """(id, pcm): vectors as recordings, one note for each component; a part of the notes and noise on demand.

    A component sets the pitch of its note among two octaves; a null one, one that isn't a number or is infinite counts as 0. Null vectors
    give null recordings, empty ones empty recordings. Rows may repeat and ids may be null.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(NOTE) / RATE
        tones = np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(24)[:, None] / 12) * t)
        for batch in batches:
            ids = batch.column("id")
            for a in range(0, batch.num_rows, 64):
                out = []
                for i, vector in zip(ids[a : a + 64].to_pylist(), batch.column("v")[a : a + 64].to_pylist()):
                    if vector is None:
                        out.append(None)
                        continue
                    values = np.nan_to_num(np.array([x or 0.0 for x in vector], dtype=np.float64), posinf=0.0, neginf=0.0)
                    notes = np.floor(values * 64).astype(np.int64) % 24
                    wave = tones[notes[first:last]].reshape(-1)
                    if noise:
                        wave = wave + noise * np.random.default_rng(zlib.crc32(str(i).encode())).standard_normal(len(wave))
                    out.append((np.clip(wave, -1.5, 1.5) * 16000).astype("<i2").tobytes())
                yield pa.record_batch([ids[a : a + 64], pa.array(out, pa.binary())], names=["id", "pcm"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(frugal(run), f"id {kind}, pcm binary")
