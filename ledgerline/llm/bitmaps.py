"""Bitmaps of hashed values: built piece by piece in tasks, of a size that is bounded whatever the table holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a bitmap is built in, and its least and largest size in bits (powers of two).
PIECE_BITS, LEAST_BITS, MOST_BITS = 4, 10, 28
#: Bits for each listed value (a power of two), where the largest size allows it.
ROOM = 3


def bits_for(n: int) -> int:
    """Size of a bitmap (a power of two) for n values."""
    return min(MOST_BITS, max(LEAST_BITS, max(1, n).bit_length() + ROOM))


def _piece(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        width = 1 << (bits - PIECE_BITS)
        for batch in batches:
            at = batch.column("at").to_numpy()
            of = at // width
            for piece in np.unique(of).tolist():
                flags = pieces.setdefault(piece, np.zeros(width, dtype=bool))
                flags[at[of == piece] - piece * width] = True
        if pieces:
            yield pa.record_batch([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in pieces.values()], pa.binary())], names=["piece", "flags"])

    return run


def bitmap(hashes: DataFrame, column: str, bits: int) -> bytes:
    """2**bits flags, set at the low bits of the values of a long ``column``; 2**MOST_BITS flags at most reach the driver."""
    at = hashes.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    dealt = at.withColumn("piece", F.shiftright("at", bits - PIECE_BITS)).repartition(1 << PIECE_BITS, "piece").select("at")
    found = {r["piece"]: bytes(r["flags"]) for r in dealt.mapInArrow(_piece(bits), "piece long, flags binary").collect()}
    empty = bytes(1 << (bits - PIECE_BITS - 3))
    return b"".join(found.get(i, empty) for i in range(1 << PIECE_BITS))


def listed(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the flag of each value is set; flags are a bitmap's bytes."""
    at = values.view(np.uint64) & np.uint64(len(flags) * 8 - 1)
    return (flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
