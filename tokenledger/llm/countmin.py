"""A count-min sketch of 64-bit hashes over a whole table, reduced to the question whether a count may reach a limit.

Tasks count the cells of their own rows and pass on the cells they have met, so what crosses the network grows with a
task's different hashes and not with the width. Cells are merged chunk by chunk, and a cell ends as one bit: has it the
limit or not. The bits are bounded by MOST_CELLS / 8 bytes for each row of the sketch, and they are what is broadcast.

A hash that occurs `limit` times or more always has its bits set. Others have them only if they share all their cells, so
the answer "no" is a proof, and a table that outgrows the widest sketch gets more needless answers "maybe", never a wrong "no".
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that are merged together; a cell is known by 16 bits inside.
CHUNK = 1 << 16
LEAST_CELLS, MOST_CELLS = CHUNK, 1 << 28
#: Different cells that a task holds before it passes them on.
HELD = 1 << 21
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def width_for(expected: int) -> int:
    """Cells of a row for so many counted hashes: a power of two, about one in four of them, within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, expected // 4 - 1).bit_length()))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    h = hashes * np.uint64(SALTS[row])
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


class Sketch:
    """Which cells have the limit."""

    def __init__(self, bits: np.ndarray, width: int, depth: int) -> None:
        self.bits, self.width, self.depth = bits, width, depth

    def may_reach(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(self.depth):
            at = cells(hashes, row, self.width) + row * self.width
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def sketch(rows: DataFrame, find: Callable[[pa.RecordBatch], Iterable[np.ndarray]], limit: int, width: int, depth: int = 1) -> Sketch:
    """Counts the hashes that `find` gives, in arrays, for the batches of `rows`, each of them as often as it is given."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for hashes, row in ((hashes, row) for hashes in find(batch) for row in range(depth)):
                new, n = np.unique(cells(hashes, row, width) + row * width, return_counts=True)
                both = np.concatenate([met, new])
                met, back = np.unique(both, return_inverse=True)
                times = np.bincount(back, np.concatenate([times, n]), len(met)).astype(np.int64)
                if len(met) > HELD:
                    yield from passed(met, times)
                    met, times = met[:0], times[:0]
        yield from passed(met, times)

    def passed(met: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(met):
            return
        chunk, inner, n = met // CHUNK, (met % CHUNK).astype("<u2"), np.minimum(times, limit).astype("<u2")
        first = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
        for some in range(0, len(first) - 1, 256):
            edges = first[some : some + 257]
            packed = [[x[a:b].tobytes() for a, b in zip(edges, edges[1:])] for x in (inner, n)]
            columns = [pa.array(chunk[edges[:-1]]), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "cells", "times"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(CHUNK, np.int64)

        def done() -> pa.RecordBatch:
            bits = np.packbits(sums >= limit, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, inner, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, sums[:] = chunk, 0
                sums[np.frombuffer(inner, "<u2")] += np.frombuffer(n, "<u2")
        if now is not None:
            yield done()

    if limit >= 1 << 16:
        raise ValueError("the limit must fit in 16 bits")
    parts = rows.mapInArrow(count, "chunk long, cells binary, times binary")
    merged = parts.repartition(F.col("chunk")).sortWithinPartitions("chunk").mapInArrow(merge, "chunk long, bits binary")
    bits = np.zeros(width * depth // 8, np.uint8)
    for row in merged.collect():  # width * depth / 8 bytes at most
        bits[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return Sketch(bits, width, depth)
