"""One-row count-min sketches: each partition's cells, merged block by block."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
SCHEMA = "block int, part int, cells binary"
_ARROW = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])


def rows(cells: np.ndarray, part: int) -> pa.RecordBatch:
    """A partition's counts, at most 255 a cell, as rows of sparse blocks; empty blocks have none."""
    out = [(b, part, _pack(x)) for b, x in enumerate(cells.reshape(-1, BLOCK)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else ([], [], []), _ARROW)], schema=_ARROW)


class Sparse:
    """A partition's counts by cell, kept sorted: its memory follows the partition's distinct cells, not the sketch's width."""

    def __init__(self, held: int = 1 << 21) -> None:
        self.at, self.n, self.new, self.size, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, held

    def add(self, cells: np.ndarray) -> None:
        self.new.append(cells.astype(np.int64))
        self.size += len(cells)
        if self.size >= self.held:
            self._fold()

    def _fold(self) -> None:
        at, own = np.unique(np.concatenate([self.at, *self.new]), return_inverse=True)
        self.n = np.minimum(255, np.bincount(own, np.concatenate([self.n, np.ones(self.size)]), minlength=len(at))).astype(np.int64)
        self.at, self.new, self.size = at, [], 0

    def rows(self, part: int) -> pa.RecordBatch:
        self._fold()
        block = self.at // BLOCK
        begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        out = []
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(block)).tolist()):
            off, n = (self.at[lo:hi] % BLOCK).astype(np.uint16), self.n[lo:hi].astype(np.uint8)
            if 3 * (hi - lo) >= BLOCK:
                dense = np.zeros(BLOCK, np.uint8)
                dense[off] = n
                out.append((int(block[lo]), part, dense.tobytes()))
            else:
                out.append((int(block[lo]), part, off.tobytes() + n.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else ([], [], []), _ARROW)], schema=_ARROW)


def _pack(x: np.ndarray) -> bytes:
    at = np.flatnonzero(x)
    if len(at) * 3 >= BLOCK:
        return x.tobytes()
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def _add(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == BLOCK:
        total += np.frombuffer(packed, np.uint8)
    else:
        n = len(packed) // 3
        total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint8, n, 2 * n)


def merged(sketches: DataFrame, width: int, kind: str, fan: int = 32) -> np.ndarray:
    """The sum of all partitions' sketches, on the driver: `width` bytes or bits, whatever the input's size.

    kind "log": a byte for each cell, 0 up to 4 times the mean of all cells, then one more for each doubling.
    kind "repeated": a bit for each cell, set from 2 on.
    Two steps with at most `fan` partial sums a block in the second, so no task holds all partitions' blocks.
    """

    def add(key: tuple, batches: Iterator[pa.RecordBatch] | pa.Table, last: bool) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in batches["cells"]:
            _add(total, x.as_py())
        if last:
            out = np.packbits(total >= 2).tobytes() if kind == "repeated" else np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()
        else:
            # a saturated partial sum is still at least 2, and stays large
            out = _pack(np.minimum(total, 255).astype(np.uint8)) if kind == "repeated" else _wide(total)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([out], pa.binary())], schema=_ARROW)

    def first(key: tuple, t: pa.Table) -> pa.Table:
        return add(key, t, False)

    def second(key: tuple, t: pa.Table) -> pa.Table:
        return add(key, t, True) if kind == "repeated" else _sum_wide(key, t)

    def _wide(total: np.ndarray) -> bytes:
        return np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()

    def _sum_wide(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in t["cells"])
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([_wide(total)], pa.binary())], schema=_ARROW)

    partial = sketches.groupBy("block", (F.col("part") % fan).alias("fan")).applyInArrow(first, SCHEMA)
    got = partial.groupBy("block").applyInArrow(second, SCHEMA).select("block", "cells").collect()
    if kind == "repeated":
        out = np.zeros(width // 8, np.uint8)
        for r in got:
            out[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.cells, np.uint8)
        return out
    counts = np.zeros(width, np.uint32)
    for r in got:
        counts[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.cells, np.uint32)
    base = 4 * max(1.0, counts.mean())
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / base))).astype(np.uint8)
