"""Removal of passages that an earlier document holds, with a count-min prefilter."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hot import later_in_group
from ._text import SPACE, Chunk, Words, blobs, chunks, long_windows, mix, windows

#: Words of the anchors by which windows are counted; cells for each anchor expected; anchors of a block of cells; entries gathered before they are sent.
ANCHOR, CELLS, BLOCK, FLUSH = 8, 512, 1 << 19, 1 << 19
_U = np.uint64


class Anchored:
    """A chunk's windows: `at` first words, `row`, and `anchor`, the least hash of ANCHOR consecutive words inside, which equal windows share."""

    def __init__(self, c: Chunk, width: int) -> None:
        self.w = w = Words(c)
        n = len(w.h)
        row = np.repeat(np.arange(c.n), w.count)
        left = w.first[1:][row] - np.arange(n)
        self.at = np.flatnonzero(left >= width)
        self.row = row[self.at]
        a = min(ANCHOR, width)
        low = windows(w.h, a, 11)
        span, done = width - a + 1, 1
        while done < span:  # least of `done` consecutive values, doubled until it covers a window
            step = min(done, span - done)
            low[: n - step] = np.minimum(low[: n - step], low[step:])
            done += step
        self.anchor = low[self.at]

    def per_row(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows' distinct anchors, and their rows; runs of one anchor count once."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        return self.anchor[new], self.row[new]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin that are alike in all keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _packed(key: np.ndarray, n_keys: int, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """(key, the columns' values one after the other) for each key."""
    return [(k, b"".join(x[i].tobytes() for x in columns)) for k, i in blobs(key.astype(np.int64), n_keys)]


def _unpacked(data: pa.ChunkedArray, *types: type) -> list[np.ndarray]:
    """The columns of packed rows, put together again."""
    size = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for x in data:
        buf = x.as_buffer()
        n, at = buf.size // size, 0
        for column, t in zip(out, types):
            column.append(np.frombuffer(buf, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types)]


def _table(rows: list[tuple[int, bytes]], key: str) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=[key, "data"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans (first word and word after the last, removed) for each row.

    Words are runs of other characters than space and 9 to 13, unchanged. A word is removed if a window of `width` words of its text covers
    it whose words also start, in a row with a smaller id, a window. All windows are judged on the input. Null, empty and shorter texts
    lose nothing; of equal texts the smallest id stays as it is judged; rows that repeat an id, with whatever texts, are judged one by one and
    lose nothing to each other. A row with a null id has no order: it loses nothing and takes nothing. Other columns are ignored.

    1. Of rows with equal texts all but those of the smallest id go whole; nothing else is asked of them.
    2. Each partition sketches its texts' anchors: of a window, the least hash of eight consecutive words inside. Equal windows have equal
       anchors. The sketch has one row of CELLS cells for each anchor expected, so its load is the same at every size, and a cell counts different
       texts. It is kept sparse and merged by block of cells, on the executors; a merged cell never holds too few texts. A text that shares
       a cell with another one in its own partition needs no merging, so a cell has few entries a partition, however common its passage.
    3. Windows whose cell is estimated to hold two texts or more are grouped by their hash, exactly; the smallest id of each owns it. Of
       the texts of a partition only the one with the smallest id is held against other partitions'.
    4. Runs of windows with another owner are joined to their rows by id and text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("name"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    size, n_rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    anchors = 1 + (size or 0) / 6 * 2 / 43
    bits = int(np.ceil(np.log2(anchors * CELLS)))
    blocks = max(4, int(np.ceil(np.log2(1 + anchors / BLOCK))))
    parts = max(4, int(np.ceil(np.log2(1 + (size or 0) / 12 / (1 << 20)))))

    def part_of(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(doc.view(_U)) + name.view(_U)) >> _U(64 - parts)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            cell, name, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, name, cell))
            order = order[_firsts(cell[order], name[order])]  # a text once a cell, with its smallest id
            cell, name, doc = cell[order], name[order], doc[order]
            first = _firsts(cell)
            many = np.diff(np.append(np.flatnonzero(first), len(cell))) > 1
            sure = many[np.cumsum(first) - 1]
            out = _packed(cell[first] >> _U(bits - blocks), 1 << blocks, cell[first], name[first], doc[first], many)
            out += [(-1 - k, x) for k, x in _packed(part_of(doc[sure], name[sure]), 1 << parts, cell[sure], name[sure], doc[sure])]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "data"])

        for batch in batches:
            doc, name = (batch[k].to_numpy(zero_copy_only=False) for k in ("doc_id", "name"))
            for c in chunks(batch["text"]):
                anchor, row = Anchored(c, width).per_row()
                if len(anchor):
                    held.append((anchor >> _U(64 - bits), name[c.lo + row], doc[c.lo + row]))
                    size += len(anchor)
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        """For each part: the texts, with their smallest ids, of the block's cells that hold two or more."""
        block = key[0].as_py()
        if block < 0:
            return _table([(-1 - block, x.as_py()) for x in t["data"]], "part")
        cell, name, doc, many = _unpacked(t["data"], np.uint64, np.int64, np.int64, np.bool_)
        order = np.lexsort((doc, name, cell))
        cell, name, doc, many = cell[order], name[order], doc[order], many[order]
        own = np.cumsum(_firsts(cell)) - 1
        several = np.bincount(own, many, minlength=1) > 0
        keep = _firsts(cell, name)
        several |= np.bincount(own, keep, minlength=1) > 1
        keep &= several[own]
        cell, name, doc = cell[keep], name[keep], doc[keep]
        return _table(_packed(part_of(doc, name), 1 << parts, cell, name, doc), "part")

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        cell, name, doc = _unpacked(t["data"], np.uint64, np.int64, np.int64)
        order = np.lexsort((cell, name, doc))
        cell, name, doc = cell[order], name[order], doc[order]
        at = np.flatnonzero(_firsts(doc, name))
        ends = np.append(at[1:], len(doc))
        return pa.Table.from_arrays([pa.array(doc[at], pa.int64()), pa.array(name[at], pa.int64()), pa.array([np.unique(cell[i:j]).tobytes() for i, j in zip(at.tolist(), ends.tolist())], pa.binary())], names=["doc_id", "name", "cells"])

    copies = later_in_group(known.select("doc_id", "name"), "name", "doc_id", n_rows)
    shared = known.mapInArrow(sketch, "block int, data binary").groupBy("block").applyInArrow(merge, "part int, data binary").groupBy("part").applyInArrow(gather, "doc_id long, name long, cells binary")
    shared = shared.join(copies, ["doc_id", "name"], "left_anti")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send() -> pa.RecordBatch:
            h, at, doc, name = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, h))
            h, at, doc, name = h[order], at[order], doc[order], name[order]
            first = _firsts(h)
            lost = doc > doc[first][np.cumsum(first) - 1]
            out = _packed(h[~lost] >> _U(64 - parts), 1 << parts, h[~lost], doc[~lost], name[~lost], at[~lost])
            out += [(-1 - k, x) for k, x in _packed(part_of(doc[lost], name[lost]), 1 << parts, doc[lost], name[lost], at[lost])]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "data"])

        for batch in batches:
            doc, name, cells = (batch[k].to_numpy(zero_copy_only=False) for k in ("doc_id", "name", "cells"))
            for c in chunks(batch["text"]):
                a = Anchored(c, width)
                cell, h = a.anchor >> _U(64 - bits), long_windows(a.w.h, width, 23)
                cut = np.searchsorted(a.row, np.arange(c.n + 1))
                for r in range(c.n):
                    lo, hi = int(cut[r]), int(cut[r + 1])
                    at = a.at[lo:hi][np.isin(cell[lo:hi], np.frombuffer(cells[c.lo + r], _U))]
                    n = len(at)
                    held.append((h[at], (at - int(a.w.first[r])).astype(np.uint32), np.full(n, doc[c.lo + r]), np.full(n, name[c.lo + r])))
                    size += n
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def owned(key: tuple, t: pa.Table) -> pa.Table:
        """For each part: the windows of a block that a smaller id owns."""
        block = key[0].as_py()
        if block < 0:
            return _table([(-1 - block, x.as_py()) for x in t["data"]], "part")
        h, doc, name, at = _unpacked(t["data"], np.uint64, np.int64, np.int64, np.uint32)
        order = np.lexsort((doc, h))
        h, doc, name, at = h[order], doc[order], name[order], at[order]
        first = _firsts(h)
        lost = doc > doc[first][np.cumsum(first) - 1]
        doc, name, at = doc[lost], name[lost], at[lost]
        return _table(_packed(part_of(doc, name), 1 << parts, doc, name, at), "part")

    def spans(key: tuple, t: pa.Table) -> pa.Table:
        """For each text of a part: the runs of its lost windows, first word and word after the last of each."""
        doc, name, at = _unpacked(t["data"], np.int64, np.int64, np.uint32)
        at = at.astype(np.int64)
        order = np.lexsort((at, name, doc))
        doc, name, at = doc[order], name[order], at[order]
        new = _firsts(doc, name)
        new[1:] |= at[1:] - at[:-1] > width
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(doc)) - 1
        first = np.flatnonzero(_firsts(doc[begin], name[begin]))
        runs = np.stack([at[begin], at[end] + width], axis=1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.append(2 * first, len(runs)), pa.int32()), pa.array(runs, pa.int64()))
        return pa.Table.from_arrays([pa.array(doc[begin][first], pa.int64()), pa.array(name[begin][first], pa.int64()), lists], names=["doc_id", "name", "spans"])

    lost = known.join(shared, ["doc_id", "name"]).mapInArrow(send_windows, "block int, data binary").groupBy("block").applyInArrow(owned, "part int, data binary")
    lost = lost.groupBy("part").applyInArrow(spans, "doc_id long, name long, spans array<long>")
    marks = lost.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "name", F.lit(None).cast("array<long>").alias("spans"), F.lit(True).alias("copy")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: [] for k in ("n_words", "n_removed", "kept_text", "spans")}
            spans, copy = batch["spans"], batch["copy"].to_pylist()
            for c in chunks(batch["text"]):
                for row in kept(c, [spans[c.lo + i].as_py() for i in range(c.n)], copy[c.lo : c.lo + c.n], width):
                    for k, x in zip(cols, row):
                        cols[k].append(x)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_removed"], pa.int64()), pa.array(cols["kept_text"], pa.string()), pa.array(cols["spans"], pa.list_(pa.int64()))], names=["doc_id", *cols])

    judged = known.join(marks, ["doc_id", "name"], "left").unionByName(docs.where("doc_id is null"), allowMissingColumns=True)
    return judged.select("doc_id", "text", "spans", "copy").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string, spans array<long>")


def kept(c: Chunk, spans: list[list[int] | None], copy: list[bool | None], width: int = 50) -> Iterator[tuple[int, int, str, list[int]]]:
    """Of each row: words, words removed, the kept words joined by a space, the spans. A copy of at least `width` words goes whole."""
    w = Words(c, hashes=False)
    drop = np.zeros(len(w.start), bool)
    for i in range(c.n):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        if copy[i] and hi - lo >= width:
            spans[i] = [0, hi - lo]
        for a, b in zip((spans[i] or [])[::2], (spans[i] or [])[1::2]):
            drop[lo + a : min(hi, lo + b)] = True
    # a kept word's bytes, and a space after it
    take = np.zeros(len(c.buf) + 1, np.int8)
    np.add.at(take, w.start[~drop], 1)
    np.add.at(take, w.end[~drop], -1)
    take = np.cumsum(take, dtype=np.int8).astype(bool)[:-1]
    after = w.end[~drop]
    after = np.setdiff1d(after[after < len(c.buf)], c.off)  # a row's first byte is not after a word of its own
    after = after[SPACE[c.buf[after]]]
    take[after] = True
    buf = np.where(SPACE[c.buf], np.uint8(0x20), c.buf)
    removed = np.add.reduceat(np.append(drop, False).astype(np.int64), w.first[:-1]) if len(drop) else np.zeros(c.n, np.int64)
    removed[w.count == 0] = 0
    for i in range(c.n):
        lo, hi = c.off[i], c.off[i + 1]
        yield int(w.count[i]), int(removed[i]), buf[lo:hi][take[lo:hi]].tobytes().rstrip(b" ").decode(), spans[i] or []
