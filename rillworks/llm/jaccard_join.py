"""N-gram Jaccard join by a blocked product of the document by n-gram matrix with its transpose."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _sketch
from ._components import components
from ._scratch import stored
from ._text import Chunk, Words, blobs, chunks, lanes, mix, table, windows

#: Cells of the sketch that orders n-grams, bits of the filter of surviving sets, rows of a block of the product.
SKETCH, FILTER, ROWS = 1 << 22, 1 << 24, 2048
#: Postings in a block of n-grams, and postings gathered before they are sent.
POSTINGS, FLUSH = 1 << 20, 1 << 19
#: Sets of a large block that each of its parts is told of.
SHARED = 16
_U = np.uint64


def sets(c: Chunk, width: int) -> list[np.ndarray]:
    """Each row's sorted set of hashed n-grams."""
    w = Words(c, lower=True)
    grams = windows(w.h, width, 5)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix((w.h[a:b] * lanes(5, width)[: b - a]).sum(keepdims=True) + table(b - a, 1)))
        else:
            out.append(w.h[:0])
    return out


def sign(s: np.ndarray) -> int:
    """A set's signature, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int((mix(s + _U(0x5851F42D4C957F2D)).sum() + _U(len(s))).astype(np.int64)) if len(s) else 0


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _shared(n: int) -> int:
    """How many n-grams of their prefixes two linked sets share at least: a fifth of the smaller set's size."""
    return max(1, n // 5)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest id that links reach.

    Words are runs of other characters than space and 9 to 13, A to Z in lower case; a row's set is its distinct runs of `width` words, or
    its whole sequence if that is shorter. Two rows link if the intersection has at least `percent` % of the union's size. Null and empty
    texts have the empty set and link with nothing: their component is their own id. Repeated rows stay and equal ids share a component if
    their texts link. Other columns are ignored.

    1. Equal sets become one class. A sketch over all rows' n-grams orders them: rare ones first.
    2. A set of n sends its first n-grams in that order, so many that two linked sets share at least a fifth of the smaller one. Blocks of
       n-grams, dealt by hash, hold columns of the incidence matrix; each column is cut where sizes differ by more than the limit allows.
       A set whose overlaps summed over the blocks stay below its bound is discarded; so are its least columns below two fifths of it,
       as any link still leaves the two sets a common column.
    3. Sets whose columns have the same first set form a block of rows. A block's product gives exact overlaps, row by row, for all rows but
       those already joined to the first component found: pairs inside a component decide nothing. A large block is dealt into parts, each
       with the same few of its sets, which join its near copies; only sets that are still apart from the block's largest component then
       meet all parts, so a block of n near copies costs n rows, and one of n sets that don't link costs all pairs of parts.
    4. Components of the links of all blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, none = np.zeros(SKETCH, np.uint8), [None] * 3
        for batch in batches:
            n, sig = [], []
            for c in chunks(batch["text"]):
                found = sets(c, width)
                n += map(len, found)
                sig += map(sign, found)
                at, k = np.unique(np.concatenate(found) >> _U(42), return_counts=True)
                cells[at] = np.minimum(cells[at] + k, 255)
            m = len(n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(sig, pa.int64()), *(pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "n", "sig", "block", "part", "cells"])
        s = _sketch.rows(cells, TaskContext.get().partitionId())
        m = s.num_rows
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(3)), *s.columns], names=["doc_id", "n", "sig", "block", "part", "cells"])

    both = stored(docs.mapInArrow(first_pass, "doc_id long, n long, sig long, block int, part int, cells binary"), "shingles")
    rows = both.where("block is null").select("doc_id", "n", "sig")
    rank = spark.sparkContext.broadcast(_sketch.merged(both.where("block is not null").select("block", "part", "cells"), SKETCH, "log"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(1 + total * 0.4 / POSTINGS))))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def send() -> pa.RecordBatch:
            sig, n = (np.array(x, t) for x, t in zip(zip(*held), (np.int64, np.uint32)))
            grams, row = np.concatenate(list(held.values())), np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held.values()])
            out = []
            low = ((grams << _U(bits)) >> _U(32)).astype(np.uint32)
            for k, at in blobs((grams >> _U(64 - bits)).astype(np.int64), 1 << bits):
                own, pos = np.unique(row[at], return_inverse=True)
                out.append((k, len(own), sig[own].tobytes() + n[own].tobytes() + low[at].tobytes() + pos.astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["block", "n", "data"])

        for batch in batches:
            for c in chunks(batch["text"]):
                for s in sets(c, width):
                    if len(s) and (key := (sign(s), len(s))) not in held:
                        m = min(len(s), len(s) - _least(len(s), percent) + _shared(len(s)))
                        order = rank.value[s >> _U(42)]
                        held[key] = s[np.argsort(order, kind="stable")[:m]] if order.any() else s[:m]
                        size += m
                if size >= FLUSH:
                    yield send()
                    held, size = {}, 0
        if held:
            yield send()

    def columns(key: tuple, t: pa.Table) -> pa.Table:
        """For each set of a block: its columns' first sets, and how many columns each stands for."""
        sig, n, low = [], [], []
        for k, data in zip(t["n"].to_pylist(), t["data"]):
            data = data.as_buffer()
            m = (data.size - 12 * k) // 8
            pos = np.frombuffer(data, np.uint32, m, 12 * k + 4 * m)
            sig.append(np.frombuffer(data, np.int64, k)[pos])
            n.append(np.frombuffer(data, np.uint32, k, 8 * k)[pos])
            low.append(np.frombuffer(data, np.uint32, m, 12 * k))
        sig, n, low = map(np.concatenate, (sig, n, low))
        order = np.lexsort((sig, n, low))
        sig, n, low = sig[order], n[order].astype(np.int64), low[order]
        again = np.zeros(len(sig), bool)
        again[1:] = (low[1:] == low[:-1]) & (sig[1:] == sig[:-1]) & (n[1:] == n[:-1])
        sig, n, low = sig[~again], n[~again], low[~again]
        cut = np.ones(len(sig), bool)
        cut[1:] = (low[1:] != low[:-1]) | (100 * n[:-1] < percent * n[1:])
        begin = np.flatnonzero(cut)
        long = np.diff(np.append(begin, len(sig)))
        run = np.repeat(np.arange(len(begin)), long)
        hub = np.minimum.reduceat(sig, begin)[run] if len(begin) else sig
        keep = long[run] > 1
        sig, n, hub = sig[keep], n[keep], hub[keep]
        order = np.lexsort((hub, sig, n))
        sig, n, hub = sig[order], n[order], hub[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (n[1:] != n[:-1]) | (hub[1:] != hub[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(sig)))
        sig, n, hub = sig[at], n[at], hub[at]
        out = [(k, b"".join(x[i].tobytes() for x in (sig, n, hub, count))) for k, i in blobs((mix(sig.view(_U)) >> _U(64 - bits)).astype(np.int64), 1 << bits)]
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "data"])

    def survivors(key: tuple, t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in t["data"]]
        sig, n, hub, count = np.concatenate(parts, axis=1)
        order = np.lexsort((hub, sig, n))
        sig, n, hub, count = sig[order], n[order], hub[order], count[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (n[1:] != n[:-1]) | (hub[1:] != hub[:-1])
        at = np.flatnonzero(new)
        sig, n, hub, count = sig[at], n[at], hub[at], np.add.reduceat(count, at)
        order = np.lexsort((count, sig, n))
        sig, n, hub, count = sig[order], n[order], hub[order], count[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
        at = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        upto = np.cumsum(count)
        upto -= np.append(0, upto)[at][own]
        least = np.maximum(1, n // 5)
        keep = (np.add.reduceat(count, at)[own] >= least) & (5 * upto >= 2 * least)
        return pa.Table.from_arrays([pa.array(x[keep], pa.int64()) for x in (sig, n, hub)], names=["sig", "n", "hub"])

    member = stored(
        docs.mapInArrow(postings, "block int, n int, data binary").groupBy("block").applyInArrow(columns, "part int, data binary")
        .groupBy("part").applyInArrow(survivors, "sig long, n long, hub long"), "columns")
    # a column of which one set alone survived links nothing
    member = member.join(member.groupBy("hub").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "hub")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(FILTER, np.uint8)
        for batch in batches:
            cells[mix(batch["sig"].to_numpy().view(_U)) >> _U(40)] = 2
        yield _sketch.rows(cells, TaskContext.get().partitionId())

    marked = spark.sparkContext.broadcast(_sketch.merged(member.select("sig").mapInArrow(mark, _sketch.SCHEMA), FILTER, "repeated"))

    def kept_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for c in chunks(batch["text"]):
                for s in sets(c, width):
                    if len(s) and (key := (sign(s), len(s))) not in seen:
                        at = int(mix(np.array([key[0]], np.int64).view(_U))[0] >> _U(40))
                        if marked.value[at >> 3] >> (7 - (at & 7)) & 1:
                            seen.add(key)
                            out.append((*key, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["sig", "n", "grams"])

    parts = F.ceil(F.col("n_rows") / ROWS).cast("int")
    member = member.select("sig", "n", "hub", parts.alias("parts"), F.pmod(F.xxhash64("sig", "n"), parts).cast("int").alias("i"))
    large = member.where("parts > 1")
    low = F.row_number().over(W.partitionBy("hub").orderBy(F.xxhash64("sig", "n"), "sig", "n"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")
    few = large.withColumn("low", low).where(F.col("low") <= SHARED).select("sig", "n", "hub", "parts", every)

    def product(key: tuple, t: pa.Table) -> pa.Table:
        u, v = links(t["sig"].to_numpy(), t["n"].to_numpy(), [np.frombuffer(x.as_buffer(), _U) for x in t["grams"]], percent, t["done"].to_numpy())
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def joined(dealt: DataFrame) -> DataFrame:
        """u, v: links inside each block of dealt (sig, n, hub, i, j, done)."""
        return docs.mapInArrow(kept_sets, "sig long, n long, grams binary").join(dealt, ["sig", "n"]).groupBy("hub", "i", "j").applyInArrow(product, "u long, v long")

    roots = stored(components(joined(member.unionByName(few).select("sig", "n", "hub", "i", F.lit(0).alias("j"), F.lit(False).alias("done")))), "roots")
    if not large.isEmpty():
        of = large.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        most = of.groupBy("hub", "root").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max(F.struct("k", "root"))["root"].alias("most"))
        of = stored(of.join(most, "hub").select("sig", "n", "hub", "parts", "i", (F.col("root") == F.col("most")).alias("done")), "large")
        apart = of.where("not done")
        if not apart.isEmpty():
            blocks = apart.groupBy("hub").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
            of, apart = of.join(blocks, "hub"), apart.join(blocks, "hub")
            of = of.select("sig", "n", "hub", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "done")
            apart = apart.select("sig", "n", "hub", every, F.pmod(F.xxhash64("sig", "n"), "blocks").cast("int").alias("j"), "done")
            found = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(joined(of.unionByName(apart)))
            roots = stored(components(found), "roots")
    classes = rows.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "root").select("sig", "n", "component_id")
    return rows.join(classes, ["sig", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def links(sig: np.ndarray, n: np.ndarray, grams: list[np.ndarray], percent: int, done: np.ndarray) -> tuple[list[int], list[int]]:
    """Links enough to join what links join: exact overlaps of one row with all others, until each row outside the first component found has been one. Rows that are done are that component, joined before."""
    _, at = np.unique(np.stack([sig, n]), axis=1, return_index=True)
    sig, n, grams, done = sig[at], n[at].astype(np.int64), [grams[i] for i in at], done[at]
    m = len(sig)
    if m < 2:
        return [], []
    row = np.repeat(np.arange(m), n)
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    begin = np.flatnonzero(new)
    long = np.diff(np.append(begin, len(flat)))
    column = np.empty(len(flat), np.int64)
    column[order] = np.cumsum(new) - 1
    by_column, off = row[order], np.append(0, np.cumsum(n))
    label, main = np.arange(m), int(done.argmax()) if done.any() else -1
    label[done] = main
    todo = np.argsort(-np.add.reduceat(long[column], off[:-1]), kind="stable")
    u: list[int] = []
    v: list[int] = []
    for i in todo.tolist():
        if main >= 0 and label[i] == label[main]:
            continue
        own = column[off[i] : off[i + 1]]
        own = own[long[own] > 1]
        if not len(own):
            continue
        k = long[own]
        each = np.repeat(begin[own] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
        overlap = np.bincount(by_column[each], minlength=m)
        near = np.flatnonzero(100 * overlap >= percent * (n + n[i] - overlap))
        near = near[near != i]
        if main < 0 and len(near):
            main = i
        names, at = np.unique(label[near], return_index=True)
        u += [int(sig[i])] * len(at)
        v += sig[near[at]].tolist()
        label[np.isin(label, names)] = label[i]
    return u, v
