"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks."""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._send import received, sent
from ._text import LOWER, Chunk, Words, chunks

#: Hashed terms, latent dimensions, dimensions beyond that the random start has, rounds of power iteration.
TERMS, DIMENSIONS, EXTRA, ROUNDS = 1 << 16, 256, 16, 2
#: Words of a step and steps of a passage, short and long.
STEP, SHORT, LONG = 8, 3, 7
#: Words of a long item's parts, which begin half of that apart; bytes of items that one index holds; entries that are held against passages at once.
PART, BYTES, BLOCK = 56, 1 << 26, 2048
#: The least cosine of a candidate; the least share of an item's words in order; the least share with nearly all of the answer.
COSINE, COMMON, PARAPHRASE, ANSWER = 0.3, 0.65, 0.5, 0.8
#: Letters and digits count; other ASCII characters part words.
_FOLD = np.where(np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint8)[LOWER]
_MASK = np.uint64(TERMS - 1)


def _words(c: Chunk) -> Words:
    c.buf = _FOLD[c.buf]
    return Words(c)


@dataclass
class Index:
    """Benchmark items in latent space: terms' weights and vectors; a vector of each entry, which is an item or, of a long one, a part; the items' whole words."""

    idf: np.ndarray
    basis: np.ndarray
    row: np.ndarray  # of each term in basis; the last row of basis is zero, for terms that no item has
    vectors: np.ndarray  # of entries; the product with a passage's, over the passage's whole norm, estimates their cosine
    of: np.ndarray  # the item of each entry
    items: list[int]
    words: list[np.ndarray]  # of items
    word: np.ndarray  # all items' distinct words
    spelt: list[np.ndarray]  # of items, as numbers in word


def _parts(n: int) -> list[int]:
    """Where an item of n words begins its parts of PART words."""
    return [0] if n <= PART else [*range(0, n - PART, PART // 2), n - PART]


def _term_counts(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed term occurs, over all rows; the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for c in chunks(batch["text"]):
                w = _words(c)
                pair = np.unique(np.repeat(np.arange(c.n, dtype=np.int64), w.count) * TERMS + (w.h & _MASK).astype(np.int64))
                seen += np.bincount(pair % TERMS, minlength=TERMS)
                n += c.n
        at = np.arange(0, TERMS, 4096)
        yield pa.RecordBatch.from_arrays([pa.array(at // 4096, pa.int32()), pa.array([seen[k : k + 4096] for k in at], pa.list_(pa.int64())), pa.array([n if k == 0 else 0 for k in at], pa.int64())], names=["block", "seen", "n"])

    # sums by position within each block, in the JVM: partial sums first, so no task holds more than its share
    parts = rows.mapInArrow(count, "block int, seen array<long>, n long").select("block", "n", F.posexplode("seen"))
    got = parts.groupBy("block", "pos").agg(F.sum("col").alias("seen"), F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("n")).toPandas()
    seen = np.zeros(TERMS, np.int64)
    seen[got["block"].to_numpy() * 4096 + got["pos"].to_numpy()] = got["seen"].to_numpy()
    return seen, int(got["n"].sum())


def _gram(items: DataFrame, idf: np.ndarray, row: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times basis, for the TF-IDF rows A of all entries and a basis with a row for each term that they have: each partition's part, summed by block of terms."""
    model = items.sparkSession.sparkContext.broadcast((idf, row, basis))
    size = 1024

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, row, basis = model.value
        out = np.zeros_like(basis)
        for batch in batches:
            for c in chunks(batch["text"]):
                w = _words(c)
                for first, last in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    for lo in _parts(last - first):
                        term, tf = np.unique((w.h[first + lo : min(last, first + lo + PART)] & _MASK).astype(np.int64), return_counts=True)
                        x = (tf * idf[term]).astype(np.float32)
                        x /= max(1e-9, float(np.sqrt((x**2).sum())))
                        out[row[term]] += x[:, None] * (x @ basis[row[term]])
        for k in range(0, len(basis), size):
            if out[k : k + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([out[k : k + size].tobytes()], pa.binary())], names=["block", "data"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32) for x in t["data"])
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])

    out = np.zeros_like(basis)
    for r in items.mapInArrow(part, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary").collect():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.data, np.float32).reshape(-1, basis.shape[1])
    model.unpersist()
    return out


def build_index(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = BYTES) -> list[Index]:
    """TF-IDF over hashed terms, idf from all documents; a randomised SVD of the entries' rows: a random start, power iterations on A'A, each a Spark job that sums partitions' products.

    An entry is an item or, of one with more than PART words, a part; the SVD has as many dimensions as there are entries, DIMENSIONS at most. Up to
    that an entry's product with a passage is their cosine; beyond, both are projected, and the product, divided by the share of the entry's norm that
    is left, estimates the cosine with an error of about 1 / sqrt(DIMENSIONS). Null and empty items are left out; an item_id that repeats stands for all
    its texts. An index is sent to all tasks and holds the words of its items, so a benchmark of more than `limit` bytes gives several, each for
    a part of the items by hash; none is left for a benchmark without words.
    """
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.lower(F.col(item_text)).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return []
    seen, n = _term_counts(docs.select(F.lower(F.col(text_col)).alias("text")))
    idf = np.log((n + 1) / (seen + 1)).astype(np.float32) + np.float32(0.01)
    n_parts = -(-size // limit)
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k) for k in range(n_parts)] if n_parts > 1 else [items]
    return [x for x in (_index(part, idf) for part in parts) if x is not None]


def _index(items: DataFrame, idf: np.ndarray) -> Index | None:
    ids, words = [], []
    for r in sorted(items.collect(), key=lambda r: (r.item_id, r.text)):  # `limit` bytes
        for c in chunks(pa.array([r.text], pa.string())):
            w = _words(c)
            if len(w.h):
                ids.append(r.item_id)
                words.append(w.h)
    if not ids:
        return None
    parts = [(j, h[k : k + PART]) for j, h in enumerate(words) for k in _parts(len(h))]
    entries = [h for _, h in parts]
    used = np.unique(np.concatenate(words) & _MASK).astype(np.int64)
    row = np.full(TERMS, len(used), np.int32)
    row[used] = np.arange(len(used))
    keep = min(DIMENSIONS, len(entries), len(used))
    k = min(keep + EXTRA, len(entries), len(used))
    basis = np.random.default_rng(11).standard_normal((len(used), k)).astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(_gram(items, idf, row, basis))[0].astype(np.float32)
    inside = basis.T @ _gram(items, idf, row, basis)
    _, turn = np.linalg.eigh((inside + inside.T) / 2)
    basis = basis @ turn[:, ::-1][:, :keep].astype(np.float32)
    small = np.vstack([basis * idf[used, None], np.zeros((1, basis.shape[1]), np.float32)])
    vectors = np.stack([small[row[(h & _MASK).astype(np.int64)]].sum(axis=0) for h in entries])
    whole = np.array([np.sqrt(((n * idf[t]) ** 2).sum()) for t, n in (np.unique((h & _MASK).astype(np.int64), return_counts=True) for h in entries)], np.float32)
    vectors *= (whole / np.maximum(1e-9, (vectors**2).sum(axis=1)))[:, None]
    word = np.unique(np.concatenate(words))
    return Index(idf, small, row, vectors, np.array([j for j, _ in parts]), ids, words, word, [np.searchsorted(word, h) for h in words])


def common(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The length of the longest common subsequence and where in the item it ends, a bit for each of the item's words."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in passage.tolist():
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return (~v & full).bit_count(), ~v & full


def find_leaks(docs: DataFrame, index: Sequence[Index], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, common (share of the item's words in order), answer (share of its last quarter's words present, three at least) for each document and benchmark item that it holds.

    Words are runs of letters and digits in lower case. Every text is cut into overlapping passages of 24 and 56 words, a step of 8 apart, without an end left out. A passage is a candidate for
    the items with an entry whose cosine with it, estimated in latent space, is at least COSINE; a word
    that a passage repeats adds to its norm as often as it stands there, which is never too much. The longest common subsequence of an item's words with those of the
    passage and as many around it as the item has must hold COMMON of the item, or PARAPHRASE of it and ANSWER of the answer's words. All candidates are held
    against that, those that overlap together; the figures are those of the place with the most in common that meets it, the cosine that of the whole item there. Null and
    empty texts hold nothing; nor does anything without an index. Repeated rows give repeated rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    found = [rows.mapInArrow(_searcher(sent(docs.sparkSession, ix)), schema) for ix in index]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    # an item_id that repeats may stand in several indexes
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("common", "answer", "cosine")).alias("x"))
    return best.select("doc_id", "item_id", "x.cosine", "x.common", "x.answer")


def _searcher(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = received(index)
        for batch in batches:
            out = []
            ids = batch["doc_id"].to_pylist()
            for c in chunks(batch["text"]):
                w = _words(c)
                if len(w.h):
                    out += [(ids[c.lo + r], *x) for r, x in _search(ix, w, c.n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "common", "answer"])

    return search


def candidates(ix: Index, w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n texts: the rows and first words of all passages; the passages and entries whose cosine in latent space is at least COSINE."""
    term = (w.h & _MASK).astype(np.int64)
    steps = -(-w.count // STEP)
    first = np.append(0, np.cumsum(steps))
    row = np.repeat(np.arange(n), steps)
    at = w.first[row] + STEP * (np.arange(first[-1]) - first[row])
    weight = np.add.reduceat(ix.idf[term] ** 2, at)
    place = ix.row[term]
    known = np.flatnonzero(place < len(ix.basis) - 1)
    vec = np.zeros((len(at), ix.basis.shape[1]), np.float32)
    if len(known):
        owner = np.searchsorted(at, known, side="right") - 1
        nth = known - at[owner]
        for k in range(STEP):  # the steps' first words, then their second ones
            own = nth == k
            vec[owner[own]] += ix.basis[place[known[own]]]
    near: list[tuple[np.ndarray, np.ndarray]] = []  # of each width: steps and entries

    def onto(x: np.ndarray, y: np.ndarray, k: int) -> None:
        """Adds to each step of x what y has k steps on in the same text."""
        if k < len(x):
            same = (row[k:] == row[:-k]).astype(np.float32)
            x[:-k] += y[k:] * (same[:, None] if y.ndim > 1 else same)

    def wider(x: np.ndarray) -> Iterator[np.ndarray]:
        """Sums of SHORT, then of LONG consecutive steps, the latter from the former."""
        short = x.copy()
        for k in range(1, SHORT):
            onto(short, x, k)
        yield short
        long = short.copy()
        for k in range(SHORT, LONG - SHORT + 1, SHORT):
            onto(long, short, k)
        for k in range(LONG - LONG % SHORT, LONG):
            onto(long, x, k)
        yield long

    for v, norm in zip(wider(vec), wider(weight.astype(np.float32))):
        least = COSINE * np.sqrt(np.maximum(norm, 1e-9))[:, None]
        for lo in range(0, len(ix.vectors), BLOCK):
            i, j = np.nonzero(v @ ix.vectors[lo : lo + BLOCK].T >= least)
            near.append((i, j + lo))
    step, entry = (np.concatenate(x) for x in zip(*near))
    return row, at, step, entry


def _search(ix: Index, w: Words, n: int) -> Iterator[tuple[int, tuple]]:
    row, at, step, entry = candidates(ix, w, n)
    if not len(step):
        return
    # the places around candidates, those of one row and item put together where they overlap
    j, r = ix.of[entry], row[step]
    size = np.array([len(x) for x in ix.words])
    lo, hi = np.maximum(w.first[r], at[step] - size[j]), np.minimum(w.first[r + 1], at[step] + LONG * STEP + size[j])
    order = np.lexsort((lo, j, r))
    j, r, lo, hi = j[order], r[order], lo[order], hi[order]
    new = np.append(True, (j[1:] != j[:-1]) | (r[1:] != r[:-1]))
    group = (np.cumsum(new) - 1) * (len(w.h) + 1)
    upto = np.maximum.accumulate(hi + group) - group
    new[1:] |= lo[1:] > upto[:-1]
    begin = np.flatnonzero(new)
    word = np.minimum(np.searchsorted(ix.word, w.h), len(ix.word) - 1)
    word[ix.word[word] != w.h] = len(ix.word)
    present = np.zeros(len(ix.word) + 1, bool)
    best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    for j, r, lo, hi in zip(j[begin].tolist(), r[begin].tolist(), lo[begin].tolist(), np.maximum.reduceat(hi, begin).tolist()):
        item, spelt = ix.words[j], ix.spelt[j]
        most = LONG * STEP + 3 * len(item)  # a longer place is cut so that each candidate's own lies in one piece
        for a in range(lo, max(lo + 1, hi - most + len(item)), len(item)):
            some = word[a : min(hi, a + most)]
            present[some] = True
            there = present[spelt]
            present[some] = False
            if np.count_nonzero(there) < PARAPHRASE * len(item):
                continue  # fewer of the item's words in any order
            told = float(there[-max(3, len(item) // 4) :].mean())
            share = common(item, w.h[a : min(hi, a + most)])[0] / len(item)
            if share >= COMMON or share >= PARAPHRASE and told >= ANSWER:
                best[r, j] = max(best.get((r, j), (0.0, 0.0, 0, 0)), (share, told, a, min(hi, a + most)))
    found: dict[tuple[int, int], tuple] = {}
    for (r, j), (share, told, a, b) in best.items():
        key = r, ix.items[j]
        found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (share, told, _cosine(ix, ix.words[j], w.h[a:b])))
    for (r, item), (share, told, cos) in found.items():
        yield r, (item, cos, share, told)


def _cosine(ix: Index, item: np.ndarray, place: np.ndarray) -> float:
    """The highest cosine of an item and as many words of a place as it has, a step apart, by TF-IDF of all terms."""

    def weights(h: np.ndarray) -> dict[int, float]:
        term, tf = np.unique((h & _MASK).astype(np.int64), return_counts=True)
        x = tf * ix.idf[term]
        return dict(zip(term.tolist(), (x / max(1e-9, float(np.sqrt((x**2).sum())))).tolist()))

    own = weights(item)
    return max(sum(x * own.get(t, 0.0) for t, x in weights(place[k : k + len(item)]).items()) for k in range(0, max(1, len(place) - len(item) + STEP), STEP))
