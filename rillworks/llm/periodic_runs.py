"""Periodic runs of words: suffix classes united by falling LCP."""

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, chunks, mix, table, windows

_U = np.uint64


def window(least: int, times: int) -> int:
    """The most words of a window that, wherever it lies in a run, stands again a period away inside the run: its length less two periods, plus one. No run has a shorter LCP between places a period apart."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def _stretches(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of stretches in which every window of `width` words occurs twice or more.

    A run lies in one stretch: each of its windows stands again a period away, inside the run. Windows that are alone in their stretch are
    taken out, three times over; what stays beyond that costs time only.
    """
    grams = windows(h, width, 29)
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(h)) + width <= first[1:][group])
    group = group[at]
    for _ in range(3):
        if not len(at):
            break
        with np.errstate(over="ignore"):
            key = mix(grams[at] + group.astype(_U) * _U(0x9E3779B97F4A7C15) + table(31, 1))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, group = at[twice], group[twice]
        group = np.cumsum(np.append(True, (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])))[: len(at)]
    if not len(at):
        return at, at
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return at[begin], at[np.append(begin[1:], len(at)) - 1]


def _sorted_suffixes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, l: suffixes next to each other in the suffix order of their stretch and their LCP, where that is `width` or more.

    Ranks double their depth until all differ; LCPs are read off the ranks of all depths, deepest first. A stretch ends with its last window's last word.
    """
    n = hi - lo + width
    base = np.cumsum(np.append(0, n))
    place = np.arange(base[-1])
    own = np.repeat(np.arange(len(n)), n)
    pos = place - base[own] + lo[own]
    end = base[own + 1]
    with np.errstate(over="ignore"):
        _, rank = np.unique(mix(h[pos] + own.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), return_inverse=True)
    levels, depth = [rank.astype(np.int32)], 1
    while True:
        there = place + depth
        beyond = np.where(there < end, levels[-1][np.minimum(there, len(place) - 1)] + 1, 0)
        distinct, rank = np.unique(levels[-1].astype(np.int64) * (len(place) + 1) + beyond, return_inverse=True)
        if len(distinct) == len(place):
            break
        levels.append(rank.astype(np.int32))
        depth *= 2
    order = np.argsort(rank)
    i, j = order[:-1].copy(), order[1:].copy()
    together = own[i] == own[j]
    i, j = i[together], j[together]
    x, y, lcp = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (x + (1 << k) <= end[i]) & (y + (1 << k) <= end[j])
        same = inside & (levels[k][np.minimum(x, len(place) - 1)] == levels[k][np.minimum(y, len(place) - 1)])
        step = same.astype(np.int64) << k
        x, y, lcp = x + step, y + step, lcp + step
    deep = lcp >= width
    return pos[i[deep]], pos[j[deep]], lcp[deep]


def _united(i: list[int], j: list[int], lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(x, y, l) with y - x <= l: positions that come to stand next to each other when their classes are united at LCP l.

    Edges come by falling LCP. Each class keeps its positions in order; the smaller class goes into the larger one.
    """
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b, l in zip(i, j, lcp):
        a, b = find(a), find(b)
        big, new = places.get(a) or [a], places.get(b) or [b]
        if len(big) < len(new):
            a, b, big, new = b, a, new, big
        root[b] = a
        places.pop(b, None)
        places[a] = big
        last = -1
        for k, x in enumerate(new):
            p = bisect(big, x)
            if p and big[p - 1] != last and x - big[p - 1] <= l:
                yield big[p - 1], x, l
            if p < len(big) and big[p] - x <= l and (k + 1 == len(new) or new[k + 1] > big[p]):
                yield x, big[p], l
            big.insert(p, x)
            last = x


def find_runs(h: np.ndarray, first: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows of start, length, period, by start and period: the runs of word values h in texts that begin at first[:-1]. Positions count from the chunk's first word.

    With classes that are united at LCP l, positions x < y next to each other and no more than l apart have a stretch of period y - x from x to
    y + l, which can't grow at its end. It begins a run if the words before x and y differ. The period is the least one, as a lesser one would
    put another position of the class between them.
    """
    width = window(least, times)
    lo, hi = _stretches(h, first, width) if len(h) >= least else ([], [])
    if not len(lo):
        return np.zeros((0, 3), np.int64)
    i, j, lcp = _sorted_suffixes(h, lo, hi, width)
    down = np.argsort(-lcp, kind="stable")
    found = np.array(list(_united(i[down].tolist(), j[down].tolist(), lcp[down].tolist())), np.int64).reshape(-1, 3)
    x, y, l = found.T
    begins = np.isin(x, first) | (h[x - 1] != h[y - 1])
    out = np.stack([x, y - x + l, y - x], axis=1)[begins & (y - x + l >= np.maximum(least, times * (y - x)))]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), kept_text for each row.

    Words are runs of other bytes than space and 9 to 13, numbered from 0, equal if their 64-bit hashes are. A run is a stretch with smallest
    period q of `least` words and `times` * q words at least, which no neighbouring word extends with that period. kept_text: the words that no
    run contains after its first q words, joined by one space.

    Each row is judged by itself, whole, in the task that reads it: nothing is shuffled, so equal texts, common words and hot sources need no
    dealing out. A null or empty text has no words, no runs and the kept text "". Rows with null or repeated ids have a row each. Other columns
    aren't read. Memory follows the longest text: some 4 bytes for each of its words in repeating stretches and each doubling of their length.
    """
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, ends, kept = [], [], [0], []
            for c in chunks(b.column("text")):
                w = Words(c)
                found = find_runs(w.h, w.first, least, times)
                cut = np.searchsorted(found[:, 0], w.first)
                data = c.buf.tobytes()
                for k in range(c.n):
                    text = data[c.off[k] : c.off[k + 1]].split()
                    if cut[k] < cut[k + 1]:
                        own = found[cut[k] : cut[k + 1]] - [w.first[k], 0, 0]
                        gone = np.zeros(len(text) + 1, np.int64)
                        np.add.at(gone, own[:, 0] + own[:, 2], 1)
                        np.add.at(gone, own[:, 0] + own[:, 1], -1)
                        text = [text[p] for p in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                        runs.append(own)
                    kept.append(b" ".join(text))
                sizes.append(w.count)
                ends += (ends[-1] + cut[1:]).tolist()
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in flat.T], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
            count = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string")
