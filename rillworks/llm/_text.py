"""Word positions and hashes of whole Arrow text batches, with NumPy, a few MB at a time."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def table(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 7919 + 1))


def lanes(seed: int, n: int) -> np.ndarray:
    """n odd multipliers."""
    return table(seed, n) | _U(1)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = table(3, 256)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 and those of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, _U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


class Chunk:
    """Some consecutive rows of a batch: `buf` holds their UTF-8, row i from off[i] to off[i + 1]."""

    def __init__(self, lo: int, buf: np.ndarray, off: np.ndarray, null: np.ndarray) -> None:
        self.lo, self.buf, self.off, self.null, self.n = lo, buf, off, null, len(off) - 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The rows of a text column in order, about `limit` bytes at a time; a longer text stands alone. Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    null = column.is_null().to_numpy(zero_copy_only=False)
    if null.any():
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Chunk(lo, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], null[lo:hi])
        lo = hi


class Words:
    """Maximal runs of other bytes than space and 9 to 13: `start`, `end`, the rows' first words `first` (n + 1), 64-bit hashes `h`."""

    def __init__(self, c: Chunk, lower: bool = False, hashes: bool = True) -> None:
        buf = LOWER[c.buf] if lower else c.buf
        n = len(buf)
        word = ~SPACE[buf]
        edge = np.empty(n + 1, bool)
        if n:
            edge[0], edge[n] = word[0], word[-1]
            np.not_equal(word[1:], word[:-1], out=edge[1:n])
            begins, ends = edge[:-1] & word, edge[1:] & word
            cuts = c.off[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            begins[cuts] = word[cuts]
            ends[cuts - 1] = word[cuts - 1]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, c.off)
        self.count = np.diff(self.first)
        if hashes:
            with np.errstate(over="ignore"):
                up, down = powers(max(1 << 16, n + 1))
                sums = np.zeros(n + 1, _U)
                np.cumsum(_BYTE[buf] * up[:n], out=sums[1:])
                self.h = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(_U) * _U(0x9FB21C651E98DF25))


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values; those that start in the last width - 1 are short and count for nothing."""
    out = np.zeros(len(h), _U)
    with np.errstate(over="ignore"):
        for k, m in enumerate(lanes(seed, width)):
            out[: len(h) - k] += h[k:] * m
    return mix(out)


def long_windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """As windows(), with a few passes for any width: a polynomial over the mixed values, by running sums."""
    with np.errstate(over="ignore"):
        up, down = powers(max(1 << 16, len(h) + 1))
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(mix(h + table(seed, 1)) * up[: len(h)], out=sums[1:])
        out = np.zeros(len(h), _U)
        m = max(0, len(h) - width + 1)
        out[:m] = (sums[width : width + m] - sums[:m]) * down[:m]
    return mix(out)


def blobs(key: np.ndarray, n_keys: int) -> list[tuple[int, np.ndarray]]:
    """(key, row numbers) for each key that occurs."""
    order = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[order], np.arange(n_keys + 1))
    return [(k, order[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut)).tolist()]
