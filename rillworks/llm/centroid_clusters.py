"""Lloyd's rounds over integer vectors with a heap of gaps for each cluster: only vectors whose gap the centroids' drift has used up are compared with all centroids again."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import removed, stored

#: Vectors of a block, which has the heaps of all clusters over its own vectors.
BLOCK = 4096
#: Components lie within this bound either way; larger ones count as the bound.
BOUND = 1 << 40
#: Up to here products and sums of 64 components are exact in double precision.
EXACT = 1 << 22
MOST = (1 << 63) - 1
_I = np.int64


def integers(vector: Column, scale: int, width: int) -> Column:
    """floor(scale * x) of each component; null where the width is another or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(x.cast("double") * F.lit(float(scale))))).cast("long"))
    return F.when((F.size(vector) == width) & good, ints)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centres, exact: as doubles while they can hold them, else as Python's integers."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0))) <= EXACT and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    a, c = x.astype(object), centres.astype(object)
    return np.array([((row - c) ** 2).sum(axis=1) for row in a], object).reshape(len(a), len(c))


class Heaps:
    """A block's heaps: members by cluster, each cluster's in rising order of their keys, so that the front of each is its top.

    A vector's key is its gap, the distance to the next nearest centroid less that to its own, plus what its cluster's offset was when it was
    pushed. The offset grows each round by the centroid's own drift and the largest drift of another; while it is below the key the vector can't
    have another nearest centroid.
    """

    def __init__(self, k: int, member: np.ndarray, key: np.ndarray, starts: np.ndarray) -> None:
        self.k, self.member, self.key, self.starts = k, member, key, starts

    def pop(self, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members whose keys the offsets have reached, and their clusters; they leave the heaps."""
        n = [int(np.searchsorted(self.key[lo:hi], offset[c], side="right")) for c, (lo, hi) in enumerate(zip(self.starts[:-1], self.starts[1:]))]
        out = np.zeros(len(self.key), bool)
        for lo, m in zip(self.starts, n):
            out[lo : lo + m] = True
        gone, own = self.member[out], np.repeat(np.arange(self.k), n)
        self.member, self.key = self.member[~out], self.key[~out]
        self.starts = self.starts - np.cumsum([0, *n])
        return gone, own

    def push(self, member: np.ndarray, cluster: np.ndarray, key: np.ndarray) -> None:
        order = np.lexsort((key, cluster))
        member, cluster, key = member[order], cluster[order], key[order]
        cut = np.searchsorted(cluster, np.arange(self.k + 1))
        at = np.concatenate([self.starts[c] + np.searchsorted(self.key[self.starts[c] : self.starts[c + 1]], key[cut[c] : cut[c + 1]]) for c in range(self.k)])
        self.member, self.key, self.starts = np.insert(self.member, at, member), np.insert(self.key, at, key), self.starts + cut

    def clusters(self) -> np.ndarray:
        """Each member's cluster, by member."""
        out = np.empty(len(self.member), _I)
        out[self.member] = np.repeat(np.arange(self.k), np.diff(self.starts))
        return out


def assign(x: np.ndarray, heaps: Heaps, centres: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """One assignment of a block's vectors. Rows of (cluster, vectors that came less those that left, the same of their sums), and last (-1, vectors rescanned, zeros)."""
    gone, was = heaps.pop(offset)
    if not len(heaps.member) and not len(gone):
        gone, was = np.arange(len(x)), np.full(len(x), -1)
    d = distances(x[gone], centres)
    now = d.argmin(axis=1).astype(_I) if len(gone) else gone.astype(_I)
    near = d[np.arange(len(gone)), now]
    if len(centres) > 1:
        rest = np.sort(d, axis=1)[:, 1]
        upper, lower = np.sqrt(near.astype(np.float64)), np.sqrt(rest.astype(np.float64))
        gap = lower - upper - 1e-9 * (lower + upper + 1)  # rounding never makes a gap larger
    else:
        gap = np.full(len(gone), np.inf)
    heaps.push(gone.astype(np.int32), now, gap + offset[now])
    moved = was != now
    came, left = np.unique(now[moved], return_inverse=True), np.unique(was[moved & (was >= 0)], return_inverse=True)
    out = np.zeros((len(centres) + 1, 2 + x.shape[1]), _I)
    out[:, 0] = [*range(len(centres)), -1]
    for (which, at), rows, sign in ((came, gone[moved], 1), (left, gone[moved & (was >= 0)], -1)):
        for i, c in enumerate(which):
            own = x[rows[at == i]]
            out[c, 1] += sign * len(own)
            out[c, 2:] += sign * own.sum(axis=0)
    out[-1, 1] = len(gone)
    return out[out[:, 1:].any(axis=1)]


def _narrow(x: np.ndarray) -> bytes:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else _I).tobytes()


def _wide(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: _I}[len(data) // max(1, n * width)] if n else _I).reshape(n, width).astype(_I)


_BINARY = ("vectors", "member", "key", "starts", "delta")


def _heaps(row: dict, k: int) -> Heaps:
    return Heaps(k, np.frombuffer(row["member"], np.int32), np.frombuffer(row["key"], np.float64), np.frombuffer(row["starts"], _I))


def _blocks(rows: DataFrame, width: int, k: int) -> DataFrame:
    """vec_id, ints as blocks with empty heaps."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for lo in range(0, len(x), BLOCK):
                ids = b.column("vec_id").slice(lo, BLOCK)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                data = (_narrow(x[lo : lo + BLOCK]), b"", b"", np.zeros(k + 1, _I).tobytes(), b"")
                yield pa.RecordBatch.from_arrays([lists, *(pa.array([v], pa.binary()) for v in data)], names=["ids", *_BINARY])

    return rows.mapInArrow(run, f"ids array<{kind}>, {', '.join(f'{c} binary' for c in _BINARY)}")


def _assigned(state: DataFrame, centres: np.ndarray, offset: np.ndarray, width: int) -> DataFrame:
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in _BINARY}
                heaps = _heaps(row, k)
                n = len(b.column("ids")[i])
                delta = assign(_wide(row["vectors"], n, width), heaps, centres, offset)
                data = (row["vectors"], heaps.member.astype(np.int32).tobytes(), heaps.key.tobytes(), heaps.starts.tobytes(), delta.tobytes())
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1), *(pa.array([v], pa.binary()) for v in data)], names=["ids", *_BINARY])

    return state.mapInArrow(run, state.schema)


def _changes(state: DataFrame, width: int) -> dict[int, list[int]]:
    """Count and sums that each cluster has won, and at -1 the number of rescanned vectors: at most k + 1 rows a task, then of the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for x in b.column("delta").to_pylist():
                for row in np.frombuffer(x, _I).reshape(-1, 2 + width):
                    c = int(row[0])
                    total[c] = total.get(c, 0) + row[1:].astype(object)
        keys, at, value = zip(*((c, i, str(v)) for c, row in total.items() for i, v in enumerate(row))) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(at, pa.int32()), pa.array(value, pa.string())], names=["cluster", "at", "value"])

    sums = state.select("delta").mapInArrow(run, "cluster int, at int, value string").groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, list[int]] = {}
    for r in sums.collect():
        out.setdefault(r.cluster, [0] * (1 + width))[r.at] = int(r.value)
    return out


@dataclass
class Clusters:
    """rows (vec_id, cluster, distance), the final centroids, and how many vectors each assignment compared with all centroids."""

    rows: DataFrame
    centroids: list[list[int]]
    rescanned: list[int]


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
    """k clusters of the vectors of `width` finite components, as integers floor(scale * x), by `rounds` rounds of assignment and exact floored means and a last assignment.

    Centroids start as the k vectors with the least SHA-256 of "seed:id"; equal ids are ordered by components, null ids come last. The nearest
    centroid counts, the smaller number among equals; a centroid without vectors stays. All arithmetic that decides is in integers: doubles
    while they are exact, Python's beyond. Components beyond 2**40 either way count as that bound, distances beyond a long as the largest one.

    Vectors stand in blocks, each with the heaps of all clusters over its own vectors, so nothing is dealt by cluster and a cluster with a third
    of all vectors is spread as the vectors are. Each assignment is one pass over the blocks, written below spark.checkpoint.dir, whose
    predecessor then goes; it pops only vectors whose gaps are used up. The driver gets sums of k clusters.

    Vectors of another width, null ones and those with null or not finite components have no row; null and repeated ids and equal vectors have a
    row each. Other columns aren't read. With fewer than k vectors each is a centroid; without any there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), integers(F.col(vec_col), scale, width).alias("ints")).where(F.col("ints").isNotNull())
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [list(r.ints) for r in rows.orderBy(name.asc_nulls_last(), "ints").select("ints").limit(k).collect()]
    k = len(centroids)
    if not k:
        return Clusters(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [])
    state = _blocks(rows, width, k)
    counts, sums, offset, rescanned = [0] * k, [[0] * width for _ in range(k)], np.zeros(k), []
    before = None
    for turn in range(rounds + 1):
        state = stored(_assigned(state, np.array(centroids, _I), offset, width), "clusters")
        if before is not None:
            removed(before)
        before = state
        changes = _changes(state, width)
        rescanned.append(changes.pop(-1, [0])[0])
        if turn == rounds:
            break
        for c, (n, *s) in changes.items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s)]
        new = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)]
        drift = np.array([sum((a - b) ** 2 for a, b in zip(old, at)) ** 0.5 for old, at in zip(centroids, new)]) * (1 + 1e-12)
        others = np.array([np.delete(drift, c).max(initial=0) for c in range(k)])
        centroids, offset = new, offset + drift + others
    return Clusters(_members(spark, state, np.array(centroids, _I), width), centroids, rescanned)


def _members(spark: SparkSession, state: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """vec_id, cluster, distance of each vector of the blocks."""
    k, kind = len(centres), state.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in ("vectors", "member", "key", "starts")}
                ids = b.column("ids").slice(i, 1).flatten()
                x, cluster = _wide(row["vectors"], len(ids), width), _heaps(row, k).clusters()
                out = np.zeros(len(x), _I)
                for c in np.unique(cluster):
                    own = cluster == c
                    out[own] = [min(int(d), MOST) for d in distances(x[own], centres[c : c + 1])[:, 0]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(out, pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.select("ids", "vectors", "member", "key", "starts").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def with_inertia(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia (sums of distances, at most the largest long), centroid_sha256."""
    rows = stored(found.rows, "members")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    total = sum(int(r.d) for r in sums)
    names = [(r.cluster, min(int(r.d), MOST), min(total, MOST), hashlib.sha256(",".join(map(str, found.centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
