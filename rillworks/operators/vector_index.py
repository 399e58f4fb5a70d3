"""Approximate nearest points by inverted lists with product-quantised codes, kept as Parquet."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector_blocks import QUERIES, Best, matrix, query_blocks, sampled, slices, spherical_kmeans, top_ranked, union

#: Vectors, about, that the quantisers learn from, and that calibration asks with. Both are bounds for any number of points.
SAMPLE, ASKED = 1 << 16, 256
CELLS = 4096
#: Candidates of a block of queries up to which they are sent to all tasks.
FEW = 1 << 20
#: Candidates that a task keeps for a block of queries, so a block has the fewer queries the more each keeps.
KEPT = 1 << 18
_MODEL = "width int, centres binary, edges array<int>, books array<binary>, probes int"


@dataclass(frozen=True)
class Quantiser:
    """A unit vector is its cell's centre plus, for each range of components, a row of that range's codebook. `probes`: the cells to visit."""

    centres: np.ndarray
    edges: list[int]
    books: list[np.ndarray]
    probes: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for s in slices(len(x), len(self.centres)):
            out[s] = (x[s] @ self.centres.T).argmax(axis=1)
        return out

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest, out = x - self.centres[cells], np.zeros((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            own, half = rest[:, self.edges[m] : self.edges[m + 1]], (book * book).sum(axis=1) / 2
            for s in slices(len(x), len(book)):
                out[s, m] = (own[s] @ book.T - half).argmax(axis=1)
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each range of components the product of each code with each query."""
        return [book @ q[:, lo:hi].T for book, lo, hi in zip(self.books, self.edges, self.edges[1:])]

    def near_cells(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        half, own = (centres * centres).sum(axis=1) / 2, np.zeros(len(x), np.int64)
        for s in slices(len(x), len(centres)):
            own[s] = (x[s] @ centres.T - half).argmax(axis=1)
        count, sums = np.bincount(own, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def train(points: DataFrame, cells: int | None = None, parts: int = 16, target: float = 0.95, k: int = 10, sample: int = SAMPLE) -> Quantiser:
    """Quantisers from about `sample` points, however many there are: `cells` centres (the root of the number of points, 4096 at most) and for
    each of `parts` ranges of components a codebook of 256 residuals.

    `probes` is calibrated: the fewest cells that hold a share of `target` of the k nearest of 256 sampled points among the sample. Vectors that lie in
    clusters need few; vectors without any structure need most of them, whatever the quantiser.
    """
    n = points.count()
    x = sampled(points.select("doc_id", "vector"), n, sample)
    if not len(x):
        return Quantiser(np.zeros((0, 0)), [0], [], 0)
    centres = spherical_kmeans(x, cells or max(1, min(CELLS, math.isqrt(n))))
    width = x.shape[1]
    edges = np.linspace(0, width, min(parts, width) + 1).astype(int).tolist()
    own = Quantiser(centres, [], [], 0).cells(x)
    rest = x - centres[own]
    books = [_kmeans(rest[:, lo:hi], 256) for lo, hi in zip(edges, edges[1:])]
    asked = x[:: max(1, len(x) // ASKED)][:ASKED]
    got = asked @ x.T
    near = np.argsort(-got, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the point itself or its equal
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
    probes = int(depth[min(len(depth) - 1, math.ceil(target * len(depth)) - 1)]) + 1 if len(depth) else 1
    return Quantiser(centres, edges, books, probes)


def save(spark: SparkSession, q: Quantiser, at: str) -> None:
    width = q.centres.shape[1]
    row = (width, q.centres.tobytes(), q.edges, [b.tobytes() for b in q.books], q.probes)
    spark.createDataFrame([row], _MODEL).coalesce(1).write.parquet(f"{at}/model")


def load(spark: SparkSession, at: str) -> Quantiser:
    r = spark.read.schema(_MODEL).parquet(f"{at}/model").first()
    books = [np.frombuffer(b, np.float64).reshape(-1, hi - lo) for b, lo, hi in zip(r.books, r.edges, r.edges[1:])]
    return Quantiser(np.frombuffer(r.centres, np.float64).reshape(-1, r.width) if r.width else np.zeros((0, 0)), list(r.edges), books, r.probes)


def add_points(points: DataFrame, at: str) -> None:
    """Points (doc_id, vector) join the lists of the index, all of them: cell, doc_id, code and vector, in a folder a cell.

    Rows are dealt by ranges of cell and a hash of the id, so a cell with a third of all points goes to as many tasks as its size asks for.
    Points without a usable vector, or of another width, are left out.
    """
    q, kind = load(points.sparkSession, at), points.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = matrix(b.column("vector"))
            if not len(x) or x.shape[1] != q.centres.shape[1]:
                continue
            cells = q.cells(x)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))
            codes = pa.array([c.tobytes() for c in q.codes(x, cells)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(cells, pa.int32()), codes, vectors], names=["doc_id", "cell", "code", "unit"])

    placed = points.select("doc_id", "vector").mapInArrow(place, f"doc_id {kind}, cell int, code binary, unit array<float>")
    placed.repartitionByRange("cell", F.xxhash64("doc_id")).write.mode("append").partitionBy("cell").parquet(f"{at}/lists")


def build_index(points: DataFrame, at: str, **how) -> Quantiser:
    q = train(points, **how)
    save(points.sparkSession, q, at)
    add_points(points, at)
    return q


def _lists(spark: SparkSession, at: str, kind: str) -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, code binary, unit array<float>, cell int").parquet(f"{at}/lists")


def search_index(queries: DataFrame, at: str, k: int, probes: int | None = None, rerank: int = 20, id_type: str = "bigint") -> DataFrame:
    """query_id, doc_id, score (cosine, 6 digits), rank: about the k nearest points of each query (query_id, vector).

    A query visits the lists of its `probes` nearest cells, by default as many as calibration found; only those folders are read, and of them the
    codes. Table look-ups give each code's product with the query, and the rerank * k best are scored again by their vectors. A block of queries
    is one pass over its lists; tasks return rerank * k rows a query at most, and a block has as many queries as give 2^18 of those, so what a task
    holds doesn't grow with queries or points. Reading vectors takes a second pass over the same lists.
    """
    spark, most = queries.sparkSession, rerank * k
    q, query_kind = load(spark, at), queries.schema["query_id"].dataType.simpleString()
    kinds, parts = f"query_id {query_kind}, doc_id {id_type}, score double", []
    probes = min(probes or q.probes, len(q.centres))
    for block in query_blocks(queries.select("query_id", "vector"), max(1, min(QUERIES, KEPT // most))):
        x, own = matrix(block["vector"])
        if not len(x) or not probes or x.shape[1] != q.centres.shape[1]:
            continue
        names, cells = block["query_id"].combine_chunks().take(pa.array(own)), q.near_cells(x, probes)
        order, visits = np.argsort(cells.ravel(), kind="stable"), np.bincount(cells.ravel(), minlength=len(q.centres))
        asked, ends = (order // probes).astype(np.int16), np.append(0, np.cumsum(visits))  # the queries of cell c: from ends[c] to ends[c + 1]
        lists = _lists(spark, at, id_type)
        lists = lists if visits.all() else lists.where(F.col("cell").isin(np.flatnonzero(visits).tolist()))
        tables, base = [np.ascontiguousarray(t, np.float32) for t in q.tables(x)], (x @ q.centres.T).astype(np.float32)
        number = pa.array(np.arange(len(x)))

        def look(batches: Iterator[pa.RecordBatch], asked: np.ndarray = asked, ends: np.ndarray = ends, tables: list = tables, base: np.ndarray = base, number: pa.Array = number) -> Iterator[pa.RecordBatch]:
            best = Best(most, len(number))
            for b in batches:
                cell, ids = b.column("cell").to_numpy(zero_copy_only=False), b.column("doc_id")
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(cell), len(tables))
                for c in np.unique(cell):
                    who, rows = asked[ends[c] : ends[c + 1]], np.flatnonzero(cell == c)
                    mine = [t[:, who] for t in tables]
                    for s in slices(len(rows), len(who)):
                        at_ = rows[s]
                        scores = np.broadcast_to(base[who, c], (len(at_), len(who))).copy()
                        for m, t in enumerate(mine):
                            scores += t[codes[at_, m]]
                        best.add(ids.take(pa.array(at_)), scores, who)
            if (out := best.batch(number)) is not None:
                yield out

        near = top_ranked(lists.select("doc_id", "code", "cell").mapInArrow(look, f"query_id long, doc_id {id_type}, score double"), most).select("query_id", "doc_id").distinct()
        near = F.broadcast(near) if len(x) * most <= FEW else near

        def exact(batches: Iterator[pa.RecordBatch], x: np.ndarray = x, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(x))
            for b in batches:
                unit = b.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                query = b.column("query_id").to_numpy()
                scores = np.round(np.einsum("ij,ij->i", unit, x[query]), 6)
                for i in np.unique(query):
                    own = query == i
                    best.add(b.column("doc_id").filter(pa.array(own)), scores[own, None], np.array([i]))
            if (out := best.batch(names)) is not None:
                yield out

        parts.append(lists.select("doc_id", "unit").join(near, "doc_id").select("query_id", "doc_id", "unit").mapInArrow(exact, kinds))
    return top_ranked(union(parts, kinds, queries), k)


def visited(queries: DataFrame, at: str, k: int, probes: int | None = None, rerank: int = 20) -> tuple[float, float]:
    """The mean shares of all points whose codes, and whose vectors, a query visits."""
    spark = queries.sparkSession
    q = load(spark, at)
    sizes = {r.cell: r.n for r in spark.read.parquet(f"{at}/lists").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    n, total, count, exact = sum(sizes.values()), 0, 0, 0
    for block in query_blocks(queries.select("query_id", "vector")):
        x, _ = matrix(block["vector"])
        own = [sum(sizes.get(c, 0) for c in row) for row in q.near_cells(x, min(probes or q.probes, len(q.centres))).tolist()]
        total, count, exact = total + sum(own), count + len(own), exact + sum(min(m, rerank * k) for m in own)
    return total / max(1, count * n), exact / max(1, count * n)
