"""Vectors as blocks in Arrow batches: nearest points, late interaction and similarity matrices by products of blocks."""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import cut

#: Query vectors that one pass over the points is held against; more queries take more passes.
QUERIES = 4096
#: Scores of a product that are held at once.
SCORES = 1 << 22
#: Rows of a tile of a similarity matrix.
TILE = 2048
#: Rows of a strip of tiles at most, and strips at least: a task holds two strips, and each tile goes to one task for each strip.
STRIP, STRIPS = 1 << 14, 16


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as unit rows in double precision, and the numbers of their rows. Null, zero and not finite vectors, vectors with nulls and those of another width than the first whole one are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not n.any():
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    whole = np.ones(len(n), bool)
    flat = column.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(len(n)), n)
        whole[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(whole & (n > 0))
    if not len(rows):
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    width = n[rows[0]]
    rows = rows[n[rows] == width]
    at = (np.cumsum(n) - n)[rows]
    x = values[at[:, None] + np.arange(width)]
    with np.errstate(over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], rows[good]


class Best:
    """The k best (query, id, score) of each query so far; ties go to the lower id, a null id first."""

    def __init__(self, k: int, n_queries: int) -> None:
        self.k, self.most = k, 3 * k * max(1, n_queries)
        self.query, self.score, self.ids, self.size = [], [], [], 0
        self.least = np.full(n_queries, -np.inf)  # the k-th best as of the last cut

    def add(self, ids: pa.Array, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores: a row for each id, a column for each query, or each of `queries`. What lies below a query's k-th best of these is passed over; of equal ones at the k-th place only the lowest ids go on."""
        if not len(ids):
            return
        k = min(self.k, len(ids))
        kth = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]
        least = self.least if queries is None else self.least[queries]
        row, query = np.nonzero((scores >= np.maximum(kth, least)) & (scores > -np.inf))
        if len(row) > 2 * k * scores.shape[1]:
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            row, query = _first(k, query, scores[row, query], rank[row], row)
        self.query.append(query if queries is None else queries[query])
        self.score.append(scores[row, query])
        self.ids.append(ids.take(pa.array(row)))
        self.size += len(row)
        if self.size > self.most:
            self._cut()

    def _cut(self) -> None:
        query, score, ids = np.concatenate(self.query), np.concatenate(self.score), pa.concat_arrays(self.ids)
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        at, query = _first(self.k, query, score, rank, np.arange(len(query)))
        self.query, self.score, self.ids, self.size = [query], [score[at]], [ids.take(pa.array(at))], len(at)
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, np.int64)
        full = np.diff(last, prepend=-1) == self.k  # in order of query and falling score
        self.least[query[last[full]]] = score[at][last[full]]

    def batch(self, query_ids: pa.Array) -> pa.RecordBatch | None:
        if not self.size:
            return None
        self._cut()
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.query[0])), self.ids[0], pa.array(self.score[0].astype(np.float64))], names=["query_id", "doc_id", "score"])


def _first(k: int, query: np.ndarray, score: np.ndarray, rank: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each query by falling score, then rank: their rows and queries."""
    order = np.lexsort((rank, -score, query))
    begins = np.searchsorted(query[order], query[order])
    stay = order[np.arange(len(order)) - begins < k]
    return row[stay], query[stay]


def query_blocks(queries: DataFrame, most: int = QUERIES) -> Iterator[pa.Table]:
    """The stated queries, `most` at a time or a few more, as local tables: block by block to the driver, then to the tasks of one pass."""
    n = math.ceil(queries.count() / most)
    for i in range(n):
        yield (queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow()


def top_ranked(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def union(parts: Sequence[DataFrame], schema: str, like: DataFrame) -> DataFrame:
    out = parts[0] if parts else like.sparkSession.createDataFrame([], schema)
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def slices(n_rows: int, n_queries: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, n_queries))
    return (slice(lo, lo + step) for lo in range(0, n_rows, step))


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score (cosine, 6 digits), rank: the k nearest points (doc_id, vector) of each query (query_id, vector).

    A block of queries goes to all tasks as one matrix; each task multiplies its batches of points with it and returns k rows a query, which one
    window ranks. Queries without a usable vector have no rows, nor have such points.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {points.schema['doc_id'].dataType.simpleString()}, score double"
    rows, parts = points.select("doc_id", "vector"), []
    for block in query_blocks(queries.select("query_id", "vector")):
        q, own = matrix(block["vector"])
        names = block["query_id"].combine_chunks().take(pa.array(own))

        def run(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(q))
            for b in batches:
                x, at = matrix(b.column("vector"))
                if not len(q) or x.shape[1] != q.shape[1]:
                    continue
                for s in slices(len(x), len(q)):
                    best.add(b.column("doc_id").take(pa.array(at[s])), np.round(x[s] @ q.T, 6))
            if (out := best.batch(names)) is not None:
                yield out

        parts.append(rows.mapInArrow(run, kinds))
    return top_ranked(union(parts, kinds, points), k)


#: Pairs of a task, about, and of a batch that it returns.
TASK_PAIRS, BATCH_PAIRS = 1 << 22, 1 << 17


def plain(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width the vectors of a list column in double precision, as they are, and the numbers of their rows. Null vectors and those with nulls are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()
    whole = column.is_valid().to_numpy(zero_copy_only=False).copy()
    whole[np.repeat(np.arange(len(n)), n)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values, begins, out = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), np.cumsum(n) - n, {}
    for width in np.unique(n[whole]).tolist():
        rows = np.flatnonzero(whole & (n == width))
        out[width] = values[begins[rows][:, None] + np.arange(width)], rows
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL rounds doubles: the scaled double to the nearest integer, halves away from zero; as it is where scaling overflows."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**digits
        whole = np.rint(scaled)
        half = np.abs(scaled - whole) == 0.5
        if half.any():
            whole[half] = np.trunc(scaled[half]) + np.copysign(1.0, scaled[half])
        whole /= 10.0**digits
        return np.where(np.isfinite(whole), whole, x) + 0.0  # no negative zero


def _distances(x: np.ndarray, y: np.ndarray, dots: np.ndarray) -> np.ndarray:
    """From the products where the vectors are far apart for their lengths, else from their differences, as digits would cancel out."""
    with np.errstate(over="ignore", invalid="ignore"):
        sums = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
        squares = sums - 2 * dots
        i, j = np.nonzero(~((squares > 1e-3 * sums) & (sums < np.inf)))
        step = max(1, (1 << 20) // max(1, x.shape[1]))
        for s in range(0, len(i), step):
            at = i[s : s + step], j[s : s + step]
            squares[at] = ((x[at[0]] - y[at[1]]) ** 2).sum(axis=1)
        return np.sqrt(squares)


def similarities(queries: DataFrame, points: DataFrame, digits: int = 5) -> DataFrame:
    """a, b, cosine, dot, euclid of each query (query_id: a, vector) and each point (doc_id: b, vector) of another id.

    A block of queries goes to all tasks as one matrix; points are dealt so that a task has some four million pairs, however few files hold them, and
    returns them in batches of bounded size. The cosine of a zero vector is null, as is all of null vectors, of those with nulls and of two widths.
    """
    kinds = f"a {queries.schema['query_id'].dataType.simpleString()}, b {points.schema['doc_id'].dataType.simpleString()}, cosine double, dot double, euclid double"
    rows, n, parts = points.select("doc_id", "vector"), points.count(), []
    for block in query_blocks(queries.select("query_id", "vector")):
        names, sides = block["query_id"].combine_chunks(), plain(block["vector"])

        def run(batches: Iterator[pa.RecordBatch], names: pa.Array = names, sides: dict = sides) -> Iterator[pa.RecordBatch]:
            m = len(names)
            step = max(1, BATCH_PAIRS // max(1, m))
            for b in batches:
                for lo in range(0, len(b), step):
                    part = b.slice(lo, step)
                    got, known = np.full((3, len(part), m), np.nan), np.zeros((2, len(part), m), bool)
                    for width, (x, own) in plain(part.column("vector")).items():
                        if width in sides:
                            y, at = sides[width]
                            with np.errstate(over="ignore", invalid="ignore"):
                                dots = x @ y.T
                                norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
                                cosines = dots / np.where(norms == 0, np.nan, norms)
                            cells = np.ix_(own, at)
                            known[0][cells], known[1][cells] = norms != 0, True
                            for i, x_ in enumerate((cosines, dots, _distances(x, y, dots))):
                                got[i][cells] = rounded(x_, digits)
                    point, query = pa.array(np.repeat(np.arange(len(part)), m)), pa.array(np.tile(np.arange(m), len(part)))
                    values = [pa.array(x.ravel(), mask=~known[min(i, 1)].ravel()) for i, x in enumerate(got)]
                    yield pa.RecordBatch.from_arrays([names.take(query), part.column("doc_id").take(point), *values], names=["a", "b", "cosine", "dot", "euclid"])

        if len(names):
            parts.append(rows.repartition(max(1, min(1 << 15, math.ceil(n * len(names) / TASK_PAIRS)))).mapInArrow(run, kinds))
    return union(parts, kinds, points).where("a != b")


#: Query postings of one pass, about, and numbers of a block's matrix of terms and queries.
POSTINGS, CELLS = 1 << 14, 1 << 22


def _term_matrices(block: pa.Table) -> list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Query ids, terms, weights and where there are any, as matrices of terms and queries of a bounded size."""
    table = block.sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
    of = table["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    query, weight, term = of.indices.to_numpy(zero_copy_only=False), table["weight"].to_numpy(), table["term"].combine_chunks()
    out, lo, n = [], 0, len(of.dictionary)
    while lo < n:
        hi = n
        while True:
            rows = (query >= lo) & (query < hi)
            own = term.filter(pa.array(rows)).dictionary_encode()
            if hi == lo + 1 or (hi - lo) * len(own.dictionary) <= CELLS:
                break
            hi = lo + max(1, (hi - lo) // 2)
        m, there = np.zeros((len(own.dictionary), hi - lo)), np.zeros((len(own.dictionary), hi - lo), bool)
        at = own.indices.to_numpy(zero_copy_only=False), query[rows] - lo
        np.add.at(m, at, weight[rows])
        there[at] = True
        out.append((of.dictionary.slice(lo, hi - lo), own.dictionary, m, there))
        lo = hi
    return out


def sparse_nearest(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k documents of postings (doc_id, term, weight) with the largest product with each query (query_id, term, weight); documents without a shared term are absent.

    Postings of terms that no query of the pass has go first; the rest are dealt by document, whose rows a task multiplies with the pass's
    matrix of terms and queries, keeping k a query. No row is made for a pair of query and document. Postings that come as one row a
    document (doc_id, terms, weights) are multiplied where they lie.
    """
    doc_kind = postings.schema["doc_id"].dataType.simpleString()
    kinds, parts = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {doc_kind}, score double", []
    for block in query_blocks(queries.select("query_id", "term", F.col("weight").cast("double").alias("weight")).where("term IS NOT NULL"), POSTINGS):
        if not len(block):
            continue
        matrices = _term_matrices(block)
        if "terms" in postings.columns:
            whole = postings.select("doc_id", "terms", F.col("weights").cast("array<double>").alias("weights")).where("terms IS NOT NULL AND weights IS NOT NULL")
            parts.append(whole.mapInArrow(lambda batches, matrices=matrices: _whole_documents(batches, matrices, k), kinds))
            continue

        def run(batches: Iterator[pa.RecordBatch], matrices: list = matrices) -> Iterator[pa.RecordBatch]:
            best, held = [Best(k, len(x[0])) for x in matrices], None

            def score(rows: pa.Table) -> None:
                of = rows["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode")
                doc, weight = of.indices.to_numpy(zero_copy_only=False), rows["weight"].to_numpy()
                for b, (_, terms, m, there) in zip(best, matrices):
                    at = pc.index_in(rows["term"].combine_chunks(), terms)
                    known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                    at = at.drop_null().to_numpy(zero_copy_only=False)
                    for s in slices(len(known), m.shape[1]):  # a document may go on in the next slice
                        ids, begins = np.unique(doc[known[s]], return_index=True)
                        got = np.add.reduceat(m[at[s]] * weight[known[s], None], begins, axis=0)
                        hit = np.logical_or.reduceat(there[at[s]], begins, axis=0)
                        sums.setdefault(id(b), []).append((ids, got, hit))
                    _add_sums(b, of.dictionary, sums.pop(id(b), []))

            sums: dict[int, list] = {}
            for batch in batches:
                rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if not len(rows):
                    continue
                last = rows["doc_id"][len(rows) - 1]
                same = pc.equal(rows["doc_id"], last) if last.is_valid else pc.is_null(rows["doc_id"])
                begins = pc.index(same.combine_chunks() if isinstance(same, pa.ChunkedArray) else same, True).as_py()
                if begins:
                    score(rows.slice(0, begins))
                held = rows.slice(begins)
            if held is not None and len(held):
                score(held)
            for b, (names, *_) in zip(best, matrices):
                if (out := b.batch(names)) is not None:
                    yield out

        wanted = [t for _, terms, *_ in matrices for t in terms.to_pylist()]
        spark = postings.sparkSession
        asked = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(sorted(set(wanted)), pa.string())})))  # of one block
        dealt = postings.select("doc_id", "term", F.col("weight").cast("double").alias("weight")).join(asked, "term", "left_semi").select("doc_id", "term", "weight")
        parts.append(dealt.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, kinds))
    return top_ranked(union(parts, kinds, postings), k)


def _whole_documents(batches: Iterator[pa.RecordBatch], matrices: list, k: int) -> Iterator[pa.RecordBatch]:
    """The k best (query_id, doc_id, score) of a task's rows of doc_id, terms, weights, as products of slices of documents and terms with each matrix of terms and queries."""
    best = [Best(k, len(x[0])) for x in matrices]
    for b in batches:
        lists, weights = b.column("terms"), b.column("weights").flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        for x, (_, terms, m, there) in zip(best, matrices):
            at = pc.index_in(lists.flatten(), terms)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            own, weight, at = doc[known], weights[known], at.drop_null().to_numpy(zero_copy_only=False)
            positive = (m[there] > 0).all() and (weight > 0).all()
            step = max(1, SCORES // max(1, *m.shape))
            for lo in range(0, len(b), step):
                s, n = slice(*np.searchsorted(own, [lo, lo + step])), min(step, len(b) - lo)
                cells = (own[s] - lo) * len(m) + at[s]
                got = np.bincount(cells, weight[s], n * len(m)).reshape(n, -1) @ m
                hit = got > 0 if positive else np.bincount(cells, minlength=n * len(m)).reshape(n, -1).astype(float) @ there > 0
                x.add(b.column("doc_id").slice(lo, n), np.where(hit, np.round(got, 6), -np.inf))
    for x, (names, *_) in zip(best, matrices):
        if (out := x.batch(names)) is not None:
            yield out


def _add_sums(best: Best, ids: pa.Array, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Scores of documents, whose sums may lie in parts of which only neighbours share one."""
    for n, (own, got, hit) in enumerate(parts):
        if n and len(own) and own[0] == parts[n - 1][0][-1]:
            got[0] += parts[n - 1][1][-1]
            hit[0] |= parts[n - 1][2][-1]
        whole = slice(0, len(own) - (n + 1 < len(parts) and len(own) > 0 and own[-1] == parts[n + 1][0][0]))
        best.add(ids.take(pa.array(own[whole])), np.where(hit[whole], np.round(got[whole], 6), -np.inf))


def late_interaction(query_tokens: DataFrame, doc_tokens: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: documents (doc_id, vector: a row for each token) by the sum over a query's tokens (query_id, token_no, vector) of the best cosine.

    Tasks keep the best cosines of each of their documents as one row, whatever the number of its tokens; those rows are dealt by document, so a
    document with a third of all tokens sends one row a task. Then a task keeps k rows a query.
    """
    doc_kind = doc_tokens.schema["doc_id"].dataType.simpleString()
    kinds = f"query_id {query_tokens.schema['query_id'].dataType.simpleString()}, doc_id {doc_kind}, score double"
    rows, parts = doc_tokens.select("doc_id", "vector"), []
    for block in query_blocks(query_tokens.select("query_id", "token_no", "vector")):  # by query_id, so a query's tokens stay together
        q, own = matrix(block["vector"])
        of = block["query_id"].combine_chunks().take(pa.array(own)).dictionary_encode()
        codes, names = of.indices.to_numpy(zero_copy_only=False), of.dictionary
        order = np.argsort(codes, kind="stable")
        q, begins = q[order], np.searchsorted(codes[order], np.arange(len(names)))

        def partial(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = matrix(b.column("vector"))
                if not len(q) or x.shape[1] != q.shape[1]:
                    continue
                ids = b.column("doc_id").take(pa.array(at))
                for s in slices(len(x), len(q)):
                    yield _tops(ids.slice(s.start, s.stop - s.start), x[s] @ q.T)

        def total(batches: Iterator[pa.RecordBatch], n: int = len(q), begins: np.ndarray = begins, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            best, held = Best(k, len(names)), None
            for b in _whole(batches):
                tops = np.frombuffer(b"".join(b.column("tops").to_pylist()), np.float64).reshape(-1, n)
                for s in slices(len(tops), n):  # a document's rows may go on in the next slice
                    held = _merged(held, _tops(b.column("doc_id").slice(s.start, s.stop - s.start), tops[s]))
                    done = held.slice(0, len(held) - 1)
                    best.add(done.column("doc_id"), _sums(done, n, begins))
                    held = held.slice(len(held) - 1)
            if held is not None:
                best.add(held.column("doc_id"), _sums(held, n, begins))
            if (out := best.batch(names)) is not None:
                yield out

        dealt = rows.mapInArrow(partial, f"doc_id {doc_kind}, tops binary").repartition("doc_id").sortWithinPartitions("doc_id")
        parts.append(dealt.mapInArrow(total, kinds))
    return top_ranked(union(parts, kinds, doc_tokens), k)


def _tops(ids: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    """doc_id, tops: the greatest scores of each id, in the order in which ids come first."""
    of = ids.dictionary_encode(null_encoding="encode")
    codes = of.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    tops = np.maximum.reduceat(scores[order], np.searchsorted(codes[order], np.arange(len(of.dictionary))), axis=0)
    return pa.RecordBatch.from_arrays([of.dictionary, pa.array([x.tobytes() for x in tops], pa.binary())], names=["doc_id", "tops"])


def _merged(held: pa.RecordBatch | None, new: pa.RecordBatch) -> pa.RecordBatch:
    if held is None:
        return new
    both = pa.Table.from_batches([held, new]).combine_chunks()
    tops = np.stack([np.frombuffer(x, np.float64) for x in both["tops"].to_pylist()])
    return _tops(both["doc_id"].combine_chunks(), tops)


def _sums(rows: pa.RecordBatch, n: int, begins: np.ndarray) -> np.ndarray:
    tops = np.frombuffer(b"".join(rows.column("tops").to_pylist()), np.float64).reshape(-1, n)
    return np.round(np.add.reduceat(tops, begins, axis=1), 6)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if len(b))


def similarity_matrix(points: DataFrame, least: float, tile: int = TILE, sample: int = 1 << 14) -> DataFrame:
    """a, b, cosine (6 digits) of all pairs of points (doc_id, vector) with a < b and a cosine of `least` or more. There is no matrix without a bound.

    Points are ordered by the nearest of some directions, learned from a sample of at most about `sample` rows, and cut into tiles of some `tile`
    rows; any order gives the same pairs, a good one makes tiles narrow. A tile has a centre and the widest angle to it, so a pair of tiles whose
    centres are too far apart for `least` is never formed. The rest are dealt to tasks by pairs of strips of tiles, each pair of tiles a product of two
    matrices; equal ids pair with no one. A direction with a third of all points is cut into as many tiles as it needs.
    """
    if not -1 <= least <= 1:
        raise ValueError("a cosine lies between -1 and 1")
    kind = points.schema["doc_id"].dataType.simpleString()
    rows = points.select("doc_id", "vector")
    n = rows.count()
    centres = directions(rows, max(1, min(256, n // tile)), n, sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = matrix(b.column("vector"))
            own = (x @ centres.T).argmax(axis=1) if len(x) and len(centres) and x.shape[1] == centres.shape[1] else np.zeros(len(x), np.int64)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(own, pa.int32()), out], names=["doc_id", "cell", "unit"])

    placed = rows.mapInArrow(place, f"doc_id {kind}, cell int, unit array<double>")
    cells = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each direction
    first, tiles = {}, 0
    for c in sorted(cells):
        first[c], tiles = tiles, tiles + math.ceil(cells[c] / tile)
    number = F.lit(0).cast("long")
    if cells:
        lookup = F.create_map(*(F.lit(v) for c in cells for v in (c, first[c]))), F.create_map(*(F.lit(v) for c in cells for v in (c, math.ceil(cells[c] / tile))))
        number = (lookup[0][F.col("cell")] + F.pmod(F.xxhash64("doc_id"), lookup[1][F.col("cell")])).cast("long")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = t["doc_id"].combine_chunks(), t["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        centre = x.sum(axis=0)
        centre /= np.linalg.norm(centre) or 1.0
        wide = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) if centre.any() else math.pi
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), lists, pa.array([x.tobytes()], pa.binary()), pa.array([centre.tolist()]), pa.array([wide])], names=["tile", "ids", "x", "centre", "wide"])

    # tiles are read for pairs and for each side
    packed = cut(placed.withColumn("tile", number).groupBy("tile").applyInArrow(pack, f"tile long, ids array<{kind}>, x binary, centre array<double>, wide double"), "tiles")
    close = close_tiles(packed.select("tile", "centre", "wide"), tiles, least)
    strip = max(1, min(STRIP // tile, math.ceil(tiles / STRIPS)))
    dealt = dealt_tiles(packed, cut(close, "close"), strip)

    def product(left: tuple[pa.Array, np.ndarray], right: tuple[pa.Array, np.ndarray], same: bool) -> Iterator[pa.RecordBatch]:
        (a, x), (b, y) = left, right
        for s in slices(len(x), len(y)) if x.shape[1] == y.shape[1] else ():
            got = np.round(x[s] @ y.T, 6)
            p, q = np.nonzero(got >= least)
            if same:
                p, q = p[q > p + s.start], q[q > p + s.start]
            if len(p):
                yield pa.RecordBatch.from_arrays([a.take(pa.array(p + s.start)), b.take(pa.array(q)), pa.array(got[p, q])], names=["a", "b", "cosine"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for b in batches:
            for r in range(len(b)):
                here, i, others = (b.column("si")[r].as_py(), b.column("sj")[r].as_py()), b.column("tile")[r].as_py(), b.column("others")[r].as_py()
                if here != cell:
                    cell, held = here, {}
                if others is None:
                    ids = b.column("ids").slice(r, 1).flatten()
                    held[i] = ids, np.frombuffer(b.column("x")[r].as_py(), np.float64).reshape(len(ids), -1)
                for j in others or ():
                    yield from product(held[i], held[j], i == j)

    cells = math.ceil(tiles / strip) * (math.ceil(tiles / strip) + 1) // 2
    dealt = dealt.repartition(max(1, min(cells, 1 << 15)), "si", "sj").sortWithinPartitions("si", "sj", F.col("others").isNotNull(), "tile")
    found = dealt.mapInArrow(multiply, f"a {kind}, b {kind}, cosine double").where("a != b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def dealt_tiles(packed: DataFrame, close: DataFrame, strip: int) -> DataFrame:
    """si, sj, tile, others, ids, x: for each two strips of `strip` tiles that have close tiles (i, j), each of these once, then for each first tile the others that it meets; so a tile is copied once for each strip, not for each tile near it."""
    at = [F.floor(F.col(c) / strip).alias(f"s{c}") for c in "ij"]
    pairs = close.groupBy(*at, F.col("i").alias("tile")).agg(F.collect_list("j").alias("others"))  # at most a strip's tiles
    wanted = close.select(*at, F.explode(F.array("i", "j")).alias("tile")).distinct()
    return wanted.join(packed.select("tile", "ids", "x"), "tile").select("si", "sj", "tile", F.lit(None).cast("array<bigint>").alias("others"), "ids", "x").unionByName(pairs, allowMissingColumns=True)


def close_tiles(heads: DataFrame, n: int, least: float) -> DataFrame:
    """i, j: the pairs of n tiles (tile, centre, wide), i <= j, whose vectors may have a cosine of `least`: the angle of their centres less the widest angles to them isn't beyond it."""
    pairs = heads.select(F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(max(0, n - 1)).cast("long"))).alias("j"))
    for side in ("i", "j"):
        pairs = pairs.join(heads.select(F.col("tile").alias(side), F.col("centre").alias(f"centre_{side}"), F.col("wide").alias(f"wide_{side}")), side)
    product = F.aggregate(F.zip_with("centre_i", "centre_j", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product))) - F.col("wide_i") - F.col("wide_j")
    return pairs.where(apart <= math.acos(max(-1.0, least - 1e-6)) + 1e-6).select("i", "j")


def directions(rows: DataFrame, k: int, n: int, sample: int) -> np.ndarray:
    """k unit vectors: some rounds of spherical k-means on about `sample` of the n rows (doc_id, vector), chosen by a hash of the id, so at most that many reach the driver whatever n is."""
    return spherical_kmeans(sampled(rows, n, sample), k)


def sampled(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """About `most` of the n rows' unit vectors, twice that at the very most, by a hash of doc_id and vector: the same ones at every run."""
    share = min(1.0, most / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "vector"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * most).select("vector").toArrow()
    return matrix(chosen["vector"])[0]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most k unit rows; one without members is set to a row that is far from its own."""
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own, best = np.zeros(len(x), np.int64), np.zeros(len(x))
        for s in slices(len(x), len(centres)):
            got = x[s] @ centres.T
            own[s], best[s] = got.argmax(axis=1), got.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        norm[empty] = 1.0
        centres = sums / norm[:, None]
    return centres
