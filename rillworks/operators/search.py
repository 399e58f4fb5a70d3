"""Dense, sparse and fused retrieval, reranking and context assembly, for many queries at once."""

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vector import let
from .cut import cut
from .vector_blocks import late_interaction, matrix, nearest, sparse_nearest, spherical_kmeans

#: Queries up to which a set of them is sent to all tasks.
QUERIES = 10_000
TOKENS = re.compile(r"\w+|[^\w\s]")


def small(rows: DataFrame, most: int = QUERIES) -> DataFrame:
    """The rows with a broadcast hint if they are at most `most`; beyond that the planner decides."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def top(rows: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", id: str = "doc_id") -> DataFrame:
    """The k rows of each group with the highest score, ties by id, with their rank from 1."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.asc(id))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, points: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by cosine of queries (query_id, vector) and points (doc_id, vector), filtered before ranking.

    The stated queries are held against all points as products of blocks.
    """
    if where is not None:
        points = points.where(where)
    return nearest(queries, points, k)


def hashed_counts(texts: list[str], width: int = 64) -> np.ndarray:
    """Unit vectors of token counts by hash: the embedding that needs no model."""
    out = np.zeros((len(texts), width), np.float32)
    for i, x in enumerate(texts):
        out[i] = np.bincount([zlib.crc32(w.encode()) % width for w in TOKENS.findall(x.lower())], minlength=width)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_dense(rows: DataFrame, text: str = "text", into: str = "vector", fn: Callable[[list[str]], np.ndarray] = hashed_counts) -> DataFrame:
    """The rows with a vector of each text by a user's model, called on Arrow batches; null for null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            known = x.notna().to_numpy()
            vectors = iter(fn(x[known].tolist()) if known.any() else ())
            yield pd.Series([next(vectors) if k else None for k in known], dtype=object)

    return rows.withColumn(into, run(text))


def term_counts(rows: DataFrame, id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """id, n, terms, counts: a row for each text with its number of tokens (null for null) and each token's count, from one pass over the texts; written out, so what follows reads counts. With `terms` (term) only those, unless they are more than are sent to all tasks."""
    asked = None
    if terms is not None:
        most = 100 * QUERIES
        asked = terms.select(F.col("term").cast("string").alias("term")).where("term IS NOT NULL").distinct().limit(most + 1).toArrow()["term"].combine_chunks()
        asked = asked if len(asked) <= most else None

    def count(batches: Iterator[pa.RecordBatch], asked: pa.Array | None = asked) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, known = b.column("t"), b.column("known").to_numpy(zero_copy_only=False)
            n, flat = pc.list_value_length(tokens).to_numpy(zero_copy_only=False), tokens.flatten()
            if asked is None:
                coded = flat.dictionary_encode()
                codes, names, at = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, slice(None)
            else:
                codes, names = pc.index_in(flat, asked), asked
                at = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
                codes = codes.drop_null().to_numpy(zero_copy_only=False)
            width = max(1, len(names))
            keys, counts = np.unique(np.repeat(np.arange(len(n)), n)[at] * width + codes, return_counts=True)
            begins = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * width).astype(np.int32))
            lists = pa.ListArray.from_arrays(begins, names.take(pa.array(keys % width))), pa.ListArray.from_arrays(begins, pa.array(counts))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n.astype(np.int32), mask=~known), *lists], names=["id", "n", "terms", "counts"])

    told = rows.select(F.col(id).alias("id"), F.col(text).isNotNull().alias("known"), t.tokens(F.lower(F.col(text))).alias("t"))
    kind = told.schema["id"].dataType.simpleString()
    return cut(told.mapInArrow(count, f"id {kind}, n int, terms array<string>, counts array<bigint>"), "terms")


def _weighted(counts: DataFrame, k1: float, b: float, mean: float | None) -> tuple[DataFrame, DataFrame | None]:
    """id, terms, weights: a row for each text whose id doesn't repeat; and id, term, weight of the others, if there are any: texts of one id and number of tokens are one document."""
    mean = F.lit(float(mean if mean is not None else counts.agg(F.avg("n")).first()[0] or 1.0))
    weight = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / mean))
    again = small(counts.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    repeats, same = not again.isEmpty(), F.col("id").eqNullSafe(F.col("_id"))
    own = counts.join(again, same, "left_anti") if repeats else counts
    own = own.select("id", "terms", F.transform("counts", weight).alias("weights"))
    if not repeats:
        return own, None
    many = counts.join(again, same, "left_semi").select("id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return own, many.groupBy("id", "n", F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("tf")).select("id", "term", weight(F.col("tf")).alias("weight"))


def encode_sparse(rows: DataFrame, id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, mean: float | None = None, terms: DataFrame | None = None) -> DataFrame:
    """id, term, weight: each token's count saturated by length, as in BM25. `mean` is the mean length; by default that of these rows, null texts aside. With `terms` (term) only postings of those: other tokens go where the texts are read."""
    own, many = _weighted(term_counts(rows, id, text, terms), k1, b, mean)
    out = own.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("id", F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))
    out = out.unionByName(many) if many is not None else out
    if terms is not None:  # also where they are too many to be sent
        out = out.join(small(terms.select("term").distinct(), 100 * QUERIES), "term", "left_semi")
    return out.select(F.col("id").alias(id), "term", "weight")


def encode_documents(rows: DataFrame, id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, mean: float | None = None, terms: DataFrame | None = None) -> DataFrame:
    """id, terms, weights: the postings of `encode_sparse` as one row a document, for `sparse_topk`; those of an id with several texts are summed by term."""
    own, many = _weighted(term_counts(rows, id, text, terms), k1, b, mean)
    if many is not None:
        sums = many.groupBy("id", "term").agg(F.sum("weight").alias("weight")).groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("p"))
        own = own.unionByName(sums.select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")))
    return own.withColumnRenamed("id", id)


def idf_weights(postings: DataFrame, id: str = "doc_id") -> DataFrame:
    """term, idf over the documents of the postings."""
    n = postings.select(id).distinct().count()
    return postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def document_idf(rows: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, idf over documents, as `idf_weights` of their postings, in one pass over the texts: each text's distinct tokens are counted where it is read, so only counts of terms are shuffled.

    Rows of one id and number of tokens are one document, as in postings; rows whose id repeats are told by their ids first and made distinct. A null id counts in no number of documents.
    """
    tokens = lambda x: x.select("id", t.tokens(F.lower("text")).alias("t"))
    own, known = rows.select(F.col(id).alias("id"), F.col(text).alias("text")), F.col("id").isNotNull()
    again = small(rows.groupBy(F.col(id).alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    # an empty term stands for a document with tokens; an outer explode, as the planner filters by the other's argument and so tells the tokens twice
    marked = let(F.array_distinct("t"), lambda x: F.when(F.size(x) > 0, F.concat(x, F.when(known, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))))
    repeats = not again.isEmpty()
    counts = tokens(own.join(again, same, "left_anti") if repeats else own).select(F.explode_outer(marked).alias("term")).where("term IS NOT NULL")
    if repeats:
        many = tokens(own.join(again, same, "left_semi")).where(F.size("t") > 0)
        counts = counts.unionByName(many.select("id", F.size("t").alias("n"), F.explode("t").alias("term")).distinct().select("term"))
        counts = counts.unionByName(many.where(known).select("id").distinct().select(F.lit("").alias("term")))
    counts = cut(counts.groupBy("term").agg(F.count("*").alias("df")), "terms")
    n = (r := counts.where("term = ''").first()) and r.df or 0
    return counts.where("term <> ''").select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int, idf: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by the product of weights over shared terms of queries (query_id, term, weight) and postings (doc_id, term, weight), or one row a document (doc_id, terms, weights)."""
    q = queries.select("query_id", "term", F.col("weight").alias("_w"))
    if idf is not None:
        q = q.join(idf, "term").withColumn("_w", F.col("_w") * F.col("idf"))
    return sparse_nearest(q.select("query_id", "term", F.col("_w").alias("weight")), postings, k)


def rrf(lists: Sequence[DataFrame], k: int = 60, n: int | None = None) -> DataFrame:
    """Ranked lists (query_id, doc_id, rank) fused: the sum of 1 / (k + rank)."""
    out = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("query_id", "doc_id", "rank"))
    fused = out.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"))
    return top(fused, n if n is not None else (1 << 31) - 1)


def hybrid_search(dense_queries: DataFrame, points: DataFrame, sparse_queries: DataFrame, postings: DataFrame, k: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """The k best by fused ranks of the k dense and the k sparse hits; `allowed` (doc_id) filters both sides before ranking."""
    if allowed is not None:
        points, postings = (x.join(allowed.select("doc_id"), "doc_id", "left_semi") for x in (points, postings))
    return rrf([dense_topk(dense_queries, points, k), sparse_topk(sparse_queries, postings, k)], n=k)


def term_coverage(query: Column, text: Column) -> Column:
    """The share of a query's distinct tokens that a text has: the scorer that needs no model."""
    q = F.array_distinct(t.tokens(F.lower(query)))
    return F.size(F.array_intersect(q, t.tokens(F.lower(text)))) / F.nullif(F.size(q), F.lit(0))


def rerank(candidates: DataFrame, n: int = 4, least: float = 0.3, scorer: Callable[[Column, Column], Column] = term_coverage, query: str = "query", text: str = "child_text", parent: str | None = None) -> DataFrame:
    """Candidates scored again, those below `least` dropped, the best child of each parent kept, then the best n; 0 is a threshold like any other."""
    scored = candidates.withColumn("score", F.round(scorer(F.col(query), F.col(text)), 6)).where(F.col("score") >= least)
    if parent:
        w = W.partitionBy("query_id", F.md5(F.col(parent).cast("binary"))).orderBy(F.desc("score"), "doc_id")
        scored = scored.withColumn("_best", F.row_number().over(w)).where("_best = 1").drop("_best")
    return top(scored.drop("rank"), n)


def multi_query_union(hits: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """Hits of query variants (query_id, parent_query) as hits of the parent: each document once, with its best score."""
    best = hits.join(small(variants), "query_id").groupBy("parent_query", "doc_id").agg(F.max("score").alias("score"))
    return top(best, k, ("parent_query",))


def mmr(candidates: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """query_id, doc_id, rank: k candidates (query_id, doc_id, score, vector) of each query, chosen one by one for their score less their likeness to those chosen. A query's candidates are a short list."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(frame["vector"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        score, near, out = frame["score"].to_numpy(), np.zeros(len(v)), []
        while len(out) < min(k, len(v)):
            gain = np.round(weight * score - (1 - weight) * near, 9)
            gain[out] = -np.inf
            out.append(int(gain.argmax()))
            near = np.maximum(near, v @ v[out[-1]]) if len(out) > 1 else v @ v[out[-1]]
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "doc_id": frame["doc_id"].to_numpy()[out], "rank": np.arange(1, len(out) + 1)})

    return candidates.select("query_id", "doc_id", "score", "vector").groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, rank int")


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, k: int) -> DataFrame:
    """Late interaction of query_tokens (query_id, token_no, vector) and doc_tokens (doc_id, vector): the sum of each query token's best cosine."""
    return late_interaction(query_tokens, doc_tokens, k)


def reorder_middle(hits: DataFrame) -> DataFrame:
    """position of each hit: ranks 1, 3, 5 ... from the front, 2, 4, 6 ... from the end."""
    n = F.count("*").over(W.partitionBy("query_id"))
    return hits.withColumn("position", F.when(F.col("rank") % 2 == 1, F.floor((F.col("rank") + 1) / 2)).otherwise(n + 1 - F.floor(F.col("rank") / 2)).cast("long"))


def expand_parent(hits: DataFrame, parents: DataFrame, budget: int) -> DataFrame:
    """Each hit (query_id, rank, parent_id, child_tokens) with what stands in for it within the query's budget of tokens, in order of rank: the parent (parent_id, parent_tokens) while the sum of parents fits, else the child."""
    rows = hits.join(parents, "parent_id")
    w = W.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("choice", F.when(F.sum("parent_tokens").over(w) <= budget, "parent").otherwise("child"))


def expand_siblings(hits: DataFrame, records: DataFrame, section: str, order: str) -> DataFrame:
    """All records of the hits' sections, in order: never the top few only."""
    rows = records.join(hits.select(section).distinct(), section, "left_semi")
    return rows.withColumn("position", F.row_number().over(W.partitionBy(section).orderBy(order)))


def build_context(hits: DataFrame, style: str = "numbered") -> DataFrame:
    """query_id, context from hits with rank, filename, page, text (numbered), also source, year, doc_type, score (scored), or title (plain)."""
    if style == "numbered":
        head = F.format_string("--- Nguồn %d (Tệp: %s, Trang: %d) ---\n", F.col("rank"), F.col("filename"), F.col("page"))
    elif style == "scored":
        head = F.format_string("[%s | %d | %s | %d | Relevance %.2f]\n", F.col("source"), F.col("year"), F.col("doc_type"), F.col("page"), F.col("score"))
    else:
        head = F.concat(F.lit("Source: "), F.col("title"), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(head, F.col("text")).alias("x")))), lambda r: r["x"])
    return hits.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


def with_no_answer(queries: DataFrame, contexts: DataFrame, message: str = "Không có trong tài liệu") -> DataFrame:
    return queries.select("query_id").join(contexts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(message)))


def raw_fallback(companies: DataFrame, fields: Sequence[str], company: str = "company", currency: str = "VND") -> DataFrame:
    """company, context: a company's numbers as lines, for want of hits."""
    lines = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"  {k}: "), F.format_number(F.col(k), 0), F.lit(f" {currency}"))) for k in fields]
    return companies.select(company, F.concat_ws("\n", *lines).alias("context"))


def keyword_lookup(queries: DataFrame, entries: DataFrame, missing: str = "not found") -> DataFrame:
    """query_id, key, content: the first entry (pos, key, content; a short list) whose key, or any word of it, the query contains."""
    low = F.lower("query")
    hit = F.contains(low, F.col("key")) | F.exists(F.split("key", " "), lambda w: F.contains(low, w))
    found = queries.join(small(entries), hit).groupBy("query_id").agg(F.min_by(F.struct("key", "content"), "pos").alias("e"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", "e.key", F.coalesce("e.content", F.lit(missing)).alias("content"))


def confidence_route(hits: DataFrame, sure: float = 0.7, unsure: float = 0.4) -> DataFrame:
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("route", F.when(F.col("best") >= sure, "use").when(F.col("best") >= unsure, "supplement").otherwise("external"))


def cluster_tree(points: DataFrame, k: int = 4, levels: int = 2, sample: int = 1 << 16) -> DataFrame:
    """doc_id, level, node (path of cluster numbers), central: points clustered by vector, each cluster's points again a level below; the central point is nearest to its cluster's centre.

    A level's centres are learned from about `sample` of all points, chosen by a hash, and all its nodes are assigned in one job, which is
    written out. A node of k sampled points or fewer is one cluster. Points without a usable vector are left out.
    """
    kind = points.schema["doc_id"].dataType.simpleString()
    rows = points.select("doc_id", "vector", F.lit("").alias("node"))
    share = F.lit(min(1.0, sample / max(1, rows.count())) * (1 << 20))
    out = None
    for level in range(1, levels + 1):
        chosen = rows.where(F.pmod(F.xxhash64("doc_id", "vector"), F.lit(1 << 20)) < share).select("node", "vector").limit(2 * sample).toArrow()
        nodes = np.array(chosen["node"].to_pylist(), object)
        centres = {}
        for node in sorted(set(nodes)):
            x, _ = matrix(chosen["vector"].combine_chunks().filter(pa.array(nodes == node)))
            if len(x):
                centres[node] = spherical_kmeans(x, k) if len(x) > k else spherical_kmeans(x, 1)

        def assign(batches: Iterator[pa.RecordBatch], centres: dict = centres) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = matrix(b.column("vector"))
                own = np.array(b.column("node").to_pylist(), object)[at]
                number, likeness = np.zeros(len(x), np.int64), np.ones(len(x))
                for node in set(own):
                    if node in centres and centres[node].shape[1] == x.shape[1]:
                        mine = own == node
                        got = x[mine] @ centres[node].T
                        number[mine], likeness[mine] = got.argmax(axis=1), got.max(axis=1)
                names = [f"{node}/{i}".lstrip("/") for node, i in zip(own, number)]
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(at)) for c in ("doc_id", "vector")] + [pa.array(names, pa.string()), pa.array(np.round(likeness, 9))], names=["doc_id", "vector", "node", "likeness"])

        rows = cut(rows.mapInArrow(assign, f"doc_id {kind}, vector {points.schema['vector'].dataType.simpleString()}, node string, likeness double"), "tree")
        best = rows.groupBy("node").agg(F.min(F.struct((-F.col("likeness")).alias("down"), "doc_id"))["doc_id"].alias("best"))
        named = rows.join(F.broadcast(best), "node").select("doc_id", F.lit(level).alias("level"), "node", F.col("doc_id").eqNullSafe(F.col("best")).alias("central"))  # k ** level nodes
        out = named if out is None else out.unionByName(named)
        rows = rows.drop("likeness")
    return out
