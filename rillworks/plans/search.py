"""Search queries: embeddings as points, documents as postings; as queries all benchmark items and the vectors whose id is divisible by 100."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vector as v
from ..operators import search as s
from ..operators import vector_blocks as vb
from ..operators import vector_index as vi
from ..operators.cut import cut, scratch
from .finance import companies, table
from .finance import _BASE


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def dense_queries(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")


def _dense(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return s.dense_topk(dense_queries(spark, d), points(spark, d), k)


def _documents(spark: SparkSession, d: str, terms: DataFrame) -> DataFrame:
    """Postings of the queries' terms, a row for each document."""
    return s.encode_documents(table(spark, d, "documents").select("doc_id", "text"), terms=terms)


def _sparse_queries(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return s.encode_sparse(items, "query_id")


def _sparse(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    asked = _sparse_queries(spark, d)
    return s.sparse_topk(asked, _documents(spark, d, asked), k)


def q1_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return s.dense_topk(dense_queries(spark, d), points(spark, d), 10, F.col("label") < 5)


def q2_sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d).select("query_id", "doc_id", F.round("score", 3).alias("score"))


def q3_rrf(spark: SparkSession, d: str) -> DataFrame:
    return s.rrf([_dense(spark, d), _sparse(spark, d)], n=20).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def q4_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return s.hybrid_search(dense_queries(spark, d), points(spark, d), (asked := _sparse_queries(spark, d)), _documents(spark, d, asked), 10, allowed).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each document for the item of its number modulo the number of items; its parent is the source."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return docs.withColumn("query_id", F.col("doc_id") % items.count()).join(queries, "query_id").select("query_id", "query", "doc_id", F.col("text").alias("child_text"), F.concat("source", F.lit("/"), "lang").alias("parent_text"))


def q5_rerank(spark: SparkSession, d: str) -> DataFrame:
    return s.rerank(_candidates(spark, d)).select("query_id", "doc_id", "score", "rank")


def q6_dedupe_parent(spark: SparkSession, d: str) -> DataFrame:
    return s.rerank(_candidates(spark, d), 5, 0.0, parent="parent_text").select("query_id", "doc_id", "score", "rank")


def q7_search_and_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Only queries with a text can be reranked, so vectors without one aren't searched for."""
    docs = table(spark, d, "documents")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    dense = dense_queries(spark, d).join(s.small(queries.select("query_id")), "query_id", "left_semi")
    # all documents are allowed: their own postings are, but for those without an id
    allowed = points(spark, d).join(docs.select("doc_id"), "doc_id", "left_semi")
    hits = s.hybrid_search(dense, allowed, (asked := _sparse_queries(spark, d)), _documents(spark, d, asked).where("doc_id IS NOT NULL"), 20)
    hits = s.small(cut(hits.select("query_id", "doc_id"), "hits").join(queries, "query_id"))
    full = docs.select("doc_id", F.col("text").alias("child_text"), F.col("source").alias("parent_text")).join(hits, "doc_id")
    return s.rerank(full, 4, 0.1, parent="parent_text").select("query_id", "doc_id", "score", "rank")


def q8_multi_query_union(spark: SparkSession, d: str) -> DataFrame:
    hits = s.dense_topk(dense_queries(spark, d), points(spark, d), 10)
    variants = dense_queries(spark, d).select("query_id", F.expr("query_id div 200").alias("parent_query"))
    return s.multi_query_union(hits, variants, 10)


def q9_mmr(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d).select("query_id", "doc_id", "score").join(points(spark, d), "doc_id")
    return s.mmr(hits, 5)


def q10_maxsim(spark: SparkSession, d: str) -> DataFrame:
    q = points(spark, d).where("doc_id % 100 = 0").select(F.expr("doc_id div 300").alias("query_id"), F.expr("doc_id div 100 % 3").alias("token_no"), "vector")
    return s.maxsim(q, points(spark, d).select(F.expr("doc_id div 5").alias("doc_id"), "vector"), 10)


def q11_reorder_middle(spark: SparkSession, d: str) -> DataFrame:
    return s.reorder_middle(_dense(spark, d, 7)).select("query_id", "doc_id", "position")


def q12_expand_parent(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d, 8).select("query_id", "rank", F.col("doc_id").alias("parent_id"))
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), t.count_tokens(F.col("text")).alias("parent_tokens"))
    return s.expand_parent(hits, parents, 1500).select("query_id", "rank", "choice")


def q13_expand_siblings(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "documents").select("source", "doc_id")
    hits = _dense(spark, d, 1).select("doc_id").join(records, "doc_id")
    return s.expand_siblings(hits, records, "source", "doc_id").select("source", "doc_id", "position")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("filename"), (F.col("doc_id") % 9).cast("int").alias("page"), "text")
    return _dense(spark, d, 4).join(docs, "doc_id")


def q14_build_context(spark: SparkSession, d: str) -> DataFrame:
    return s.build_context(_pages(spark, d)).select("query_id", F.md5("context").alias("context"))


def q15_no_answer(spark: SparkSession, d: str) -> DataFrame:
    contexts = s.build_context(_pages(spark, d).where("score >= 0.9 AND query_id % 200 = 0").withColumn("title", F.col("filename")), "plain")
    return s.with_no_answer(dense_queries(spark, d), contexts)


def q16_raw_fallback(spark: SparkSession, d: str) -> DataFrame:
    return s.raw_fallback(companies(spark, d).where("company % 5 <> 0").withColumn("ebit", F.when(F.col("company") % 7 != 0, F.floor("ebit"))).withColumn("revenue", F.floor("revenue")), ["revenue", "ebit"])


def q17_keyword_lookup(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame([(1, "refund policy", "A"), (2, "the", "B"), (3, "order", "C")], "pos int, key string, content string")
    return s.keyword_lookup(table(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn").alias("query_id"), F.col("text").alias("query")), entries)


def q18_confidence_route(spark: SparkSession, d: str) -> DataFrame:
    return s.confidence_route(s.dense_topk(dense_queries(spark, d), points(spark, d).where("doc_id % 100 <> 0"), 3), 0.33, 0.3)


def q19_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every hundredth vector, against all."""
    at = scratch(spark, "index")
    vi.build_index(points(spark, d), at)
    return vi.search_index(dense_queries(spark, d), at, 10)


def q20_cluster_tree(spark: SparkSession, d: str) -> DataFrame:
    return s.cluster_tree(points(spark, d))


def v1_embed_dense(spark: SparkSession, d: str) -> DataFrame:
    return s.embed_dense(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.round(v.l2_norm(F.col("vector")), 6).alias("norm"), F.size("vector").alias("width"))


def v2_norms(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("vector")
    return points(spark, d).select("doc_id", F.round(v.l1_norm(e), 5).alias("l1"), F.round(v.l2_norm(e), 5).alias("l2"), F.round(v.l2_normalize(e)[0], 5).alias("first"))


def v3_v4_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Cosine, dot product and distance of every hundredth vector to all others."""
    return vb.similarities(dense_queries(spark, d), points(spark, d))


def v4_similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors from a cosine of 0.35 on."""
    return vb.similarity_matrix(points(spark, d), 0.35, 256)


def v5_encode_sparse(spark: SparkSession, d: str) -> DataFrame:
    return s.encode_sparse(table(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 4).alias("weight"))


def v6_idf_weight(spark: SparkSession, d: str) -> DataFrame:
    return s.document_idf(table(spark, d, "documents")).select("term", F.round("idf", 6).alias("idf"))


QUERIES = {q.__name__: q for q in (
    q1_dense_topk, q2_sparse_topk, q3_rrf, q4_hybrid_search, q5_rerank, q6_dedupe_parent, q7_search_and_rerank, q8_multi_query_union, q9_mmr, q10_maxsim, q11_reorder_middle, q12_expand_parent, q13_expand_siblings, q14_build_context,
    q15_no_answer, q16_raw_fallback, q17_keyword_lookup, q18_confidence_route, q19_ann_topk, q20_cluster_tree, v1_embed_dense, v2_norms, v3_v4_similarities, v4_similarity_matrix, v5_encode_sparse, v6_idf_weight,
)}


def _cos(a: str, b: str) -> str:
    return f"ROUND(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def _dense_sql(k: int, where: str = "TRUE", name: str = "dense") -> str:
    return f"{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS doc_id, {_cos('q.embedding', 'p.embedding')} AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0 AND ({where})) QUALIFY rank <= {k})"


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


def _bm25(source: str, id: str, name: str) -> str:
    return (
        f"{name}_t AS (SELECT {id}, {_TOK} AS t FROM {source}), {name}_m AS (SELECT AVG(len(t)) AS m FROM {name}_t), {name}_f AS (SELECT {id}, n, term, COUNT(*) AS tf FROM (SELECT {id}, len(t) AS n, UNNEST(t) AS term FROM {name}_t) GROUP BY 1, 2, 3), "
        f"{name} AS (SELECT {id}, term, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n / m)) AS weight FROM {name}_f, {name}_m)"
    )


_SPARSE = f"{_bm25('documents', 'doc_id', 'post')}, {_bm25('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id', 'ask')}"


def _sparse_sql(k: int, where: str = "TRUE") -> str:
    return f"{_SPARSE}, sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.query_id, p.doc_id, ROUND(SUM(p.weight * a.weight), 6) AS score FROM post p JOIN ask a USING (term) WHERE {where} GROUP BY 1, 2) QUALIFY rank <= {k})"


_CAND = "cand AS (SELECT item_id AS query_id, b.text AS query, d.doc_id, d.text AS child_text, source || '/' || lang AS parent_text FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT COUNT(*) FROM benchmark))"
_TOKS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"
_COVER = f"ROUND(len(list_intersect(list_distinct({_TOKS.format('query')}), {_TOKS.format('child_text')})) / len(list_distinct({_TOKS.format('query')})), 6)"
_EN = "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"

ORACLES = {
    "q1_dense_topk": f"WITH {_dense_sql(10, where='p.label < 5')} SELECT * FROM dense",
    "q2_sparse_topk": f"WITH {_sparse_sql(20)} SELECT query_id, doc_id, ROUND(score, 3) AS score FROM sparse",
    "q3_rrf": f"WITH {_dense_sql(20)}, {_sparse_sql(20)}, f AS (SELECT query_id, doc_id, ROUND(SUM(1e0 / (60 + rank)), 10) AS score FROM (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM sparse) GROUP BY 1, 2) SELECT query_id, doc_id, ROUND(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, doc_id) <= 20",
    "q4_hybrid_search": f"WITH {_dense_sql(10, where='p.vec_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')}, {_sparse_sql(10, 'p.' + _EN)}, f AS (SELECT query_id, doc_id, ROUND(SUM(1e0 / (60 + rank)), 10) AS score FROM (SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM sparse) GROUP BY 1, 2) SELECT query_id, doc_id, ROUND(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, doc_id) <= 10",
    "q5_rerank": f"WITH {_CAND}, sc AS (SELECT query_id, doc_id, {_COVER} AS score FROM cand) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score >= 0.3 QUALIFY rank <= 4",
    "q6_dedupe_parent": f"WITH {_CAND}, sc AS (SELECT query_id, doc_id, parent_text, {_COVER} AS score FROM cand), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, parent_text ORDER BY score DESC, doc_id) = 1) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 5",
    "q8_multi_query_union": f"WITH {_dense_sql(10)}, b AS (SELECT query_id // 200 AS parent_query, doc_id, MAX(score) AS score FROM dense GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY parent_query ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 10",
    "q10_maxsim": "WITH q AS (SELECT vec_id // 300 AS query_id, vec_id // 100 % 3 AS token_no, embedding AS x FROM embeddings WHERE vec_id % 100 = 0), m AS (SELECT query_id, vec_id // 5 AS doc_id, token_no, MAX(list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[])) AS m FROM q, embeddings GROUP BY 1, 2, 3), f AS (SELECT query_id, doc_id, ROUND(SUM(m), 6) AS score FROM m GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10",
    "q11_reorder_middle": f"WITH {_dense_sql(7)} SELECT query_id, doc_id, CASE rank WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 7 THEN 4 WHEN 6 THEN 5 WHEN 4 THEN 6 ELSE 7 END AS position FROM dense",
    "q12_expand_parent": f"WITH {_dense_sql(8)}, p AS (SELECT doc_id AS parent_id, len({_TOK}) AS n FROM documents) SELECT query_id, rank, CASE WHEN SUM(n) OVER (PARTITION BY query_id ORDER BY rank) <= 1500 THEN 'parent' ELSE 'child' END AS choice FROM dense JOIN p ON doc_id = parent_id",
    "q13_expand_siblings": f"WITH {_dense_sql(1)} SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents WHERE source IN (SELECT source FROM dense JOIN documents USING (doc_id))",
    "q14_build_context": f"WITH {_dense_sql(4)} SELECT query_id, md5(string_agg('--- Nguồn ' || rank || ' (Tệp: ' || source || ', Trang: ' || doc_id % 9 || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM dense JOIN documents USING (doc_id) GROUP BY 1",
    "q15_no_answer": f"WITH {_dense_sql(4)}, c AS (SELECT query_id, string_agg('Source: ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM dense JOIN documents USING (doc_id) WHERE score >= 0.9 AND query_id % 200 = 0 GROUP BY 1) SELECT vec_id AS query_id, COALESCE(context, 'Không có trong tài liệu') AS context FROM embeddings LEFT JOIN c ON query_id = vec_id WHERE vec_id % 100 = 0",
    "q16_raw_fallback": f"WITH {_BASE} SELECT company, concat_ws(chr(10), '  revenue: ' || format('{{:,}}', CAST(floor(revenue) AS BIGINT)) || ' VND', CASE WHEN company % 7 <> 0 THEN '  ebit: ' || format('{{:,}}', CAST(floor(ebit) AS BIGINT)) || ' VND' END) AS context FROM companies WHERE company % 5 <> 0",
    "q17_keyword_lookup": "WITH q AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS q FROM conversations), e AS (SELECT query_id, CASE WHEN contains(q, 'refund') OR contains(q, 'policy') THEN 1 WHEN contains(q, 'the') THEN 2 WHEN contains(q, 'order') THEN 3 END AS pos FROM q), f AS (SELECT query_id, min(pos) AS pos FROM e GROUP BY 1) SELECT e.query_id, CASE f.pos WHEN 1 THEN 'refund policy' WHEN 2 THEN 'the' WHEN 3 THEN 'order' END AS key, CASE f.pos WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'not found' END AS content FROM e JOIN f USING (query_id)",
    "q18_confidence_route": f"WITH {_dense_sql(3, 'p.vec_id % 100 <> 0')}, b AS (SELECT query_id, MAX(score) AS best FROM dense GROUP BY 1) SELECT *, CASE WHEN best >= 0.33 THEN 'use' WHEN best >= 0.3 THEN 'supplement' ELSE 'external' END AS route FROM b",
    "v1_embed_dense": r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '\S') THEN 1e0 ELSE 0e0 END AS norm, CASE WHEN text IS NOT NULL THEN 64 END AS width FROM documents",
    "v2_norms": "WITH x AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT doc_id, ROUND(list_sum(list_transform(e, lambda x: abs(x))), 5) AS l1, ROUND(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS l2, ROUND(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS first FROM x",
    "v3_v4_similarities": "SELECT p.vec_id AS a, q.vec_id AS b, ROUND(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine, ROUND(list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS dot, ROUND(list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS euclid FROM embeddings p JOIN embeddings q ON p.vec_id <> q.vec_id WHERE p.vec_id % 100 = 0",
    "v4_similarity_matrix": f"SELECT * FROM (SELECT p.vec_id AS a, q.vec_id AS b, {_cos('p.embedding', 'q.embedding')} AS cosine FROM embeddings p JOIN embeddings q ON p.vec_id < q.vec_id) WHERE cosine >= 0.35",
    "v5_encode_sparse": f"WITH {_bm25('documents', 'doc_id', 'post')} SELECT doc_id, COUNT(*) AS n_terms, ROUND(SUM(weight), 4) AS weight FROM post GROUP BY 1",
    "v6_idf_weight": f"WITH {_bm25('documents', 'doc_id', 'post')}, n AS (SELECT COUNT(DISTINCT doc_id) AS n FROM post) SELECT term, ROUND(ln((n - COUNT(*) + 0.5e0) / (COUNT(*) + 0.5e0) + 1), 6) AS idf FROM post, n GROUP BY term, n",
}
