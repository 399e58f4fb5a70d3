"""Sparse search from one pass over the texts: counts by text, multiplied where they lie."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rillworks.operators import search
from rillworks.plans import search as plans

SMALL = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().toString()


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("name", ["q2_sparse_topk", "v5_encode_sparse"])
def test_odd_documents_as_sql(spark, tmp_path, name, repeats):
    """Null texts are in no mean length, texts without tokens are; texts of one id and length are one document, null ids too."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=3 + i % 9)).upper()) for i in range(40)] + [(90 + i, None) for i in range(30)] + [(130, " "), (131, "")]
    if repeats:
        rows += [(3, "a b c"), (3, "a b c"), (3, "a a"), (4, None), (5, " ")] + [(None, "a"), (None, "a"), (None, "b c"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a b zz"), (1, "C c d"), (2, None), (3, "none")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert sorted(map(str, (tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(str, con.execute(plans.ORACLES[name]).fetchall()))


def test_texts_are_read_once(spark, monkeypatch):
    """Tokens are told in what is written, one row a text, and in nothing that follows; rows of ids that don't repeat aren't shuffled by id."""
    docs = spark.createDataFrame([(i, f"a b {i % 4}") for i in range(50)] + [(90, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("1",)], "term string")
    written, write = [], search.cut
    monkeypatch.setattr(search, "cut", lambda x, *n: written.append(x) or write(x, *n))
    for rows in (search.encode_documents(docs, terms=terms), search.encode_sparse(docs)):
        assert "regexp_extract_all" not in plan(rows)
        assert "Exchange" not in plan(rows)
    assert [(x.columns, x.count()) for x in written] == [(["id", "n", "terms", "counts"], 51)] * 2
    assert all(plan(x).split("== Physical Plan ==")[1].count("regexp_extract_all") == 1 for x in written)


@pytest.mark.parametrize("cells,scores,least", [(1 << 22, 1 << 22, 0.1), (6, 7, 0.1), (1 << 22, 30, -1.0), (6, 7, -1.0)])
def test_whole_documents_as_postings(spark, monkeypatch, cells, scores, least):
    """Documents in rows give what their postings do, with weights of any sign, in one matrix or many."""
    from rillworks.operators import vector_blocks

    monkeypatch.setattr(vector_blocks, "CELLS", cells)
    monkeypatch.setattr(vector_blocks, "SCORES", scores)
    rng = random.Random(7)
    docs = [(i if i != 7 else None, ts, [rng.choice([least, 0.5, 1.0, 1.5]) for _ in ts]) for i in range(60) for ts in [sorted({f"t{rng.randrange(40)}" for _ in range(i % 7)})]]
    lists = spark.createDataFrame(docs + [(200, None, None)], "doc_id int, terms array<string>, weights array<double>").repartition(3)
    asked = spark.createDataFrame([(q, f"t{t}", rng.choice([1.0, 2.0, least])) for q in range(8) for t in rng.sample(range(45), 6)] + [(9, "none", 1.0)], "query_id int, term string, weight double")
    postings = lists.select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))
    got, want = (sorted(map(str, search.sparse_topk(asked, x, 4).collect())) for x in (lists, postings))
    assert got == want and len(got) > 20


def test_search_and_rerank(spark):
    """Searching only for queries that have a text gives what searching for all and dropping the others does, and texts are met by the hits where they are read."""
    points, docs, items = plans.points(spark, SMALL), spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    asked = search.encode_sparse(items.withColumnRenamed("item_id", "query_id"), "query_id")
    hits = search.hybrid_search(plans.dense_queries(spark, SMALL), points, asked, search.encode_sparse(docs), 20, docs.select("doc_id"))
    full = hits.select("query_id", "doc_id").join(items.selectExpr("item_id AS query_id", "text AS query"), "query_id").join(docs.selectExpr("doc_id", "text AS child_text", "source AS parent_text"), "doc_id")
    want = search.rerank(full, 4, 0.1, parent="parent_text").select("query_id", "doc_id", "score", "rank")
    most = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(most)
    spark.conf.set(most, "-1")  # as for large tables
    try:
        got = plans.q7_search_and_rerank(spark, SMALL)
        assert "BroadcastHashJoin [doc_id" in plan(got).split("== Physical Plan ==")[1]
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20
    finally:
        spark.conf.set(most, before)
