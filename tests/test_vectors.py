"""Block products, similarity matrices and inverted lists against plain searches."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillworks.operators import search, vector_blocks, vector_index
from rillworks.plans import search as plans

KIND = "doc_id long, vector array<float>"


def mixture(n, width, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [[float(v) for v in x] for x in (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)]


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)


def usable(v, width):
    return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v)


ODD = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [math.nan, 1.0, 0.0, 0.0], [math.inf, 1.0, 0.0, 0.0], [1.0, 0.0]]


def table(spark, rows, kind=KIND, parts=5):
    return spark.createDataFrame(rows, kind).repartition(parts)


def plain_nearest(queries, points, k):
    out = []
    for q, v in queries:
        own = sorted((-cosine(v, p), i is not None, i or 0, i) for i, p in points if usable(p, len(v)))[:k]
        out += [(q, i, -s, n) for n, (s, _, _, i) in enumerate(own, 1)]
    return out


@pytest.mark.parametrize("most", [3, 4096])
def test_nearest_with_ties_and_odd_rows(spark, monkeypatch, most):
    """Few values give many ties; queries go in one block or several; scores in slices of any size."""
    monkeypatch.setattr(vector_blocks, "QUERIES", most)
    monkeypatch.setattr(vector_blocks, "SCORES", 50)
    rng = random.Random(3)
    points = [(i, [float(rng.choice([0, 1, 2])) for _ in range(4)]) for i in range(150)] + [(150 + i, v) for i, v in enumerate(ODD)] + [(7, [2.0, 2.0, 2.0, 2.0])] * 2 + [(None, [2.0, 2.0, 2.0, 2.0])]
    queries = [(q, [float(rng.randrange(1, 4)) for _ in range(4)]) for q in range(9)]
    asked = table(spark, [*queries, (90, None), (91, [0.0] * 4)], "query_id long, vector array<float>", 2)
    got = search.dense_topk(asked, table(spark, points), 5).collect()
    assert sorted((r.query_id, r.rank, -1 if r.doc_id is None else r.doc_id, r.score) for r in got) == sorted((q, n, -1 if i is None else i, s) for q, i, s, n in plain_nearest(queries, points, 5))


def test_nearest_of_named_points_and_of_none(spark):
    points = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])]
    rows, asked = spark.createDataFrame(points, "doc_id string, vector array<double>"), spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [(r.doc_id, r.score, r.rank) for r in search.dense_topk(asked, rows, 2).sort("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2)]
    assert search.dense_topk(asked, rows, 2, F.col("doc_id") > "a").sort("rank").first().doc_id == "b"
    for q, p in ((asked.where("false"), rows), (asked, rows.where("false"))):
        assert search.dense_topk(q, p, 2).collect() == []


def test_no_cross_join(spark):
    rows = table(spark, list(enumerate(mixture(60, 4, 3, 0.2))))
    asked = rows.select(F.col("doc_id").alias("query_id"), "vector")
    for out in (search.dense_topk(asked, rows, 3), search.maxsim(asked.withColumn("token_no", F.lit(0)), rows, 3), vector_blocks.similarity_matrix(rows, 0.5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("slots", [7, 1 << 22])
def test_late_interaction(spark, monkeypatch, slots):
    """One document holds a third of all tokens, in many tasks."""
    monkeypatch.setattr(vector_blocks, "SCORES", slots)
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    tokens = [(0 if i % 3 == 0 else rng.randrange(1, 30), vector()) for i in range(400)]
    asked = [(q, t, vector()) for q in range(4) for t in range(3)]
    want = []
    for q in range(4):
        scores = {d: round(sum(max(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)) for i, x in tokens if i == d) for qq, _, v in asked if qq == q), 6) for d in {i for i, _ in tokens}}
        want += [(q, d, s) for d, s in sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:6]]
    got = search.maxsim(spark.createDataFrame(asked, "query_id long, token_no int, vector array<double>"), table(spark, tokens, "doc_id long, vector array<double>", 7), 6)
    assert [(r.query_id, r.doc_id, r.score) for r in got.sort("query_id", "rank").collect()] == sorted(want, key=lambda r: (r[0], -r[2], r[1]))


@pytest.mark.parametrize("least", [0.9, 0.3, -1.0])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_similarity_matrix(spark, least, spread):
    """A third of all vectors are copies of one another; ids repeat; some vectors can't be used."""
    rows = list(enumerate(mixture(120, 4, 6, spread))) + [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(300 + i, v) for i, v in enumerate(ODD)] + [(5, [1.0, 0.5, 0.5, 0.5])]
    kept = [(i, v) for i, v in rows if usable(v, 4)]
    want = sorted((min(i, j), max(i, j), cosine(v, w)) for n, (i, v) in enumerate(kept) for j, w in kept[:n] if i != j and cosine(v, w) >= least)
    got = vector_blocks.similarity_matrix(table(spark, rows), least, tile=16).collect()
    assert sorted((r.a, r.b, r.cosine) for r in got) == want


def test_far_tiles_are_never_formed(spark):
    """Of narrow groups far apart only tiles of the same group meet; without a usable bound all do."""
    heads = spark.createDataFrame([(0, [1.0, 0.0], 0.1), (1, [1.0, 0.0], 0.1), (2, [0.0, 1.0], 0.1), (3, [0.0, 1.0], 1.3)], "tile long, centre array<double>, wide double")
    got = {tuple(r) for r in vector_blocks.close_tiles(heads, 4, 0.9).collect()}
    assert got == {(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3), (0, 3), (1, 3)}
    assert vector_blocks.close_tiles(heads, 4, -1.0).count() == 10
    rows = table(spark, list(enumerate(mixture(30, 4, 2, 0.1))))
    with pytest.raises(ValueError):
        vector_blocks.similarity_matrix(rows, 1.5)
    assert vector_blocks.similarity_matrix(rows.where("false"), 0.5).collect() == []


def recall(got, want):
    got, want = ({(r.query_id, r.doc_id) for r in x.collect()} for x in (got, want))
    return len(got & want) / len(want)


def asked_of(points, every):
    return points.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "vector")


def test_lists_of_vectors_in_clusters(spark, tmp_path):
    """At least nine tenths of the ten nearest with codes and vectors of less than 15 % of all points; all rows are indexed."""
    points = table(spark, list(enumerate(mixture(8000, 24, 80, 0.25)))).cache()
    q, asked = vector_index.build_index(points, f"{tmp_path}/i"), asked_of(points, 100)
    lists = spark.read.parquet(f"{tmp_path}/i/lists")
    assert lists.count() == lists.select("doc_id").distinct().count() == 8000
    codes, vectors = vector_index.visited(asked, f"{tmp_path}/i", 10)
    assert codes < 0.15 and vectors < 0.15, (codes, vectors, q.probes)
    got = vector_index.search_index(asked, f"{tmp_path}/i", 10)
    assert recall(got, search.dense_topk(asked, points, 10)) >= 0.9
    exact = {(r.query_id, r.doc_id): r.score for r in search.dense_topk(asked, points, 8000).collect()}
    assert all(exact[r.query_id, r.doc_id] == pytest.approx(r.score, abs=2e-6) for r in got.collect())
    assert got.groupBy("query_id").count().where("count != 10").count() == 0
    plan = vector_index.search_index(asked.limit(1), f"{tmp_path}/i", 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<doc_id:bigint,code:binary>" in plan


def test_lists_of_vectors_without_structure(spark, tmp_path):
    """The given vectors point everywhere alike: their codes must nearly all be looked at, their vectors need not."""
    points = plans.points(spark, "/root/testdata/sf0.1")
    asked = asked_of(points, 25)
    vector_index.build_index(points, f"{tmp_path}/i")
    codes, vectors = vector_index.visited(asked, f"{tmp_path}/i", 10)
    assert vectors < 0.15 and codes < 0.85
    assert recall(vector_index.search_index(asked, f"{tmp_path}/i", 10), search.dense_topk(asked, points, 10)) >= 0.9


def test_index_of_odd_rows_and_later_points(spark, tmp_path):
    rows = list(enumerate(mixture(200, 4, 4, 0.3))) + [(500 + i, v) for i, v in enumerate(ODD)] + [(None, [1.0, 1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0, 1.0])]
    points, at = table(spark, rows), f"{tmp_path}/i"
    vector_index.build_index(points, at, cells=5, parts=3)
    assert spark.read.parquet(f"{at}/lists").count() == 202
    vector_index.add_points(table(spark, [(900, [9.0, -9.0, 9.0, -9.0])]), at)
    asked = spark.createDataFrame([(1, [1.0, -1.0, 1.0, -1.0]), (2, None), (3, [0.0] * 4), (4, [1.0, 1.0])], "query_id long, vector array<float>")
    got = vector_index.search_index(asked, at, 3, probes=5).sort("rank").collect()
    assert {r.query_id for r in got} == {1} and (got[0].doc_id, got[0].score) == (900, 1.0)
    assert recall(vector_index.search_index(asked, at, 3, probes=5), search.dense_topk(asked, points.union(table(spark, [(900, [9.0, -9.0, 9.0, -9.0])])), 3)) == 1
    vector_index.build_index(points.where("false"), f"{tmp_path}/e")
    assert vector_index.search_index(asked, f"{tmp_path}/e", 3).collect() == []


def test_a_hot_cell_is_spread(spark, tmp_path):
    """A third of all points are copies: their list has several files, as rows are dealt by cell and id."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)] + [(3000 + i, v) for i, v in enumerate(mixture(3000, 4, 30, 0.5))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would all go to one task
    vector_index.build_index(table(spark, rows), f"{tmp_path}/i")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lists = spark.read.parquet(f"{tmp_path}/i/lists").withColumn("file", F.input_file_name())
    hot = lists.where("doc_id = 0").first().cell
    assert lists.where(F.col("cell") == hot).select("file").distinct().count() > 1 and lists.count() == 6000


def test_cluster_tree(spark):
    points = table(spark, list(enumerate(mixture(600, 6, 4, 0.05, seed=9))) + [(900, None)])
    rows = search.cluster_tree(points, 4, 2).collect()
    for level in (1, 2):
        own = [r for r in rows if r.level == level]
        assert sorted(r.doc_id for r in own) == list(range(600))
        assert sum(r.central for r in own) == len({r.node for r in own}) and all(r.node.count("/") == level - 1 for r in own)
    up = {r.doc_id: r.node for r in rows if r.level == 1}
    assert len(set(up.values())) == 4 and all(r.node.startswith(up[r.doc_id] + "/") for r in rows if r.level == 2)
    assert search.cluster_tree(points.where("false")).collect() == []


@pytest.mark.parametrize("cells,scores", [(1 << 22, 1 << 22), (6, 7)])
def test_sparse_products(spark, monkeypatch, cells, scores):
    """Weights of any sign, a document with most postings, one of null, terms that only one side has; in one matrix or many, in slices of any size."""
    monkeypatch.setattr(vector_blocks, "CELLS", cells)
    monkeypatch.setattr(vector_blocks, "SCORES", scores)
    rng = random.Random(6)
    postings = [(0, f"t{i}", rng.choice([0.5, 1.0, -1.0])) for i in range(60)] + [(None, "t1", 1.0)] + sorted({(rng.randrange(1, 30), f"t{rng.randrange(80)}"): 0 for _ in range(200)})
    postings = [p if len(p) == 3 else (*p, rng.choice([0.25, 1.5, 0.0])) for p in postings]
    asked = [(q, f"t{t}", rng.choice([1.0, 2.0, -0.5])) for q in range(7) for t in rng.sample(range(90), 6)] + [(9, "none", 1.0)]
    want = []
    for q in range(10):
        own = {t: w for i, t, w in asked if i == q}
        scores_ = {}
        for d, t, w in postings:
            if t in own:
                scores_[d] = scores_.get(d, 0.0) + w * own[t]
        want += [(q, d, round(s, 6)) for d, s in sorted(scores_.items(), key=lambda r: (-round(r[1], 6), r[0] is not None, r[0] or 0))[:4]]
    got = search.sparse_topk(spark.createDataFrame(asked, "query_id int, term string, weight double"), spark.createDataFrame(postings, "doc_id int, term string, weight double").repartition(5), 4)
    assert [(r.query_id, r.doc_id, r.score) for r in got.sort("query_id", "rank").collect()] == want
    assert search.sparse_topk(spark.createDataFrame([], "query_id int, term string, weight double"), spark.createDataFrame(postings, "doc_id int, term string, weight double"), 4).collect() == []


def test_what_a_search_keeps_is_bounded(spark, tmp_path, monkeypatch):
    """A block has the fewer queries the more candidates each keeps, and rows below a query's k-th best so far aren't held."""
    sizes, blocks = [], vector_index.query_blocks

    def counted(queries, *most):
        for block in blocks(queries, *most):
            sizes.append(len(block))
            yield block

    monkeypatch.setattr(vector_index, "query_blocks", counted)
    monkeypatch.setattr(vector_index, "KEPT", 1 << 10)
    points = spark.createDataFrame([(i, v) for i, v in enumerate(mixture(300, 8, 5, 0.2))], KIND)
    vector_index.build_index(points, f"{tmp_path}/i")
    asked = points.where("doc_id < 100").withColumnRenamed("doc_id", "query_id")
    assert recall(vector_index.search_index(asked, f"{tmp_path}/i", 2), search.dense_topk(asked, points, 2)) >= 0.9
    assert sum(sizes) == 100 and max(sizes) < 60  # before: one block of 100
    best = vector_blocks.Best(2, 1)
    best.add(pa.array(range(100)), np.arange(100.0)[:, None])
    best._cut()
    best.add(pa.array(range(100, 150)), np.arange(50.0)[:, None])
    assert best.size == 2  # before: 4
    best.add(pa.array([7, 200]), np.array([[98.0], [98.0]]))
    assert best.batch(pa.array([5])).column("doc_id").to_pylist() == [99, 7]
