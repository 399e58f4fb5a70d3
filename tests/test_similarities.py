"""Similarities of queries and all points as products of blocks."""

import math

import numpy as np
from pyspark.sql import functions as F

from rillworks.functions import vector as v
from rillworks.operators import vector_blocks as vb
from rillworks.plans import search as plans

KIND = "id long, vector array<double>"


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.a, r.b, str(tuple(r))))


def test_pairs_are_products_of_blocks_not_a_nested_loop(spark):
    plan = plans.v3_v4_similarities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan  # before: one task joined a file's rows one by one


def test_odd_vectors_as_by_columns(spark, monkeypatch):
    monkeypatch.setattr(vb, "BATCH_PAIRS", 16)
    monkeypatch.setattr(vb, "TASK_PAIRS", 32)
    rng = np.random.default_rng(3)
    near = rng.normal(size=4) * 1000
    own = [near, near + 1e-4, near, rng.normal(size=4), [0.0] * 4, [0.125, 0.0, 0.0, 0.0], [0.125, 0.0, 0.0, 0.0], [1.0, math.nan, 0.0, 0.0], [1.0, None, 0.0, 0.0], [1.0, 2.0], [], None]
    data = [(i, None if x is None else [None if y is None else float(y) for y in x]) for i, x in enumerate(own)] + [(3, [1.0, 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(data, KIND)
    asked = df.select(F.col("id").alias("query_id"), "vector").where("id IS NOT NULL")
    got = rows_of(vb.similarities(asked, df.select(F.col("id").alias("doc_id"), "vector")))
    a, b = df.where("id IS NOT NULL").select(F.col("id").alias("a"), F.col("vector").alias("x")), df.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    pairs = a.join(b, F.col("a") != F.col("b"))
    want = rows_of(pairs.select("a", "b", *(F.round(f(F.col("x"), F.col("y")), 5).alias(n) for n, f in (("cosine", v.cosine), ("dot", v.dot), ("euclid", v.euclid)))))
    assert len(got) == len(want) == 13 * 12 - 2
    for g, w in zip(got, want):
        for n in ("a", "b", "cosine", "dot", "euclid"):
            assert (g[n] is None) == (w[n] is None) and (g[n] is None or (math.isnan(g[n]) and math.isnan(w[n])) or abs(g[n] - w[n]) < 1e-9), (g, w)
    assert vb.similarities(asked.where("false"), df.withColumnRenamed("id", "doc_id")).collect() == []


def test_halves_go_away_from_zero():
    assert vb.rounded(np.array([0.015625, -0.015625, -1e-9, 1e308, np.inf]), 5).tolist() == [0.01563, -0.01563, 0.0, 1e308, np.inf]
