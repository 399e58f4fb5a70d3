"""Clusters by heaps of gaps against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillworks.llm import centroid_clusters
from rillworks.llm.centroid_clusters import Heaps, assign, cluster_vectors, distances, with_inertia
from rillworks.llm.queries import op11_centroid_clusters

KIND = "vec_id long, embedding array<float>"


def plain(rows, k=40, rounds=5, width=64, scale=256):
    """rows: (id, vector). Sorted (id, cluster, distance, sum of the cluster, sum of all, sha256 of the centroid)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centres)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {}
    for _, c, d in last:
        sums[c] = sums.get(c, 0) + d
    return sorted((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in last)


def got(spark, rows, kind=KIND, **how):
    out = with_inertia(cluster_vectors(spark.createDataFrame(rows, kind).repartition(3), **how))
    return sorted(tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def cloud(rng, n, width, spread=0.3, groups=5):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [[float(np.float32(rng.gauss(c, spread))) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("k,width,n,scale", [(4, 2, 300, 256), (9, 3, 200, 2), (40, 64, 150, 256), (1, 2, 30, 256)])
def test_against_plain_rounds(spark, monkeypatch, block, k, width, n, scale):
    """Coarse scales give many ties and equal vectors."""
    monkeypatch.setattr(centroid_clusters, "BLOCK", block)
    rows = list(enumerate(cloud(random.Random(k), n, width)))
    assert got(spark, rows, k=k, width=width, scale=scale) == plain(rows, k, 5, width, scale)


def test_rows_left_out_and_ties(spark):
    v = [0.5] * 64
    rows = [(1, v), (2, None), (3, v[:63]), (4, [*v[:63], None]), (5, [*v[:63], math.nan]), (6, [*v[:63], math.inf]), (7, [-x for x in v]), (8, [0.0] * 64), (9, v), (9, v), (10, [*v, 0.5])]
    assert got(spark, rows) == plain(rows)
    assert {r[0] for r in got(spark, rows)} == {1, 7, 8, 9}


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, [0.5, 0.1], 1, "a"), (1, [0.5, 0.1], 2, "b"), (1, [-0.5, 0.2], 3, None)]
    out = with_inertia(cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, ids string"), k=2, width=2)).collect()
    assert sorted((repr(r.vec_id), r.distance) for r in out) == [("1", 0), ("1", 0), ("None", 0)]
    empty = cluster_vectors(spark.createDataFrame([], KIND))
    assert with_inertia(empty).collect() == [] and empty.centroids == []


def test_large_components(spark):
    """Beyond the exact range of doubles, and beyond a long."""
    rng = random.Random(1)
    big = [(i, [rng.choice([1e5, 4e5, -3e5]) + rng.random() for _ in range(3)]) for i in range(60)]
    assert got(spark, big, "vec_id long, embedding array<double>", k=5, width=3) == plain(big, 5, 5, 3)
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    out = {r[0]: r for r in got(spark, rows, "vec_id long, embedding array<double>", k=1, width=2)}
    assert out[1][2] == out[2][2] == centroid_clusters.MOST == out[1][4]


def test_heaps_pop_what_has_expired_only():
    """Members stay while their keys lie above the offset, and come back to the cluster that they are pushed to."""
    heaps = Heaps(2, np.arange(5, dtype=np.int32), np.array([0.5, 1.0, 3.0, 0.2, 0.9]), np.array([0, 3, 5]))
    gone, own = heaps.pop(np.array([1.0, 0.3]))
    assert gone.tolist() == [0, 1, 3] and own.tolist() == [0, 0, 1]
    heaps.push(gone, np.array([1, 0, 1]), np.array([0.7, 4.0, 2.0]))
    assert heaps.member.tolist() == [2, 1, 0, 4, 3] and heaps.key.tolist() == [3.0, 4.0, 0.7, 0.9, 2.0] and heaps.starts.tolist() == [0, 2, 5]
    assert heaps.clusters().tolist() == [1, 0, 0, 1, 1]


def test_an_assignment_compares_popped_vectors_only(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 8))
    centres = x[:6].copy()
    heaps, offset = Heaps(6, np.zeros(0, np.int32), np.zeros(0), np.zeros(7, np.int64)), np.zeros(6)
    assert assign(x, heaps, centres, offset)[-1, :2].tolist() == [-1, 500]
    for _ in range(8):
        moved = centres + rng.integers(-9, 10, centres.shape)
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1))
        offset, centres = offset + drift + [np.delete(drift, c).max() for c in range(6)], moved
        seen = []
        monkeypatch.setattr(centroid_clusters, "distances", lambda a, c: seen.append(len(a)) or distances(a, c))
        assign(x, heaps, centres, offset)
        assert (heaps.clusters() == distances(x, centres).argmin(axis=1)).all() and seen[0] < 400


def test_rounds_rescan_fewer_and_fewer(spark):
    """Of well parted vectors the first assignment compares all, later ones only some; no table of an earlier round stays."""
    rows = list(enumerate(cloud(random.Random(8), 2000, 16, 0.05, 12)))
    docs = spark.createDataFrame(rows, KIND)
    found = cluster_vectors(docs, k=12, width=16)
    assert found.rescanned[0] == 2000 and len(found.rescanned) == 6 and found.rescanned[-1] < 500
    assert found.rows.agg(F.count("*")).first()[0] == 2000


def test_query(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(cloud(random.Random(6), 300, 64))] + [(300, None), (301, [0.1] * 3)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(tuple(r) for r in op11_centroid_clusters(spark, str(tmp_path)).collect()) == plain(rows)
