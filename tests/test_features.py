"""Bins, folds, encodings, synthetic rows and imputation against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillworks.operators import features, vector_index


def test_pools_are_monotone_and_as_near_as_can_be():
    """Pooled rates rise and minimise the squared error among all ways to pool neighbours with rising rates."""
    rng = random.Random(5)
    for _ in range(60):
        counts = [(n := rng.randrange(1, 9), rng.randrange(0, n + 1)) for _ in range(rng.randrange(1, 9))]

        def error(starts):
            out, before = 0.0, -1.0
            for lo, hi in zip(starts, [*starts[1:], len(counts)]):
                n, b = (sum(c[i] for c in counts[lo:hi]) for i in (0, 1))
                if b / n < before:
                    return math.inf
                before = b / n
                out += sum(c[0] * (c[1] / c[0] - b / n) ** 2 for c in counts[lo:hi])
            return out

        starts = features.pooled(counts)
        ways = ([0, *(i for i in range(1, len(counts)) if m >> (i - 1) & 1)] for m in range(1 << (len(counts) - 1)))
        assert error(starts) == pytest.approx(min(map(error, ways)), abs=1e-9)
        falling = features.pooled(counts, False)
        assert falling == features.pooled([(n, n - b) for n, b in counts])


def test_monotone_bins(spark):
    rng = random.Random(1)
    rows = [(x := rng.gauss(0, 1), int(rng.random() < 0.1 + 0.6 / (1 + math.exp(-3 * x)))) for _ in range(6000)] + [(None, 1)] * 50 + [(0.0, None)] * 50
    df = spark.createDataFrame(rows, "v double, y int")
    for sign in (1, -1):
        edges = features.monotone_edges(df.withColumn("v", sign * F.col("v")), "v", "y")
        table = sorted(features.woe_table(df.withColumn("v", sign * F.col("v")), "v", "y", edges).collect())
        rates = [r.rate for r in table if r.bin <= len(edges)]
        assert len(rates) >= 4 and rates == sorted(rates, reverse=sign < 0)
        assert all(r.n >= 0.02 * 6000 for r in table if r.bin <= len(edges)) and table[-1].n == 50 and table[-1].iv > 0.3
    assert features.monotone_edges(df.where("false"), "v", "y") == []
    assert features.woe_table(df.where("false"), "v", "y", [0.0]).collect() == []


def test_woe_by_hand(spark):
    rows = [(1.0, 1), (1.0, 0), (1.0, 0), (3.0, 1), (None, 0), (9.0, None)]
    got = {r.bin: r for r in features.woe_table(spark.createDataFrame(rows, "v double, y int"), "v", "y", [2.0]).collect()}
    p, q = {0: 1.5 / 3.5, 1: 1.5 / 3.5, 2: 0.5 / 3.5}, {0: 2.5 / 4.5, 1: 0.5 / 4.5, 2: 1.5 / 4.5}
    assert {k: (r.n, r.bad) for k, r in got.items()} == {0: (3, 1), 1: (1, 1), 2: (1, 0)}
    assert all(got[k].woe == pytest.approx(math.log(p[k] / q[k])) for k in p)
    assert got[0].iv == pytest.approx(sum((p[k] - q[k]) * math.log(p[k] / q[k]) for k in p))


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_differ_by_one_at_most(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(501)] + [(900, "one")]
    out = features.stratified_folds(spark.createDataFrame(rows, "id int, s string").repartition(5), "s", "id", k)
    got = out.collect()
    assert sorted((r.id, r.s) for r in got if r.s) == sorted(r for r in rows if r[1]) and len(got) == len(rows)
    for own in [got, *([r for r in got if r.s == s] for s in {r[1] for r in rows})]:
        sizes = Counter(r.fold for r in own)
        assert max(sizes.values()) - min(sizes.get(f, 0) for f in range(k)) <= 1
    assert sorted((r.id, r.fold) for r in out.repartition(2).collect()) == sorted((r.id, r.fold) for r in got)


@pytest.mark.parametrize("hot", [1, 4, 10**9])
def test_encoding_sees_no_label_of_its_fold(spark, monkeypatch, hot):
    """No category is hot, some are, all are; one holds a third of all rows; nulls are a category."""
    monkeypatch.setattr(features, "HOT", hot)
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", *"abcd", None]), rng.choice([0, 1, 1, None]), i % 3) for i in range(400)] + [(400, "lone", 1, 0)]
    df = spark.createDataFrame(rows, "id int, c string, y int, fold int").repartition(4)
    got = {r.id: r.encoded for r in features.target_encoding(df, "c", "y").collect()}
    assert len(got) == len(rows)
    for i, c, _, fold in rows:
        others = [(cc, y) for _, cc, y, f in rows if f != fold and y is not None]
        own, mean = [y for cc, y in others if cc == c], sum(y for _, y in others) / len(others)
        assert got[i] == pytest.approx((sum(own) + 10 * mean) / (len(own) + 10))
    flipped = df.withColumn("y", F.when(F.col("id") == 7, 1 - F.coalesce("y", F.lit(0))).otherwise(F.col("y")))
    again = {r.id: r.encoded for r in features.target_encoding(flipped, "c", "y").collect()}
    fold = 7 % 3
    assert all(again[i] == pytest.approx(got[i]) for i, _, _, f in rows if f == fold)  # another label changes other folds only


def vectors(n, width=6, seed=3):
    rng = np.random.default_rng(seed)
    return [[float(v) for v in x] for x in rng.normal(size=(n, width))]


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def test_synthetic_rows_lie_between_neighbours(spark):
    rows = [(i, v, i % 4 == 0) for i, v in enumerate(vectors(160))]
    df = spark.createDataFrame(rows, "id long, vector array<double>, rare boolean").repartition(4)
    got = features.smote(df, F.col("rare"), 3, 4, seed=9).collect()
    own = {i: v for i, v, rare in rows if rare}
    assert sorted((r.id, r.copy) for r in got) == sorted((i, c) for i in own for c in (1, 2, 3))
    for r in got:
        near = sorted((-cosine(own[r.id], v), i) for i, v in own.items() if i != r.id)[:4]
        assert r.other in {i for _, i in near} and 0 <= r.share < 1
        assert list(r.vector) == pytest.approx([a + r.share * (b - a) for a, b in zip(own[r.id], own[r.other])])
    assert len({r.other for r in got}) > 10 and np.std([r.share for r in got]) > 0.2
    assert sorted(features.smote(df.repartition(2), F.col("rare"), 3, 4, seed=9).collect()) == sorted(got)
    assert sorted(features.smote(df, F.col("rare"), 3, 4, seed=10).collect()) != sorted(got)
    assert features.smote(df.where("id = 0"), F.col("rare")).collect() == []


def test_many_minority_rows_use_the_index(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(features, "QUERIES", 50)
    rows = [(i, v) for i, v in enumerate(vectors(400, 4, 6))]
    got = features.smote(spark.createDataFrame(rows, "id long, vector array<double>"), F.lit(True), 1, 5, index=f"{tmp_path}/i").collect()
    assert spark.read.parquet(f"{tmp_path}/i/lists").count() == 400 and len({r.id for r in got}) == 400
    assert vector_index.load(spark, f"{tmp_path}/i").probes >= 1
    own, hits = dict(rows), 0
    for r in got:
        near = sorted((-cosine(own[r.id], v), i) for i, v in own.items() if i != r.id)[:5]
        hits += r.other in {i for _, i in near}
    assert hits >= 0.9 * 400


def test_neighbours_are_exact_beyond_a_block_of_queries(spark, monkeypatch):
    monkeypatch.setattr(features, "QUERIES", 50)
    own = dict(enumerate(vectors(200, 12, 40)))
    got = features.smote(spark.createDataFrame(list(own.items()), "id long, vector array<double>"), F.lit(True), 1, 1).collect()
    near = {a: min((-cosine(v, w), b) for b, w in own.items() if b != a)[1] for a, v in own.items()}
    assert {r.id: r.other for r in got} == near  # before: those of an index, about


def solved(x, rounds):
    """Rounds of least squares of each column on the others as the round before has filled them."""
    gone, out = np.isnan(x), np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        new = out.copy()
        for c in range(x.shape[1]):
            z = np.hstack([np.delete(out, c, 1), np.ones((len(x), 1))])
            new[gone[:, c], c] = z[gone[:, c]] @ np.linalg.lstsq(z[~gone[:, c]], x[~gone[:, c], c], rcond=None)[0]
        out = new
    return out


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_imputation_equals_a_plain_solver(spark, rounds):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=300), rng.normal(size=300)
    x = np.stack([a, b, 2 * a - b + 5 + 0.1 * rng.normal(size=300), a * 3 + 100 + 0.2 * rng.normal(size=300)], axis=1)
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, f"t{i}", *(None if math.isnan(v) and i % 2 else float(v) for v in r)) for i, r in enumerate(x)]  # nulls and NaNs
    df = spark.createDataFrame(rows, "id int, text string, p double, q double, r double, s double").repartition(5)
    got = sorted(features.impute(df, ["p", "q", "r", "s"], rounds).collect())
    assert [r.text for r in got] == [f"t{i}" for i in range(300)]
    assert np.array([r[2:] for r in got]) == pytest.approx(solved(x, rounds), rel=1e-5, abs=1e-5)


def test_imputation_of_odd_columns(spark):
    """A column without values stays null; columns that depend on one another, and one known column, give finite fills."""
    rows = [(i, None, float(i), 2.0 * i if i % 3 else None, 7) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, none double, a double, b double, c int")
    got = sorted(features.impute(df, ["none", "a", "b", "c"]).collect())
    assert all(r.none is None and r.b == pytest.approx(2.0 * r.id, abs=1e-3) and r.c == 7.0 for r in got)
    assert features.impute(df.where("false"), ["a", "b"]).collect() == []
