"""Bucketed collections against a plain dictionary."""

import os
import random

import pytest

from rillworks.sources import buckets
from rillworks.streaming import incremental

KIND = "chunk_id string, v int, text string"


def rows_of(spark, path):
    return {r.chunk_id: (r.v, r.text) for r in buckets.read_buckets(spark, path).collect()}


def test_small_batches_rewrite_few_buckets(spark, tmp_path):
    """Ten rows rewrite less than 5 % of the collection's rows."""
    path = f"{tmp_path}/c"
    first = spark.range(20_000).selectExpr("concat('k', id) AS chunk_id", "1 AS v", "'t' AS text")
    assert len(buckets.upsert_buckets(first, path)) == buckets.BUCKETS
    batch = spark.createDataFrame([(f"k{i * 997}", 2, "new") for i in range(9)] + [("fresh", 2, "new")], KIND)
    touched = buckets.upsert_buckets(batch, path)
    assert len(touched) <= 10
    folder = buckets.current(spark, path)[2][touched[0]]
    assert spark.read.parquet(f"{path}/{folder}").count() < 0.05 * 20_000
    got = rows_of(spark, path)
    assert len(got) == 20_001 and sum(v == 2 for v, _ in got.values()) == 10
    buckets.upsert_buckets(batch, path)  # once more changes nothing
    assert rows_of(spark, path) == got


def test_any_order_of_changes(spark, tmp_path):
    """Upserts and deletions as in a dictionary; of a key that comes twice the last version counts; earlier versions stay until they are vacuumed."""
    rng, path, want, past = random.Random(5), f"{tmp_path}/c", {}, {}
    for n in range(6):
        if n in (2, 4):
            gone = [f"k{rng.randrange(30)}" for _ in range(12)]
            buckets.delete_keys(spark.createDataFrame([(k,) for k in gone], "chunk_id string"), path)
            for k in gone:
                want.pop(k, None)
        else:
            batch = [(f"k{rng.randrange(30)}", i + 100 * n, f"t{n}") for i in range(15)]
            buckets.upsert_buckets(spark.createDataFrame(batch, KIND), path, version="v", n_buckets=8 if n == 0 else 99)
            want |= {k: (v, t) for k, v, t in batch}
        assert rows_of(spark, path) == want
        past[n + 1] = dict(want)
    version, n_buckets, _ = buckets.current(spark, path)
    assert (version, n_buckets) == (6, 8)
    for v, rows in past.items():
        assert {r.chunk_id: (r.v, r.text) for r in buckets.read_buckets(spark, path, v).collect()} == rows
    before = sum(len(f) for _, _, f in os.walk(path))
    assert buckets.vacuum(spark, path, keep=2) > 0 and sum(len(f) for _, _, f in os.walk(path)) < before
    assert rows_of(spark, path) == want
    assert {r.chunk_id: (r.v, r.text) for r in buckets.read_buckets(spark, path, 5).collect()} == past[5]
    assert buckets.vacuum(spark, path, keep=2) == 0


def test_empty_and_failing_writes(spark, tmp_path):
    path = f"{tmp_path}/c"
    with pytest.raises(ValueError):
        buckets.read_buckets(spark, path)
    assert buckets.upsert_buckets(spark.createDataFrame([], KIND), path) == []
    buckets.upsert_buckets(spark.createDataFrame([("a", 1, "x"), (None, 1, "y")], KIND), path, n_buckets=4)
    with pytest.raises(Exception):
        buckets.upsert_buckets(spark.createDataFrame([("a", 2, "x")], KIND).selectExpr("chunk_id", "v", "raise_error('lost') AS text"), path)
    assert rows_of(spark, path) == {"a": (1, "x"), None: (1, "y")}
    buckets.delete_keys(spark.createDataFrame([("a",)], "chunk_id string"), path)
    assert rows_of(spark, path) == {None: (1, "y")}


def test_streamed_batches(spark, tmp_path):
    for part in ([("a", 1, "x"), ("b", 1, "x")], [("b", 2, "y")]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
        incremental.stream_ingest(source, f"{tmp_path}/out", f"{tmp_path}/cp", upsert=buckets.upsert_buckets).awaitTermination()
    assert rows_of(spark, f"{tmp_path}/out") == {"a": (1, "x"), "b": (2, "y")}
