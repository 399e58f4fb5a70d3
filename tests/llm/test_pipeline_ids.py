"""Null and repeated ids in each stage of the pipeline."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p

D = "/root/testdata/sf0.001"


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    good = [r for r in p.mixing(spark, p.decontamination(spark, p.near_copies(spark, p.language(spark, docs, D), D), D), D).dropDuplicates(["doc_id"]).where("n_chars > 500").orderBy("doc_id").collect()]
    a, b = good[0], good[1]
    leak = a.text + " " + spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first().text
    extra = lambda *rows: docs.where("doc_id < 0").unionByName(spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], docs.schema))

    def left(stage, *rows):
        return Counter((r.doc_id, r.text) for r in stage(spark, docs.unionByName(extra(*rows)), D).collect() if r.doc_id is None or r.doc_id >= 9000)

    out = left(p.language, (None, "12 34"), (None, a.text), (9001, "12 34"), (9001, b.text))
    assert out == {(None, a.text): 1, (9001, b.text): 1}

    sole = " ".join(f"sole{i}" for i in range(9))
    one, two = " ".join(f"one{i}" for i in range(50)), " ".join(f"two{i}" for i in range(50))
    out = left(p.near_copies, (9001, one), (9002, one), (9002, two), (None, one), (None, two + " x"), (None, sole), (None, sole))
    assert out == {(9001, one): 1, (9002, two): 1, (None, sole): 1}

    out = left(p.decontamination, (None, leak), (None, one), (9001, leak), (9001, two))
    assert out == {(None, one): 1, (9001, two): 1}

    rows = extra((None, one), (None, two), (9001, "one word"), (9001, one + " " + two))
    out = p.mixing(spark, rows, D).collect()
    assert {(r.doc_id, r.text) for r in out} == {(r.doc_id, r.text) for r in rows.collect()} and len(out) == 4


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = ["row", "copies", "copy", "n", "name", "part", "size", "taken", "lang_pred", "component_id", "gone"]
    more = docs.select("*", *(F.concat(F.lit(k), F.col("doc_id").cast("string")).alias(k) for k in names))
    for _, stage in p.STAGES[:-1]:
        want = Counter(r.doc_id for r in stage(spark, docs, D).collect())
        out = stage(spark, more, D)
        assert out.columns == more.columns
        rows = out.collect()
        assert Counter(r.doc_id for r in rows) == want and all(r[k] == f"{k}{r.doc_id}" for r in rows for k in names)
        assert stage(spark, docs.limit(0), D).count() == 0
    assert p.sharding(spark, more.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("x")), D).count() == docs.count() and p.sharding(spark, docs.limit(0), D).count() == 0
