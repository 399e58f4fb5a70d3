"""One group, source or id with a third of all rows; null, repeated and tied keys."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from rillworks.llm import _hot, jaccard_join, mix_sources, quality_rules, shards, url_filter

from . import brute


def test_later_in_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, rng.randrange(40)]), rng.randrange(300)) for _ in range(900)] + [(77, 5), (77, 5)]
    least = {}
    for g, v in rows:
        least[g] = min(v, least.get(g, v))
    out = _hot.later_in_group(spark.createDataFrame(rows, "g int, v int"), "g", "v", len(rows)).collect()
    assert sorted((r.g, r.v) for r in out) == sorted({(g, v) for g, v in rows if v > least[g]})


def test_shards_with_null_and_repeated_ids(spark):
    rows = [(None, "hot text")] * 60 + [(7, "hot text")] * 60 + [(i, f"text {i}") for i in range(200)] + [(None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(3)
    out = shards.shard(df, 8).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"hot text")}) == 1


@pytest.mark.parametrize("scale", [0.05, 1.0, 1000.0])
def test_mix_at_any_scale_of_weights(spark, monkeypatch, scale):
    monkeypatch.setattr(mix_sources, "RANGES", 4)
    monkeypatch.setattr(mix_sources, "FINER", 3)
    rows = spark.range(600).select((F.col("id") % 100).alias("doc_id"), F.expr("array_join(array_repeat('w', cast(id % 7 as int)), ' ')").alias("text"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 == 0, "b").alias("source"))
    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id"))).repartition(3)
    out = mix_sources.mix_sources(rows, weight=F.lit(scale) * F.length("text"))
    got = out.groupBy("source").agg(F.sum("size").alias("n"), F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("z")).collect()
    assert len(got) == 3 and all(r.n == r.z and abs(r.t - r.g) <= 1 for r in got) and out.count() == 600
    # whole epochs, then in the order of the keys: of a source's rows only one is cut
    assert all(r.n <= 1 for r in out.where("taken > epochs * size AND taken < (epochs + 1) * size").groupBy("source").agg(F.count("*").alias("n")).collect())


def test_rules_are_timed_by_what_they_need(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('word and other ', cast(id % 40 as int))").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(1, None), (1, None), (None, "x y")], "doc_id long, text string"))
    found = {e.name: e for e in quality_rules.estimate(rows, quality_rules.default_rules())}
    assert set(found) == {r.name for r in quality_rules.default_rules()} and all(0 <= e.share <= 1 and e.seconds >= 0 for e in found.values())
    assert found["repeats"].share > 0.5
    out = quality_rules.judge_quality(rows)
    assert out.count() == 303 and out.where("kept").count() == 0


def test_question_mark_is_one_character(spark):
    rules = [url_filter.Rule(".h/?", "block"), url_filter.Rule(".h/a?b??", "block"), url_filter.Rule(".?/x", "block")]
    urls = ["http://h/é", "http://h/x", "http://h/€", "http://h/😀", "http://h/éé", "http://h/", "http://h/aéb😀z", "http://h/aéb😀", "http://ü/x", "http://h/" + "y" * 20_000]
    out = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules)
    assert [r.verdict == "block" for r in sorted(out.collect(), key=lambda r: r.page_id)] == [True] * 4 + [False, False, True, False, True, False]


@pytest.mark.parametrize("seed", range(3))
def test_large_blocks_join_near_copies_first(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "ROWS", 6)
    monkeypatch.setattr(jaccard_join, "SHARED", 2)
    calls = []
    plain = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda e: calls.append(1) or plain(e))
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    # families that share two thirds of their words, so blocks hold sets of several components
    tails = [base[80:]] + [[f"t{k}_{i}" for i in range(40)] for k in range(3)]
    rows = [(i, " ".join(x if rng.random() > 0.02 else f"e{rng.random()}" for x in base[:80] + tails[rng.choice([0, 0, 0, 1, 2, 3])])) for i in range(110)]
    rows += [(1000 + i, " ".join(base[:80] + [f"u{i}_{k}" for k in range(rng.randrange(5, 40))])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard_join.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.components(rows)
    assert len(calls) == 2


def test_null_texts_are_no_text_that_reads_so(spark):
    rows = [(i, None) for i in range(5)] + [(9, "null text"), (10, "null"), (11, "")] + [(20 + i, f"t{i}") for i in range(4)]
    out = {r.doc_id: r.shard for r in shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()}
    assert len({out[i] for i in range(5)}) == 1 and out[0] not in (out[9], out[10], out[11])


def test_rows_without_ids_spread_over_the_mix(spark):
    rows = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w w w x"), "id").alias("text"), F.when(F.col("id") < 600, "a").otherwise("b").alias("source"))
    out = mix_sources.mix_sources(rows).collect()
    for source in "ab":
        own = [r for r in out if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
        assert sum(0 < r.taken - r.epochs * r["size"] < r["size"] for r in own) <= 1
    again = sorted((r.source, r["size"], r.taken) for r in mix_sources.mix_sources(rows.repartition(3)).collect())
    assert again == sorted((r.source, r["size"], r.taken) for r in out)
