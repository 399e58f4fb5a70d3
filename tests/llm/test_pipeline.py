"""The corpus pipeline, stage by stage against plain versions, on the smallest tables."""

import corpus_pipeline as p
from rillworks.llm._scratch import stored
from rillworks.llm.decontaminate import build_index, find_leaks
from rillworks.llm.language_id import fit_language_model, fold, identify_language
from rillworks.llm.mix_sources import mix_sources

from . import brute

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(odd)
    names = [n for n, _ in p.STAGES]
    assert names == ["language", "near_copies", "decontamination", "mixing", "sharding"]
    inputs = [docs]
    for _, stage in p.STAGES[:-1]:
        out = stored(stage(spark, inputs[-1], D), "stage")
        assert out.columns == docs.columns
        inputs.append(out)
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in inputs]

    found = identify_language(docs, fit_language_model(docs.where(~fold("doc_id", 4, 2))), gap=0.05)
    gone = {r.doc_id for r in found.where("lang_pred = 'und' OR ambiguous").collect()}
    assert {9001, 9002} <= gone and sorted(ids[1]) == sorted(set(ids[0]) - gone)

    rows = [(r.doc_id, r.text) for r in inputs[1].collect()]
    assert sorted(ids[2]) == sorted(i for i, (n, c) in brute.components(rows).items() if i == c)

    leaks = find_leaks(inputs[2], build_index(inputs[2], spark.read.parquet(f"{D}/benchmark.parquet")))
    assert sorted(ids[3]) == sorted(set(ids[2]) - {r.doc_id for r in leaks.collect()})
    bench = [" ".join(brute.words(r.text.lower())) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert not any(b in " ".join(brute.words(r.text.lower())) for r in inputs[3].collect() for b in bench)

    want = {r.doc_id: int(r.taken / max(1, r["size"]) + 0.5) for r in mix_sources(inputs[3]).collect()}
    assert {i: ids[4].count(i) for i in set(ids[3])} == want

    shards = p.STAGES[-1][1](spark, inputs[4], D).collect()
    assert len(shards) == len(ids[4]) and {r.shard for r in shards} == set(range(8))
    text = {r.doc_id: r.text for r in inputs[4].collect()}
    of = {}
    for r in shards:
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard


def test_run(spark):
    assert p.run(spark, D).count() > 100
