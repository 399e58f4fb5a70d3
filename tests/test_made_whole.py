"""Operators that had parts missing: capped chunks, reductions, parsers, typed rows, traces, reports, citations, mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillworks.operators import chunk, classify, detect, evaluate, filters, graph, search, summarize, usage
from rillworks.sources import io


def capped(rows, threshold, most, overlap):
    """rows: (text, similarity), words as tokens."""
    stretches = []
    for text, similar in rows:
        if not stretches or similar is not None and similar < threshold:
            stretches.append([])
        w = text.split()
        stretches[-1] += [" ".join(w[i : i + most]) for i in range(0, len(w), most)] if len(w) > most else [text]
    out = []
    for own in stretches:
        packed = []
        for x in own:
            if packed and sum(len(y.split()) for y in packed[-1]) + len(x.split()) <= most:
                packed[-1].append(x)
            else:
                packed.append([x])
        for i, p in enumerate(packed):
            lap = " ".join(" ".join(packed[i - 1]).split()[-overlap:]) + " " if i and overlap else ""
            out.append((len(p), lap + " ".join(p)))
    return out


def test_chunks_by_hand(spark):
    """A break by meaning has no overlap, a cut by size has; a sentence that is too long is cut first."""
    rows = [(1, 0, "a b c", None), (1, 1, "d e", 0.9), (1, 2, "f", 0.9), (1, 3, "g h", 0.1), (1, 4, "i j k l m n o", 0.9), (2, 0, "z", None)]
    df = spark.createDataFrame(rows, "doc int, no int, text string, similarity double")
    got = {(r.doc, r.chunk_no): (r.n_sentences, r.chunk) for r in chunk.semantic_chunks(df, "doc", "no", "text", 0.75, 5, 2).collect()}
    assert got == {(1, 0): (2, "a b c d e"), (1, 1): (1, "d e f"), (1, 2): (1, "g h"), (1, 3): (1, "g h i j k l m"), (1, 4): (1, "l m n o"), (2, 0): (1, "z")}


@pytest.mark.parametrize("most,overlap", [(3, 0), (6, 2), (500, 50)])
def test_chunks_against_a_plain_version(spark, most, overlap):
    rng = random.Random(most)
    docs = {d: [(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 9))), None if i == 0 else rng.random()) for i in range(rng.randrange(1, 40))] for d in range(30)}
    df = spark.createDataFrame([(d, i, *x) for d, own in docs.items() for i, x in enumerate(own)], "doc int, no int, text string, similarity double")
    got = {}
    for r in chunk.semantic_chunks(df, "doc", "no", "text", 0.2, most, overlap).sort("doc", "chunk_no").collect():
        got.setdefault(r.doc, []).append((r.n_sentences, r.chunk))
    assert got == {d: capped(own, 0.2, most, overlap) for d, own in docs.items()}


def joined(texts):
    """A reduction that loses nothing: what it has been given, in order."""
    return [" ".join(x.replace(summarize.SEPARATOR, " ").split()) for x in texts]


def test_reduction_keeps_the_order_and_spreads(spark):
    """Ten thousand parts of one document: their order is kept, and the first round's calls lie in several tasks."""
    seen = []
    parts = [(1, i, f"w{i}") for i in range(10_000)] + [(2, 0, "only"), (3, 0, None), (3, 1, "  "), (None, 1, "b"), (None, 0, "a")]
    df = spark.createDataFrame(parts, "doc int, no int, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would all go to one task
    cut = summarize.cut
    try:
        summarize.cut = lambda rows, name: seen.append(cut(rows.withColumn("task", F.spark_partition_id()), name)) or seen[-1].drop("task")
        got = {r.doc: (r.text, r.rounds) for r in summarize.reduce_text(df, "doc", "no", "text", joined, budget=40).collect()}
    finally:
        summarize.cut = cut
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.keys() == {1, 2, None} and got[2] == ("only", 1) and got[None] == ("a b", 1)
    assert got[1][0] == " ".join(f"w{i}" for i in range(10_000)) and got[1][1] > 3
    assert seen[0].where("g = 1").select("task").distinct().count() > 1


def test_reduction_calls_stay_within_the_budget(spark):
    def first_words(texts):
        return [" ".join(w for p in x.split(summarize.SEPARATOR) for w in p.split()[:2]) for x in texts]

    rng = random.Random(1)
    parts = [(d, i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 90)))) for d in range(5) for i in range(60)]
    df = spark.createDataFrame([(str(d), i, x) for d, i, x in parts], "doc string, no int, text string")
    got = summarize.reduce_text(df, "doc", "no", "text", first_words, budget=50).collect()
    assert sorted(r.doc for r in got) == list("01234") and all(len(r.text.split()) <= 50 for r in got)
    assert summarize.reduce_text(df.where("false"), "doc", "no", "text", first_words).collect() == []
    assert summarize.leading_tokens(3)(["One two three four. Five." + summarize.SEPARATOR + "Six."]) == ["One two three"]


def pages(data):
    if data.startswith(b"!"):
        raise ValueError("broken file")
    return list(enumerate(data.decode().split("|"), 1))


def test_page_parser(spark, tmp_path):
    """A row for a file that fails; blank pages go; the other files go on."""
    (tmp_path / "sub").mkdir()
    for name, data in (("a.bin", b"one| |three"), ("sub/b.bin", b"!x"), ("c.bin", b""), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    got = {(r.filename, r.page): (r.text, r.error) for r in io.read_documents(spark, str(tmp_path), pages, "*.bin").collect()}
    assert got == {("a.bin", 1): ("one", None), ("a.bin", 3): ("three", None), ("b.bin", None): (None, "ValueError: broken file")}
    files = spark.createDataFrame([("x/y.bin", bytearray(b"|".join(b"page %d" % i for i in range(500)))), (None, None)], "path string, content binary")
    rows = io.parse_pages(files, pages, most=100).collect()
    assert len(rows) == 501 and sorted(r.page for r in rows if r.page) == list(range(1, 501)) and [r.error for r in rows if r.error] == ["ValueError: no content"]


def test_golden_set(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": "q1", "question": "Q", "ground_truth": "A", "ground_truth_contexts": ["c", "d"], "metadata": {"ticker": "X", "requires_math": true}}, {"id": "q2"}]')
    rows = {r.id: r for r in io.read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert rows["q1"].ground_truth_contexts == ["c", "d"] and rows["q1"].metadata.requires_math and rows["q1"].metadata.period is None
    assert rows["q2"].question is None


def test_typed_rows(spark):
    texts = ['{"name": "a", "score": 0.5}', '{"name": "a", "score": "x"}', "not json", None, '{"score": 2}', '{"name": null, "score": 0.1, "more": 1}', '{"name": "b", "score": null}']
    rows = spark.createDataFrame([(i, x, f"keep{i}") for i, x in enumerate(texts)], "id int, raw string, name2 string")
    good, bad = filters.parse_rows(rows, "raw", "name string, score double", ["name"], {"range": "score BETWEEN 0 AND 1"})
    assert [tuple(r) for r in good.collect()] == [(0, "keep0", "a", 0.5)]
    assert {r.id: list(r.broken) for r in bad.collect()} == {1: ["json"], 2: ["json"], 3: ["json"], 4: ["name", "range"], 5: ["name"], 6: ["range"]}
    assert bad.columns == ["id", "raw", "name2", "broken"]


def test_trace_report(spark):
    spans = [("t", 1, None, "span", 900, None, None, None), ("t", 2, 1, "generation", 300, "m", 1000, 500), ("t", 3, 1, "generation", 20, "unknown", 7, None), ("t", 4, 2, "event", 0, None, None, None), ("u", 5, None, "span", 10, None, None, None)]
    df = spark.createDataFrame(spans, "trace_id string, span_id int, parent_id int, kind string, duration_ms long, model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, p_in double, p_out double")
    scores = spark.createDataFrame([("t", "faithful", 0.5), ("t", "faithful", 1.0), ("t", "thumb", 1.0), ("gone", "thumb", 0.0)], "trace_id string, name string, value double")
    got = {r.trace_id: r for r in usage.trace_report(df, prices, scores).collect()}
    assert (got["t"].n_spans, got["t"].duration_ms, got["t"].tokens, got["t"].depth, got["t"].n_generations, got["t"].n_events) == (4, 900, 1507, 3, 2, 1)
    assert got["t"].cost == pytest.approx(0.004) and got["t"].scores == {"faithful": 0.75, "thumb": 1.0}
    assert got.keys() == {"t", "u"} and got["u"].cost is None and got["u"].scores is None


def test_usage_report_filters(spark):
    rows = spark.createDataFrame([("a1", "2024-01-01 00:00:00", 1), ("a2", "2024-01-02 00:00:00", 1), ("b", "2024-01-02 00:00:00", 2), ("a1", "2024-01-03 00:00:00", 3)], "bot string, t string, user_id int").withColumn("ts", F.to_timestamp("t"))
    groups = spark.createDataFrame([("a1", "maths"), ("b", "arts")], "bot string, course string")
    got = {(r.course, r.level): (r.calls, r.users) for r in usage.usage_report(rows, groups, ["course"], "2024-01-01 12:00:00", "2024-01-03 00:00:00", ["a*", "b"]).collect()}
    assert got == {(None, 0): (1, 1), ("arts", 0): (1, 1), (None, 1): (2, 2)}
    assert usage.usage_report(rows, groups, ["course"]).where("level = 1").first().calls == 4


def test_research_result(spark):
    rows = [(1, 0, "user", "q", None, None), (1, 1, "assistant", "[RAG] x", ["s2", "s1"], "rag"), (1, 2, "assistant", "[RAG] y", ["s1", None, "s3"], "web"), (1, 3, "assistant", "z", [], "rag"), (2, 0, "user", "q", None, None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, sources array<string>, agent string")
    got = {r.conv_id: r for r in usage.research_result(df, "[RAG").collect()}
    assert got[1].outputs == "[RAG] x\n\n[RAG] y" and sorted(got[1].sources[:2]) == ["s1", "s2"] and got[1].sources[2] == "s3" and got[1].agents == ["rag", "web"]
    assert (got[2].outputs, got[2].sources, got[2].agents) == ("none", [], [])


def test_citations_by_hand(spark):
    """Answer 1: a claim rightly cited, one cited wrongly with evidence elsewhere; answer 2: a claim without evidence or citation; a citation of no claim."""
    claims = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "answer_id int, claim_no int")
    cited = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (3, 9, "a")], "answer_id int, claim_no int, source_id string")
    known = spark.createDataFrame([(1, 1, "a"), (1, 1, "c"), (1, 2, "c")], "answer_id int, claim_no int, source_id string")
    r = evaluate.citation_scores(claims, cited, known).first()
    assert (r.claims, r.citations) == (3, 3)
    assert (r.citation_accuracy, r.citation_completeness, r.unsupported_rate, r.hallucination_rate) == pytest.approx((1 / 3, 1 / 3, 1 / 3, 1 / 2), abs=1e-6)


@pytest.mark.parametrize("alpha", [0.2, 1.0, 2.0])
def test_beta_weights(alpha):
    u = (np.arange(20_000) + 0.5) / 20_000
    x = classify.beta_quantile(u, alpha)
    assert (np.diff(x) >= -1e-12).all() and x.mean() == pytest.approx(0.5, abs=1e-6)
    assert x.var() == pytest.approx(1 / (4 * (2 * alpha + 1)), rel=2e-3)
    if alpha == 1.0:
        assert x == pytest.approx(u, abs=1e-6)
    if alpha == 2.0:
        assert 3 * x**2 - 2 * x**3 == pytest.approx(u, abs=1e-4)


def test_mixing_is_a_permutation(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], [float(i % 2)]) for i in range(200)], "id int, x array<double>, y array<double>").repartition(6)
    got = classify.mixup_permuted(rows, 0.4, 3).collect()
    assert sorted(r.id for r in got) == sorted(r.other for r in got) == list(range(200))
    assert all(r.x[0] == pytest.approx(r.weight * r.id + (1 - r.weight) * r.other) and r.y[0] == pytest.approx(r.weight * (r.id % 2) + (1 - r.weight) * (r.other % 2)) for r in got)
    assert sum(r.id == r.other for r in got) < 10 and sorted(classify.mixup_permuted(rows.repartition(2), 0.4, 3).collect()) == sorted(got)
    assert {r.other for r in classify.mixup_permuted(rows, 0.4, 4).where("id < 9").collect()} != {r.other for r in got if r.id < 9}


def test_equal_cells(spark):
    """Ten by ten pixels in cells of two: the bright edge belongs to no equal cell, but to the others."""
    pixels = spark.range(100).selectExpr("1 AS image_id", "id div 10 AS y", "id % 10 AS x", "CASE WHEN id % 10 >= 8 OR id div 10 >= 8 THEN 255e0 ELSE 10e0 END AS v")
    assert detect.uneven_lighting(pixels, 10, 10, equal=True).first().spread == 0 and detect.uneven_lighting(pixels, 10, 10).first().uneven


def test_postings_of_some_terms(spark):
    """Only the asked terms' postings, with the very weights of all of them."""
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcdefgh", k=i % 13))) for i in range(60)] + [(90, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("a",), ("c",), ("zz",), ("a",)], "term string")
    every = {(r.doc_id, r.term): r.weight for r in search.encode_sparse(docs).collect()}
    assert {(r.doc_id, r.term): r.weight for r in search.encode_sparse(docs, terms=terms).collect()} == {k: v for k, v in every.items() if k[1] in "ac"}


def test_a_community_of_most_nodes(spark):
    """Only the first few of each task's part of a community are ranked together."""
    labels = spark.createDataFrame([(i, 0 if i < 300 else 1) for i in range(310)], "id int, community int").repartition(5)
    edges = spark.createDataFrame([(i % 7, 50 + i % 200) for i in range(400)] + [(305, 306)], "src int, dst int")
    report = graph.community_report(labels, edges)
    got = {r.community: r for r in report.collect()}
    degree = {}
    for i in range(400):
        for v in (i % 7, 50 + i % 200):
            degree[v] = degree.get(v, 0) + 1
    assert (got[0].n_nodes, got[0].top) == (300, ",".join(map(str, sorted(degree, key=lambda v: (-degree[v], v))[:3]))) and (got[1].n_nodes, got[1].n_edges) == (10, 1)
    assert "WindowGroupLimit" in report._jdf.queryExecution().executedPlan().toString()


def test_a_users_tokenizer_measures_chunks(spark):
    """Sizes in the user's tokens: here, runs of two letters at most."""
    import re

    pairs = re.compile(r"[a-z]{1,2}").findall
    text = "abcd ef. ghijkl mn. op"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.n_tokens for r in chunk.count_tokens_by(rows, pairs).collect()} == {1: 8, 2: 0, 3: 0}
    for splitter in (chunk.recursive_splitter(3, tokens=pairs), chunk.piece_splitter(3, 0, tokens=pairs), chunk.char_splitter(3, 0, tokens=pairs)):
        chunks = [r.chunk for r in chunk.split_text(rows, splitter).where("id = 1").collect()]
        assert len(chunks) > 2 and all(len(pairs(c)) <= 3 for c in chunks)
        assert "".join(re.findall("[a-z]", "".join(chunks))) == "".join(re.findall("[a-z]", text))
    with pytest.raises(ValueError):
        chunk.Measure("abc", lambda s: ["c", "a"])


def test_batches_without_chunks(spark):
    for rows in ([(1, None)], [(2, "")], [(1, None), (3, "a b")]):
        df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
        assert [r.id for r in chunk.split_text(df, chunk.recursive_splitter(3)).collect()] == [i for i, x in rows if x]
