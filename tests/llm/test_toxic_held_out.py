"""Toxicity on labelled rows that no learner has seen (the operator's settings were chosen by them), and on awkward rows."""

import numpy as np
import pytest

from rillworks.llm import toxicity
from rillworks.llm.language_id import fold

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    return toxicity.fit_toxicity_model(docs, labels.where(~fold("doc_id", 5, 0)))


def test_held_out_by_language(spark, model):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet").where(fold("doc_id", 5, 0))
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    found = {}
    for lang in (*sorted(rows.lang.unique()), None):
        own = rows if lang is None else rows[rows.lang == lang]
        bad, good = own[own.toxic == 1], own[own.toxic == 0]
        auc = np.mean([(b > good.score).mean() + (b == good.score).mean() / 2 for b in bad.score])
        hit, false = int((bad.predicted == 1).sum()), int((good.predicted == 1).sum())
        found[lang] = auc, hit / max(1, hit + false)
        print(lang, len(bad), len(good), "AUC", round(auc, 3), "found", hit, "false", false)
    assert found[None][0] > 0.85 and found[None][1] > 0.75 and found["en"][0] > 0.85 and found["en"][1] > 0.95
    function_words = set("les ach der die und des une la el los que the and of".split())
    assert not function_words & set(model.landmarks[: len(model.landmarks) // 3])


def test_awkward_rows(spark, model):
    long = "word of the " * 20_000
    rows = spark.createDataFrame([(1, None, 5.0), (1, "", 5.0), (2, long, 5.0), (2, long, 5.0), (3, long + "idiot", 5.0), (None, "an id.iot", 5.0)], "doc_id long, text string, score double")
    out = sorted((r.doc_id or 0, r.predicted, 0 <= r.score <= 1) for r in toxicity.score_toxicity(rows, model).collect())
    assert out == [(0, 1, True), (1, 0, True), (1, 0, True), (2, 0, True), (2, 0, True), (3, 1, True)]


def test_two_words_that_insult_together_only(spark):
    rng = np.random.default_rng(2)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ana", "oro", "ili") for c in ("st", "nd", "lk", "rm")] + ["dirty", "rotten"]
    rows = []
    for i in range(900):
        w = rng.choice(vocab, 30).tolist()
        w = [x for k, x in enumerate(w) if not (x == "rotten" and k and w[k - 1] == "dirty")]
        if i % 3 == 0:
            w[5:5] = ["dirty", "rotten"]
        else:
            w[3:3], w[9:9] = ["dirty"], ["rotten"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit_toxicity_model(df.where("doc_id < 700"), df)
    assert m.pairs and "dirty rotten" in m.landmarks
    out = toxicity.score_toxicity(df.where("doc_id >= 700"), m).join(df, "doc_id").toPandas()
    assert ((out.predicted == 1) & (out.toxic == 0)).sum() <= 60
