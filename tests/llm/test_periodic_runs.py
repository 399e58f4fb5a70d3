"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import pytest
from .brute import words
from pyspark.sql import functions as F

from rillworks.llm.periodic_runs import periodic_runs
from rillworks.llm.queries import op13_periodic_runs


def plain(w, least=6, times=4):
    """(start, length, period) of all runs."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, times * q):
                found.setdefault((s, i - s + q), q)  # a multiple of the period comes later
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {p for s, n, q in runs for p in range(s + q, s + n)}
    return " ".join(x for p, x in enumerate(w) if p not in gone)


def made(rng):
    n, letters = rng.choice([0, 1, 5, 6, 7, 24, 80, 200]), rng.choice([1, 2, 3, 40])
    w = [f"w{rng.randrange(letters)}é" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a, p = rng.randrange(n), 1 + rng.randrange(9)
            for i in range(a, rng.randrange(a, n)):
                w[i] = w[a + (i - a) % p]
    return rng.choice([" ", "\n", "\t \r"]).join(w)


def thue_morse(n):
    return " ".join("ab"[bin(i).count("1") % 2] for i in range(n))


CASES = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " + "a b c " * 4 + "a y", "a " * 30 + "b " * 30, "a\x0bb\x0ca\rb a b a b", "a b " * 7, thue_morse(512), thue_morse(64) + " " + thue_morse(64), " ".join(["p q r s"] * 200 + ["t"] * 7)]


@pytest.mark.parametrize("least,times", [(6, 4), (4, 2), (2, 3)])
def test_against_all_periods(spark, least, times):
    rng = random.Random(7)
    texts = CASES + [made(rng) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for r in periodic_runs(docs, least=least, times=times).collect():
        w = words(texts[r.doc_id])
        want = plain(w, least, times)
        assert [tuple(x) for x in r.runs] == want, texts[r.doc_id]
        assert (r.n_words, r.kept_text) == (len(w), kept(w, want))


def test_rows_as_they_are(spark):
    """Null and repeated ids, repeated rows, columns with the result's names, no rows."""
    rows = [(None, "a " * 9, "x"), (1, "a " * 9, "y"), (1, "a " * 9, "y"), (1, "b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((repr(r.doc_id), r.kept_text) for r in periodic_runs(docs).collect())
    assert got == [("1", "a"), ("1", "a"), ("1", "b c"), ("None", "a")]
    assert periodic_runs(docs.where("false")).collect() == []
    other = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("body"))
    assert {r.doc_id for r in periodic_runs(other, "key", "body").collect()} == {None, "k1"}
    with pytest.raises(ValueError):
        periodic_runs(docs, times=1)


def test_very_long_text(spark):
    """A period that ends within, a common word for all of a long text, and words that never repeat."""
    unit = [f"u{i}" for i in range(700)]
    w = [f"n{i}" for i in range(50_000)] + unit * 40 + ["z"] * 100_000
    r = periodic_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(50_000, 28_000, 700), (78_000, 100_000, 1)]
    assert r.kept_text == " ".join([*w[:50_000], *unit, "z"])


def test_query_plants_periods_and_digests(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: made(rng) for i in range(300)} | {300: None, 301: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in op13_periodic_runs(spark, str(tmp_path)).collect():
        w = words(texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, runs).encode()).hexdigest()
    assert planted > 10
