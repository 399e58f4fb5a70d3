"""Substring removal where ids repeat, row by row against a plain version."""

import random

from rillworks.llm import substring_dedup

from . import brute


def plain(rows, width):
    owner = {}
    for i, t in rows:
        if i is not None:
            w = brute.words(t)
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for i, t in rows:
        w = brute.words(t)
        gone = {p for k in range(len(w) - width + 1) if i is not None and owner[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def run(spark, rows, width, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, width=width).collect())


def test_ids_with_other_texts(spark):
    x, y = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    rows = [(1, x), (5, x), (5, y), (5, f"pre fix {x} end"), (7, y), (7, y), (None, x), (None, x), (9, None), (9, "")]
    for parts in (1, 3):
        assert run(spark, rows, 50, parts) == plain(rows, 50)


def test_random_rows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 200)
    rng = random.Random(8)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(6)]
    rows = []
    for _ in range(250):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages)[rng.randrange(8) :]
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
        rows.append((rng.choice([None, *range(60)]), " ".join(w)))
    rows += rng.choices(rows, k=120) + [(rng.randrange(60), rows[3][1]) for _ in range(200)]
    for parts in (1, 4):
        assert run(spark, rows, 12, parts) == plain(rows, 12)
