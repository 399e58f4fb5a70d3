"""Leaks among thousands of benchmark items, and in documents with more than one passage like an item."""

import numpy as np
import pyarrow as pa
import pytest

from rillworks.llm import decontaminate
from rillworks.llm._text import chunks


def test_thousands_of_items(spark):
    rng = np.random.default_rng(3)
    vocab = np.array([f"v{i}" for i in range(8000)])
    share = 1 / np.arange(3, 8003)
    share /= share.sum()
    draw = lambda n: list(rng.choice(vocab, n, p=share))
    items = [(i, draw(int(rng.integers(8, 45)))) for i in range(2000)]
    docs, want = [], set()
    for i, w in items[:300]:
        docs.append((2 * i, " ".join([*draw(40), *w, *draw(40)])))
        docs.append((2 * i + 1, " ".join([*draw(40), *(x for k, x in enumerate(w) if k % 5 != 1), *draw(40)])))
        want |= {(2 * i, i), (2 * i + 1, i)}
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontaminate.build_index(docs.unionByName(spark.createDataFrame([(-1 - i, " ".join(draw(60))) for i in range(500)], docs.schema)), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, index).collect()}
    lost = want - found
    assert not {x for x in lost if x[0] % 2 == 0} and len(lost) <= 3


def test_every_passage_is_checked(spark):
    item = [f"rare{i}" for i in range(12)]
    filler = [f"word{i}" for i in range(400)]
    mixed = " ".join([*filler[:80], *reversed(item), *item[::-1][:6], *filler[80:200]])
    copy = " ".join(x for k, w in enumerate(item) for x in (w, filler[200 + k], filler[300 + k]))
    rows = [(1, f"{mixed} {copy} {' '.join(filler[200:300])}"), (2, mixed), *((10 + i, " ".join(filler[i : i + 200])) for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = decontaminate.build_index(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    found = decontaminate.find_leaks(docs, index).collect()
    assert [(r.doc_id, r.item_id, r.common) for r in found] == [(1, 7, 1.0)]


def test_long_items_decoys_and_plain_search(spark):
    rng = np.random.default_rng(5)
    vocab = np.array([f"v{i}" for i in range(5000)])
    share = 1 / np.arange(3, 5003)
    share /= share.sum()
    draw = lambda n: list(rng.choice(vocab, n, p=share))
    items = {i: draw(n) for i, n in enumerate([2000, 800, 300, 120, *rng.integers(8, 60, 60).tolist()])}
    docs = {}
    for i, w in items.items():
        docs[10 * i] = w
        docs[10 * i + 1] = [*w[: len(w) // 3] * 40, *draw(30), *w]  # a decoy before the whole
        docs[10 * i + 2] = [x for k, x in enumerate(w) if k % 4 != 3]
        docs[10 * i + 3] = draw(2 * len(w))
        docs[10 * i + 4] = w[::-1]
    extra = [(-1 - i, " ".join(draw(60))) for i in range(300)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(9999, None), (9998, ""), (9997, " ")], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(None, "x y z"), (7777, None), (7778, "")], "item_id long, text string")

    def shared(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b, 1):
                before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    want = {(d, i) for i, w in items.items() for d in range(10 * i, 10 * i + 3) if len(w) * len(docs[d]) > 4e6 or shared(w, docs[d]) >= 0.65 * len(w)}
    for limit in (decontaminate.BYTES, 12_000):  # one index, or several
        index = decontaminate.build_index(rows.unionByName(spark.createDataFrame(extra, rows.schema)), bench, limit=limit)
        assert (len(index) > 1) == (limit == 12_000)
        out = decontaminate.find_leaks(rows, index).collect()
        found = {(r.doc_id, r.item_id) for r in out if r.doc_id % 10 < 3}
        assert len(want - found) <= 0.02 * len(want) and {(10 * i, i) for i in items} | {(10 * i + 1, i) for i in items} <= found
        assert not {(r.doc_id, r.item_id) for r in out if r.doc_id % 10 > 2} and all(r.cosine <= 1.0001 for r in out)
        assert all(r.common == 1 and abs(r.cosine - 1) < 1e-4 for r in out if r.doc_id == 10 * r.item_id)


@pytest.mark.parametrize("n", [40, 5000])
def test_candidates_in_latent_space(spark, n):
    rng = np.random.default_rng(4)
    vocab = np.array([f"v{i}" for i in range(8000)])
    share = 1 / np.arange(3, 8003)
    share /= share.sum()
    draw = lambda n: list(rng.choice(vocab, n, p=share))
    items = [draw(int(rng.integers(8, 45))) for _ in range(n)]
    others = spark.createDataFrame([(-1 - i, " ".join(draw(200))) for i in range(300)], "doc_id long, text string")
    (index,) = decontaminate.build_index(others, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    leaks = {
        "verbatim": lambda w: w,
        "replaced": lambda w: [x if rng.random() > 0.3 else draw(1)[0] for x in w],
        "inserted": lambda w: [y for x in w for y in (x, *(draw(1) if rng.random() < 0.3 else ()))],
    }
    for leak in leaks.values():
        found, pairs, some = 0, 0, items[:200]
        for c in chunks(pa.array([" ".join([*draw(40), *leak(w), *draw(40)]) for w in some])):
            row, _, step, entry = decontaminate.candidates(index, decontaminate._words(c), c.n)
            got = set(zip((c.lo + row[step]).tolist(), index.of[entry].tolist()))
            found += sum((c.lo + k, c.lo + k) in got for k in range(c.n))
            pairs += len(got)
        assert found >= 0.9 * len(some) and pairs <= 0.02 * n * len(some) + 2 * len(some)
