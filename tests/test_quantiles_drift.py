"""Quantiles over ranges and by sketches, in batch and on streams; drift against a reference; average precision by size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillworks.operators import detect, drift, quantiles, usage
from rillworks.streaming import incremental

ALPHA = 0.01


def values(seed=1, n=3000):
    """A group with most rows, one with a few, one of equal values, one of nulls."""
    rng = random.Random(seed)
    rows = [("hot", rng.choice([rng.lognormvariate(3, 2), -rng.random() * 50, 0.0, 7.0])) for _ in range(n)]
    rows += [("few", v) for v in (3.0, 1.0)] + [("same", 5.0)] * 40 + [("none", None)] * 5 + [(None, v) for v in (1.0, 2.0, None)]
    rng.shuffle(rows)
    return rows


def groups(rows):
    out = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return out


def test_exact_quantiles(spark):
    rows, probs = values(), [0.0, 0.05, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: list(r.quantiles) for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect()}
    want = {k: [float(np.percentile(v, 100 * p)) for p in probs] for k, v in groups(rows).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    every = quantiles.exact_quantiles(df, [], "v", probs).first().quantiles
    assert list(every) == pytest.approx([float(np.percentile([v for _, v in rows if v is not None], 100 * p)) for p in probs])
    assert quantiles.exact_quantiles(df.where("false"), ["k"], "v", probs).collect() == []


@pytest.mark.parametrize("alpha", [0.01, 0.1])
def test_sketches_stay_within_their_share(spark, alpha):
    rows, probs = values(2), [0.0, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in quantiles.sketch_quantiles(quantiles.sketch(df, ["k"], "v", alpha), ["k"], probs, alpha).collect()}
    for k, v in groups(rows).items():
        v = sorted(v)
        assert got[k].n == len(v)
        for p, x in zip(probs, got[k].quantiles):
            true = v[max(1, math.ceil(p * len(v))) - 1]
            assert abs(x - true) <= alpha * abs(true) * (1 + 1e-9)
    assert set(got) == set(groups(rows))


def test_sketches_of_parts_add_up(spark):
    df = spark.createDataFrame(values(3), "k string, v double").withColumn("part", F.pmod(F.xxhash64("k", "v"), F.lit(3)))
    whole = quantiles.sketch(df, ["k"], "v")
    parts = quantiles.merged([quantiles.sketch(df.where(F.col("part") == i), ["k"], "v") for i in range(3)], ["k"])
    assert sorted(map(repr, whole.select("k", "bucket", "n").collect())) == sorted(map(repr, parts.select("k", "bucket", "n").collect()))


def test_odd_numbers_have_buckets(spark):
    odd = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308, 1.0, math.nan, None]
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double").select("i", quantiles.bucket(F.col("v")).alias("b")).sort("i").collect()]
    assert got[:2] == [0, 0] and got[-2:] == [None, None]
    assert got[3] < got[5] < 0 < got[4] < got[7] < got[6] < got[2]


def calls(seed=5, n=1500):
    rng = random.Random(seed)
    start = 1_700_000_000 - 1_700_000_000 % 3600
    return [(i, rng.choice(["a", "a", "a", "b"]), start + 10 * i, rng.random() < 0.1, round(rng.random(), 3), rng.choice([None, rng.lognormvariate(4, 1), rng.lognormvariate(4, 1)])) for i in range(n)]


def metrics(spark, rows):
    df = spark.createDataFrame(rows, "i int, route string, s long, error boolean, cost double, ms double")
    return df.select("i", "route", F.lit(1).alias("key"), F.timestamp_seconds("s").alias("ts"), "error", "cost", "ms")


def streamed(spark, tmp_path, batches, how):
    """The rows that a stream over files, one a step, returns in append mode."""
    for n, rows in enumerate(batches):
        metrics(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    schema = metrics(spark, batches[0]).schema
    for n in range(len(batches)):
        spark.read.parquet(f"{tmp_path}/in{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/all")
        how(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def keyed(rows):
    return {(r.route, r.start): (r.calls, r.errors, round(r.cost, 6), tuple(r.quantiles)) for r in rows}


def test_streamed_metrics_equal_batch(spark, tmp_path):
    """Each closed span comes once, with the very numbers of a batch job; its quantiles lie within the stated share of the exact values."""
    rows = calls()
    end = [(9999, "end", rows[-1][2] + 7 * 3600, False, 0.0, 1.0)]
    got = keyed(streamed(spark, tmp_path, [rows[:500], rows[500:1100], rows[1100:], end, [(10000, *end[0][1:])]], incremental.stream_metrics).collect())
    want = keyed(usage.sketched_metrics(metrics(spark, rows)).collect())
    assert got == want and len(got) > 6
    exact = {}
    for _, route, s, _, _, ms in rows:
        if ms is not None:
            exact.setdefault((route, s // 3600), []).append(ms)
    for (route, start), (_, _, _, found) in got.items():
        own = sorted(exact[route, int(start.timestamp()) // 3600])
        for p, x in zip((0.5, 0.95), found):
            true = own[max(1, math.ceil(p * len(own))) - 1]
            assert abs(x - true) <= ALPHA * true * (1 + 1e-9)


def test_late_rows_of_a_stream(spark, tmp_path):
    """A row behind the watermark's delay counts in its span; one whose span is over doesn't."""
    rows = calls(6, 800)
    first = rows[0][2]
    late, too_late = (20_000, "b", first + 2 * 3600 - 300, True, 1.0, 5.0), (20_001, "b", first + 60, True, 1.0, 5.0)
    until = [r for r in rows if r[2] < first + 2 * 3600 + 300]  # ten minutes of delay: the second hour is still open
    end = [(9999, "end", first + 30 * 3600, False, 0.0, 1.0)]
    got = keyed(streamed(spark, tmp_path, [until, [late, too_late], end, [(10000, *end[0][1:])]], incremental.stream_metrics).collect())
    want = keyed(usage.sketched_metrics(metrics(spark, [*until, late])).collect())
    assert got == want


def index(known, actual, smoothing=0.5):
    p, q = ([(x + smoothing) / (sum(c) + smoothing * len(c)) for x in c] for c in (known, actual))
    return sum((b - a) * math.log(b / a) for a, b in zip(p, q))


def test_drift_by_hand(spark):
    reference = [1.0, 2.0, 3.0, 4.0, None, 9.0]
    rows = [("a", 0, 1.0), ("a", 10, 9.0), ("a", 20, 9.5), ("a", 3700, None), ("b", 3800, 3.0), ("b", 3900, math.nan)]
    df = spark.createDataFrame(rows, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    known = spark.createDataFrame([(v,) for v in reference], "v double")
    got = {(r.k, int(r.start.timestamp())): (r.n, r.psi, r.drift) for r in drift.value_drift(df, known, "v", edges=[2.5, 4.0], by=["k"]).collect()}
    counts = [2, 1, 2, 1]  # below 2.5, below 4, from 4 on, missing
    want = {("a", 0): (3, index(counts, [1, 0, 2, 0])), ("a", 3600): (1, index(counts, [0, 0, 0, 1])), ("b", 3600): (2, index(counts, [0, 1, 0, 1]))}
    assert {k: v[:2] for k, v in got.items()} == {k: pytest.approx(v) for k, v in want.items()}
    assert all(d == ("major" if p >= 0.25 else "moderate" if p >= 0.1 else "none") for _, p, d in got.values())
    assert index(counts, [20, 10, 20, 10]) < 0.1  # the same shares hardly count


def test_drift_finds_a_shift_and_nothing_else(spark):
    """Bins from the reference's sketch; the third hour's values are shifted; the stream gives the batch's numbers."""
    rng = random.Random(9)
    known = spark.createDataFrame([(rng.gauss(0.6, 0.1),) for _ in range(4000)], "v double")
    rows = [(h * 3600 + i, rng.gauss(0.6 - 0.1 * (h == 2), 0.1)) for h in range(4) for i in range(900)]
    df = spark.createDataFrame(rows, "s long, v double").select(F.timestamp_seconds("s").alias("ts"), "v")
    edges = drift.reference_edges(known, "v", 10)
    counts = known.groupBy(drift.bin_of(F.col("v"), edges).alias("b")).count().collect()
    assert len(edges) == 9 and all(250 < r["count"] < 600 for r in counts)
    got = [r.drift for r in drift.value_drift(df, known, "v").sort("start").collect()]
    assert got == ["none", "none", "major", "none"]
    assert drift.reference_edges(known.where("false"), "v") == []


def test_streamed_drift_equals_batch(spark, tmp_path):
    rows = calls(8, 900)
    known, end = metrics(spark, rows[:200]), [(9999, "end", rows[-1][2] + 7 * 3600, False, 0.0, 1.0)]
    got = streamed(spark, tmp_path, [rows[:500], rows[500:], end, [(10000, *end[0][1:])]], lambda s: incremental.stream_drift(s, known, "ms", edges=[20.0, 60.0])).sort("start").collect()
    want = drift.value_drift(metrics(spark, rows), known, "ms", edges=[20.0, 60.0]).sort("start").collect()
    assert got == want and len(got) == 3


def test_streamed_defect_rate_equals_batch(spark, tmp_path):
    rows, end = calls(4, 900), [(9999, "end", calls(4, 900)[-1][2] + 7 * 3600, False, 0.0, 1.0)]
    failed = lambda df: df.withColumnRenamed("error", "fail")
    got = streamed(spark, tmp_path, [rows, end, [(10000, *end[0][1:])]], lambda s: incremental.stream_defect_rate(failed(s))).sort("start").collect()
    assert got == detect.defect_rate(failed(metrics(spark, rows))).sort("start").collect() and got


def test_ks_and_curve_against_all_thresholds(spark):
    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.3), rng.choice([0.1, 0.5, round(rng.random(), 2)])) for k in ("a", "b") for _ in range(150)] + [("c", 1, 0.5)] * 3
    df = spark.createDataFrame(rows, "k string, y int, score double")
    curve = {(r.k, r.threshold): (r.tpr, r.fpr) for r in detect.roc_curve(df, by=["k"]).collect()}
    ks = {r.k: (r.ks, r.gini) for r in drift.ks_statistic(df, by=["k"]).collect()}
    for k in "ab":
        p, n = ([s for g, y, s in rows if g == k and y == v] for v in (1, 0))
        for t in {s for g, _, s in rows if g == k}:
            assert curve[k, t] == pytest.approx((sum(s >= t for s in p) / len(p), sum(s >= t for s in n) / len(n)))
        wide = max(abs(sum(s <= t for s in p) / len(p) - sum(s <= t for s in n) / len(n)) for t in p + n)
        auc = sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)
        assert ks[k] == pytest.approx((wide, 2 * auc - 1))
    assert ks["c"] == (None, None) and curve["c", 0.5] == (1.0, None)


BOX = "image_id int, class_id int, box_id long, x1 double, y1 double, x2 double, y2 double, score double"


def square(side, x=0.0):
    return (float(x), 0.0, float(x + side), float(side))


def test_average_precision_by_size_by_hand(spark):
    """One image. Truths: 10 (small), 50 (medium), 200 (large) wide. Detections by score: the medium one exactly; a small one where nothing is; the
    large one exactly; the small one exactly; the medium one once more.

    Of all: hit, miss, hit, hit, miss: precision 1, 2/3, 3/4 at recalls 1/3, 2/3, 1; envelope 1, 3/4, 3/4: AP 5/6. Small: the medium and large hits
    are ignored, so miss, hit: AP 1/2. Medium: the hit, then the last, of its size and late: AP 1. Large: the hit only: AP 1."""
    truth = [(1, 0, 1, *square(10), 0.0), (1, 0, 2, *square(50, 1000), 0.0), (1, 0, 3, *square(200, 5000), 0.0)]
    found = [(1, 0, 10, *square(50, 1000), 0.9), (1, 0, 11, *square(12, 9000), 0.8), (1, 0, 12, *square(200, 5000), 0.7), (1, 0, 13, *square(10), 0.6), (1, 0, 14, *square(48, 1000), 0.5)]
    predicted, true = spark.createDataFrame(found, BOX), spark.createDataFrame(truth, BOX)
    got = {r.band: (r.map, r.map50, r.map75) for r in detect.mean_ap_by_size(predicted, true).collect()}
    assert got == {"all": pytest.approx((5 / 6,) * 3, abs=1e-6), "S": (0.5, 0.5, 0.5), "M": (1.0, 1.0, 1.0), "L": (1.0, 1.0, 1.0)}
    rows = {(r.band, round(r.threshold, 2)): r.ap for r in detect.ap_by_band(predicted.where("box_id >= 13"), true).collect()}
    # the wide one alone: 48 * 48 of 50 * 50 overlap, which 0.9216 passes up to the threshold of 0.9
    assert rows["M", 0.9] == 1.0 and rows["M", 0.95] == 0.0 and rows["L", 0.5] == 0.0


def test_a_truth_of_the_band_comes_before_a_nearer_one_of_another(spark):
    """A detection of 31 overlaps the large-side truth of 33 (medium) more than that of 29 (small). In S it takes the small one; in M the medium one."""
    truth = [(1, 0, 1, *square(29), 0.0), (1, 0, 2, *square(33), 0.0)]
    got = detect.match_outcomes(spark.createDataFrame([(1, 0, 9, *square(31.5), 0.9)], BOX), spark.createDataFrame(truth, BOX), (0.5,), detect.BANDS).first()
    assert list(got.outcomes) == [detect.TRUE, detect.TRUE, detect.TRUE, detect.IGNORED]
    assert detect.mean_ap_by_size(spark.createDataFrame([], BOX), spark.createDataFrame(truth, BOX)).where("band = 'S'").first().map == 0.0


def test_relabel_queue(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate((0.39, 0.4, 0.5, 0.6, 0.61, None))], "i int, confidence double")
    assert [r.i for r in detect.relabel_queue(rows).sort("i").collect()] == [1, 2, 3]
